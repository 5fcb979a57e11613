"""Settings: tiles, compression, ingest orientation, object storage."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import SparkSession

from tomolake.errors import ConfigurationError


class SliceOrientation(Enum):
    AXIAL = "axial"
    SAGITTAL = "sagittal"
    CORONAL = "coronal"
    ISOTROPIC = "isotropic"


class Compressor(Enum):
    ZSTD = "zstd"
    LZ4 = "lz4"
    GZIP = "gzip"
    NONE = "uncompressed"


#: The highest level of each codec; fixed values.
MOST_LEVEL = {Compressor.ZSTD: 22, Compressor.LZ4: 16, Compressor.GZIP: 9, Compressor.NONE: 0}


@dataclass(frozen=True)
class TileConfig:
    """Extents of a tile: by the orientation of slices, or as given for x, y, z and t."""

    orientation: SliceOrientation = SliceOrientation.AXIAL
    x: int | None = None
    y: int | None = None
    z: int | None = None
    t: int = 1
    cube: int = 64

    def __post_init__(self):
        for k in ("x", "y", "z", "t", "cube"):
            if (v := getattr(self, k)) is not None and v < 1:
                raise ConfigurationError(f"tile extent {k} must be at least 1")

    def extents(self, shape: tuple[int, ...]) -> tuple[int, ...]:
        x, y, z = shape[:3]
        base = {
            SliceOrientation.AXIAL: (x, y, 1),
            SliceOrientation.SAGITTAL: (1, y, z),
            SliceOrientation.CORONAL: (x, 1, z),
            SliceOrientation.ISOTROPIC: (self.cube,) * 3,
        }[self.orientation]
        out = [min(o or b, s) for o, b, s in zip((self.x, self.y, self.z), base, (x, y, z), strict=True)]
        return tuple(max(1, v) for v in ([*out, min(self.t, shape[3])] if len(shape) == 4 else out))


@dataclass(frozen=True)
class CompressionConfig:
    algorithm: Compressor = Compressor.ZSTD
    level: int = 3

    def __post_init__(self):
        if self.level < 0:
            raise ConfigurationError("a compression level is not negative")

    def options(self) -> dict[str, str]:
        level = min(self.level, MOST_LEVEL[self.algorithm])
        out = {"compression": self.algorithm.value}
        if self.algorithm is Compressor.ZSTD:
            out["parquet.compression.codec.zstd.level"] = str(level)
        return out


@dataclass(frozen=True)
class OrientationConfig:
    target: str = "RAS"
    reorient: bool = False
    auto_detect: bool = True

    def __post_init__(self):
        if self.target not in ("RAS", "LAS", "LPS"):
            raise ConfigurationError(f"unknown orientation {self.target}")


@dataclass(frozen=True)
class WriteConfig:
    tile: TileConfig = field(default_factory=TileConfig)
    compression: CompressionConfig = field(default_factory=CompressionConfig)
    orientation: OrientationConfig = field(default_factory=OrientationConfig)
    tiles_per_group: int | None = None


@dataclass(frozen=True)
class ReadConfig:
    max_workers: int = 4
    memory_mb: int = 512

    def __post_init__(self):
        if self.max_workers < 1 or self.memory_mb < 1:
            raise ConfigurationError("workers and memory are at least 1")


@dataclass(frozen=True)
class S3Config:
    region: str = "us-east-1"
    endpoint: str | None = None
    use_virtual_addressing: bool = True
    multipart_mb: int = 64

    def apply(self, spark: SparkSession) -> None:
        """Sets the ``fs.s3a`` options of the session's Hadoop configuration; credentials come from its provider chain."""
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        conf.set("fs.s3a.endpoint.region", self.region)
        if self.endpoint:
            conf.set("fs.s3a.endpoint", self.endpoint)
        conf.set("fs.s3a.path.style.access", str(not self.use_virtual_addressing).lower())
        conf.set("fs.s3a.multipart.size", f"{self.multipart_mb}M")

    def filesystem(self):
        """The same store for reads without a job, by pyarrow; credentials come from its default chain."""
        from pyarrow import fs

        return fs.S3FileSystem(region=self.region, endpoint_override=self.endpoint, force_virtual_addressing=bool(self.endpoint) and self.use_virtual_addressing)


@dataclass(frozen=True)
class Config:
    write: WriteConfig = field(default_factory=WriteConfig)
    read: ReadConfig = field(default_factory=ReadConfig)
    s3: S3Config = field(default_factory=S3Config)


_current = Config()


def configure(write: WriteConfig | None = None, read: ReadConfig | None = None, s3: S3Config | None = None) -> Config:
    """Replaces whole sections of the settings; the others stay."""
    global _current
    given = {k: v for k, v in (("write", write), ("read", read), ("s3", s3)) if v is not None}
    _current = replace(_current, **given)
    return _current


def get_config() -> Config:
    return _current


def reset_config() -> Config:
    global _current
    _current = Config()
    return _current
