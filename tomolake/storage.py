"""Files and manifests through Hadoop's file systems, so any URI that Spark reads works."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from tomolake.config import get_config
from tomolake.errors import StorageError


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, uri: str):
        return self._jvm.org.apache.hadoop.fs.Path(uri)

    def _fs(self, uri: str):
        if uri.startswith(("s3a://", "s3://")):
            get_config().s3.apply(self.spark)
        return self._path(uri).getFileSystem(self._conf)

    def qualified(self, uri: str) -> str:
        """The name by which Spark's readers report a file."""
        return self._fs(uri).makeQualified(self._path(uri)).toString()

    def listed(self, uri: str) -> list[str]:
        """Files at a path, below a directory, or that fit a pattern, in order."""
        fs, out = self._fs(uri), []
        for status in fs.globStatus(self._path(uri)) or []:
            if not status.isDirectory():
                out.append(status.getPath().toString())
                continue
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                out.append(files.next().getPath().toString())
        return sorted(out)

    def exists(self, uri: str) -> bool:
        return bool(self._fs(uri).exists(self._path(uri)))

    def delete(self, uri: str) -> bool:
        return bool(self._fs(uri).delete(self._path(uri), True))

    def read_json(self, uri: str) -> dict:
        if not self.exists(uri):
            raise StorageError(f"nothing at {uri}")
        stream = self._fs(uri).open(self._path(uri))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write_json(self, uri: str, value: dict) -> None:
        """Readers see the old manifest or the new one: it is written aside and renamed over."""
        aside = f"{uri}.{uuid.uuid4().hex}"
        out = self._fs(aside).create(self._path(aside), True)
        try:
            out.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(aside).toUri() if "://" in aside else self._fs(aside).getUri(), self._conf)
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(self._fs(aside).makeQualified(self._path(aside)), self._fs(uri).makeQualified(self._path(uri)), options)


def opened(uri: str):
    """(pyarrow file system, path) by which this driver reads a URI without a job; None for other stores, and for local paths that are not here."""
    from pyarrow import fs

    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return (fs.LocalFileSystem(), u.path) if os.path.isdir(u.path) else None
    if u.scheme in ("s3", "s3a"):
        return get_config().s3.filesystem(), f"{u.netloc}{u.path}"
    return None


def uri_exists(spark: SparkSession, uri: str) -> bool:
    return Store(spark).exists(uri)


def delete_uri(spark: SparkSession, uri: str) -> bool:
    return Store(spark).delete(uri)


def snapshot(df: DataFrame, root: str, kind: str, **options: str) -> str:
    """Writes ``df`` as a new snapshot below ``root`` and returns its relative path."""
    rel = f"{kind}/{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(f"{root}/{rel}")
    return rel
