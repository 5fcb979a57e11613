"""tomolake: a Spark-native engine for studies of 3-D/4-D volumes and their metadata."""

from importlib import import_module

__version__ = "0.1.0"

_EXPORTS = {
    "Study": "operators.study", "VolumeSet": "operators.volumeset", "VolumeRef": "operators.volume", "MetaTable": "operators.meta", "KeyIndex": "operators.index", "align": "operators.index",
    "LazySet": "operators.mapped", "MappedSet": "operators.mapped", "VolumeSetWriter": "operators.writers", "StudyWriter": "operators.writers",
    "SampleFrame": "operators.samples", "SegmentationFrame": "operators.samples", "SampleConfig": "operators.samples", "Loading": "operators.samples", "Loader": "operators.samples",
    "configure": "config", "get_config": "config", "reset_config": "config", "WriteConfig": "config", "ReadConfig": "config", "S3Config": "config", "TileConfig": "config",
    "CompressionConfig": "config", "Compressor": "config", "OrientationConfig": "config", "SliceOrientation": "config", "uri_exists": "storage", "delete_uri": "storage",
    "TomolakeError": "errors", "ShapeError": "errors", "AlignmentError": "errors", "ConfigurationError": "errors", "SchemaError": "errors", "IngestError": "errors", "StorageError": "errors", "ViewError": "errors",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    # on first use: Python workers that only need a kernel do not load the whole library
    if name in _EXPORTS:
        value = import_module(f"tomolake.{_EXPORTS[name]}")
        return getattr(value, name)
    raise AttributeError(name)
