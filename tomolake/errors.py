"""Errors; each is also the builtin that callers expect."""


class TomolakeError(Exception):
    """Base of all errors of this library."""


class ShapeError(TomolakeError, ValueError):
    """A shape does not fit."""


class AlignmentError(TomolakeError, ValueError):
    """Keys of tables or volumes do not agree."""


class ConfigurationError(TomolakeError, ValueError):
    """A setting is out of bounds."""


class SchemaError(TomolakeError, ValueError):
    """A column or predicate does not fit."""


class IngestError(TomolakeError, ValueError):
    """Source files cannot be understood."""


class StorageError(TomolakeError, RuntimeError):
    """A table or manifest cannot be read or written."""


class ViewError(TomolakeError, TypeError):
    """A view was asked to change."""
