"""Kinds of errors. Argument errors are raised at once; errors in data surface when an action runs."""


class EngineError(Exception):
    """Base of all errors of this library."""


class InvalidArgument(EngineError, ValueError):
    """A wrong name, position, range or option."""


class SchemaMismatch(EngineError):
    """Columns that don't fit a schema."""


class FormatError(EngineError):
    """Bytes or text that don't follow their format."""


class Unsupported(EngineError, NotImplementedError):
    """A format or feature that this build has no library for."""
