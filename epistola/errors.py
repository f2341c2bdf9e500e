"""What can go wrong, by where it goes wrong."""


class EngineError(Exception):
    """Any failure that the engine reports."""


class StoreError(EngineError):
    """The warehouse: wrong schema version, a missing table."""


class SyncError(EngineError):
    """A sync run: lock held, identity mismatch."""


class WriteUnsupportedError(EngineError):
    """The source takes no writes."""


class ToolError(EngineError):
    """Wrong arguments of an API function, or an unknown reference."""


class ConfigError(EngineError):
    """A configuration that can't be used."""
