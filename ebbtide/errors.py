"""Errors that callers tell apart by code."""


class CdcError(Exception):
    code = "CDC_ERROR"

    def __init__(self, message: str):
        super().__init__(f"{self.code}: {message}")


class Gap(CdcError):
    """The cursor's snapshot has expired."""

    code = "CDC_GAP"


class Busy(CdcError):
    """Another owner holds the lease."""

    code = "CDC_BUSY"


class MaxSnapshotsExceeded(CdcError):
    code = "CDC_MAX_SNAPSHOTS_EXCEEDED"


class IncompatibleCatalog(CdcError):
    code = "CDC_INCOMPATIBLE_CATALOG"


class SchemaTerminated(CdcError):
    """The subscribed table changes its shape at or before the snapshot asked for."""

    code = "CDC_SCHEMA_TERMINATED"


class NotYetImplemented(CdcError):
    code = "CDC_FEATURE_NOT_YET_IMPLEMENTED"


class Conflict(CdcError):
    """Another writer committed first."""

    code = "CDC_CONFLICT"
