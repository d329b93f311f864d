"""Exceptions raised by the engine; all share :class:`LedgerError`."""


class LedgerError(Exception):
    """Base class of every engine error."""


class LockError(LedgerError):
    """A lock was requested or released in a state that does not allow it."""


class ValidationError(LedgerError):
    """A value, field name, bound, schema or option is not acceptable."""


class ConsistencyError(LedgerError):
    """Stored metadata and data disagree, or a commit lost a race."""


class TransactionError(LedgerError):
    """A transaction call arrived in the wrong state."""


class StorageError(LedgerError):
    """The file system refused an operation."""
