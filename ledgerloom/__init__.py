"""Keyed-log tables and large-table data processing on Spark."""

from ledgerloom.config import ReadConsistency, TableConfig, WriteDurability
from ledgerloom.errors import ConsistencyError, LedgerError, LockError, StorageError, TransactionError, ValidationError
from ledgerloom.operators.state import LogView
from ledgerloom.table import LogTable
from ledgerloom.values import Bound, Kind, Value

__all__ = ["Bound", "ConsistencyError", "Kind", "LedgerError", "LockError", "LogTable", "LogView", "ReadConsistency", "StorageError", "TableConfig", "TransactionError", "ValidationError", "Value", "WriteDurability"]
