"""Table configuration and its builder."""

from __future__ import annotations

import enum
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Row
from pyspark.sql import types as T

from ledgerloom.errors import ValidationError
from ledgerloom.values import Kind, column_kind


class ReadConsistency(enum.Enum):
    """STRONG resolves the newest version for every read; EVENTUAL stays on a version until refreshed."""

    STRONG = "strong"
    EVENTUAL = "eventual"


class WriteDurability(enum.Enum):
    """FLUSH hands the commit to the operating system; FLUSH_SYNC also forces it to the device."""

    FLUSH = "flush"
    FLUSH_SYNC = "flush_sync"

    def __str__(self) -> str:
        return self.name


#: Columns the engine adds to every stored row.
SEG, IDX, TOMB = "_seg", "_idx", "_tombstone"
RESERVED = (SEG, IDX, TOMB)


@dataclass(frozen=True)
class TableConfig:
    data_dir: str = "table_data"
    schema: T.StructType | None = None
    primary_key: str | None = None
    secondary_keys: tuple[str, ...] = ()
    segment_rows: int = 262_144
    lock_timeout_s: float = 1.3
    read_consistency: ReadConsistency = ReadConsistency.STRONG
    write_durability: WriteDurability = WriteDurability.FLUSH
    #: Record conversion on the driver: object to values for ``upsert``, Row to object for ``get`` and ``delete``.
    encode: Callable[[Any], Sequence | dict] | None = None
    decode: Callable[[Row], Any] | None = None

    def validate(self) -> TableConfig:
        if self.schema is None or not self.schema.fields:
            raise ValidationError("fields are not set")
        names = self.schema.names
        if len({n.lower() for n in names}) != len(names):
            raise ValidationError("field names clash")
        if bad := [n for n in names if n.lower() in RESERVED]:
            raise ValidationError(f"reserved field names: {bad}")
        if self.primary_key is None:
            raise ValidationError("primary key is not set")
        for k in (self.primary_key, *self.secondary_keys):
            if k not in names:
                raise ValidationError(f"key {k!r} is not a field")
            if column_kind(self.schema[k].dataType) is Kind.BYTES:
                raise ValidationError(f"binary field {k!r} cannot be a key")
        if self.segment_rows < 1:
            raise ValidationError("segment_rows must be positive")
        return self


@dataclass
class ConfigBuilder:
    """Collects options, then opens the table: ``LogTable.configure(spark).data_dir(..)...initialize()``."""

    spark: Any
    _config: TableConfig = field(default_factory=TableConfig)

    def _with(self, **kw: Any) -> ConfigBuilder:
        self._config = replace(self._config, **kw)
        return self

    def data_dir(self, path: str) -> ConfigBuilder:
        return self._with(data_dir=str(path))

    def fields(self, schema: T.StructType | str) -> ConfigBuilder:
        return self._with(schema=T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def primary_key(self, name: str) -> ConfigBuilder:
        return self._with(primary_key=name)

    def secondary_keys(self, *names: str) -> ConfigBuilder:
        return self._with(secondary_keys=tuple(names))

    def segment_rows(self, n: int) -> ConfigBuilder:
        return self._with(segment_rows=n)

    def lock_timeout(self, seconds: float) -> ConfigBuilder:
        return self._with(lock_timeout_s=seconds)

    def read_consistency(self, c: ReadConsistency) -> ConfigBuilder:
        return self._with(read_consistency=c)

    def write_durability(self, d: WriteDurability) -> ConfigBuilder:
        return self._with(write_durability=d)

    def records(self, encode: Callable[[Any], Sequence | dict], decode: Callable[[Row], Any]) -> ConfigBuilder:
        return self._with(encode=encode, decode=decode)

    def initialize(self):
        from ledgerloom.table import LogTable

        return LogTable.open(self.spark, self._config)
