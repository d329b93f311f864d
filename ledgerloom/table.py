"""A keyed-log table: one directory, one schema, one primary key."""

from __future__ import annotations

import contextlib
import os
import shutil
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.config import IDX, SEG, TOMB, ConfigBuilder, ReadConsistency, TableConfig, WriteDurability
from ledgerloom.errors import ConsistencyError, StorageError, TransactionError, ValidationError
from ledgerloom.operators import state
from ledgerloom.operators.state import LogView
from ledgerloom.sources.manifest import MAX_INDEX, Manifest, ManifestStore, Segment, WriterLock
from ledgerloom.values import Bound, Kind, Value, column_kind


#: Bits of an index that number the rows of one write task; the others number the tasks.
TASK_BITS = 28


@dataclass
class _Staged:
    """One staged operation: rows in order, all live or all tombstones."""

    df: DataFrame
    tombstone: bool
    order_by: tuple[Column, ...] = ()
    mark: tuple[str, int] | None = None


class LogTable:
    """Upserts, deletes, transactions, lookups, maintenance.

    Reads are lazy DataFrames over one immutable manifest version; ``get`` alone
    collects, and at most one row.  Writes are Spark jobs that end in one manifest
    swap, so prefer ``upsert_df`` over many small ``upsert`` calls.
    """

    def __init__(self, spark: SparkSession, config: TableConfig, store: ManifestStore, manifest: Manifest):
        self.spark, self.config, self._store, self._pinned = spark, config, store, manifest
        self._lock = WriterLock(os.path.join(config.data_dir, "writer.lock"), config.lock_timeout_s)
        self._tx: list[_Staged] | None = None

    # -- opening ---------------------------------------------------------------

    @staticmethod
    def configure(spark: SparkSession) -> ConfigBuilder:
        return ConfigBuilder(spark)

    @staticmethod
    def open(spark: SparkSession, config: TableConfig) -> LogTable:
        """Open or create.  Trailing nullable fields may be added to a stored schema; anything else must match."""
        config.validate()
        store = ManifestStore(config.data_dir, config.write_durability is WriteDurability.FLUSH_SYNC)
        if not store.exists():
            store.create()
            with WriterLock(os.path.join(config.data_dir, "writer.lock"), config.lock_timeout_s):
                if not store.exists():
                    store.publish(Manifest(0, config.schema.jsonValue(), config.primary_key, list(config.secondary_keys), [Segment(1)]), None)
        manifest = store.load()
        stored = T.StructType.fromJson(manifest.schema)
        if manifest.primary_key != config.primary_key:
            raise ValidationError(f"table key is {manifest.primary_key!r}, not {config.primary_key!r}")
        common = min(len(stored), len(config.schema))
        for a, b in zip(stored.fields[:common], config.schema.fields[:common]):
            if a.name != b.name or a.dataType != b.dataType:
                raise ValidationError(f"field {a.name}: {a.dataType.simpleString()} is stored, {b.name}: {b.dataType.simpleString()} was asked for")
        if bad := [f.name for f in config.schema.fields[common:] if not f.nullable]:
            raise ValidationError(f"added fields must be nullable: {bad}")
        return LogTable(spark, config, store, manifest)

    # -- versions --------------------------------------------------------------

    def refresh(self) -> int:
        """Advance a pinned (EVENTUAL) reader to the newest version."""
        self._pinned = self._store.load()
        return self._pinned.version

    @property
    def version(self) -> int:
        return self._manifest().version

    def _manifest(self) -> Manifest:
        if self._tx is None and self.config.read_consistency is ReadConsistency.STRONG and self._store.current_version() != self._pinned.version:
            self.refresh()
        return self._pinned

    # -- log scans -------------------------------------------------------------

    def _log_schema(self) -> T.StructType:
        head = [T.StructField(SEG, T.IntegerType()), T.StructField(IDX, T.LongType()), T.StructField(TOMB, T.BooleanType())]
        return T.StructType(head + [T.StructField(f.name, f.dataType, True) for f in self.config.schema.fields])

    def log(self, from_seg: int = 0, from_idx: int = 0, manifest: Manifest | None = None) -> DataFrame:
        """Change-log entries at or after a position; earlier segments are not opened at all."""
        m = manifest or self._manifest()
        data = [p for s in m.segments if s.number >= from_seg for p in s.data]
        if not data:
            return self.spark.createDataFrame([], self._log_schema())
        # the explicit schema fills fields that older data sets lack with NULL
        df = self.spark.read.schema(self._log_schema()).parquet(*[os.path.join(self.config.data_dir, "data", p) for p in data])
        if from_idx:
            df = df.where((F.col(SEG) > from_seg) | (F.col(IDX) >= from_idx))
        return df

    def _view(self, manifest: Manifest | None = None, allow_scan: bool = False) -> LogView:
        m = manifest or self._manifest()
        held = [s for s in m.segments if s.data]
        # one compacted segment holds every key once: no window, no shuffle
        unique = len(held) == 1 and held[0].compacted
        return LogView(self.log(manifest=m), self.config.primary_key, self.config.secondary_keys, (SEG, IDX), TOMB, unique=unique, allow_scan=allow_scan)

    def fetch(self, positions: Sequence[tuple[int, int]], tag: str = "tag") -> DataFrame:
        """Log entries at (segment, index) positions, live or not, each with its ordinal in the list.

        Unknown positions give no row, repeated ones repeat theirs.  Only the named segments
        are opened, and the indexes reach the Parquet scan.
        """
        if tag in self._log_schema().names:
            raise ValidationError(f"tag column {tag!r} clashes with a field")
        keys = self.spark.createDataFrame([(i, int(s), int(x)) for i, (s, x) in enumerate(positions)], f"{tag} int, __s int, __x bigint")
        m = self._manifest().copy()
        m.segments = [s for s in m.segments if s.number in {int(p[0]) for p in positions}]
        log = self.log(manifest=m).where(F.col(IDX).isin([int(p[1]) for p in positions]) if positions else F.lit(False))
        # the list comes from the driver, so its size is known; a long one is left to the planner
        keys = F.broadcast(keys) if len(positions) <= 10_000 else keys
        return log.join(keys, (F.col(SEG) == F.col("__s")) & (F.col(IDX) == F.col("__x"))).select(tag, *self._log_schema().names)

    def _out(self, df: DataFrame, with_position: bool, *extra: str) -> DataFrame:
        return df if with_position else df.select(*extra, *self.config.schema.names)

    # -- reads -----------------------------------------------------------------

    def latest(self, with_position: bool = False) -> DataFrame:
        return self._out(state.latest(self._view()), with_position)

    def get(self, key):
        """The live row of a key (decoded if the table has a decoder), or None."""
        rows = self._out(state.find_by(self._view(), self.config.primary_key, key), False).take(2)
        if len(rows) > 1:
            raise ConsistencyError("more than one live row for a key")
        return self._decoded(rows)

    def _decoded(self, rows: list[Row]):
        return None if not rows else rows[0] if self.config.decode is None else self.config.decode(rows[0])

    def find_by(self, name: str, value, *, allow_scan: bool = False, with_position: bool = False, **paging) -> DataFrame:
        return self._out(state.find_by(self._view(allow_scan=allow_scan), name, value, **paging), with_position)

    def batch_find_by(self, name: str, values: Sequence, *, allow_scan: bool = False, with_position: bool = False, **paging) -> DataFrame:
        return self._out(state.batch_find_by(self._view(allow_scan=allow_scan), name, values, **paging), with_position, paging.get("tag", "tag"))

    def range_by(self, name: str, lo: Bound, hi: Bound, *, allow_scan: bool = False, with_position: bool = False, **paging) -> DataFrame:
        return self._out(state.range_by(self._view(allow_scan=allow_scan), name, lo, hi, **paging), with_position)

    # -- writes ----------------------------------------------------------------

    def _rows_df(self, rows: Iterable) -> DataFrame:
        names, data = self.config.schema.names, []
        for r in rows:
            if self.config.encode is not None:
                r = self.config.encode(r)
            values = [r.get(n) for n in names] if isinstance(r, dict) else list(r)
            if isinstance(r, dict) and (bad := set(r) - set(names)):
                raise ValidationError(f"unknown fields {sorted(bad)}")
            if len(values) != len(names):
                raise ValidationError(f"{len(names)} values expected, {len(values)} given")
            for n, v in zip(names, values):
                f = self.config.schema[n]
                if isinstance(v, Value):
                    v = v.payload
                kind = column_kind(f.dataType)
                if v is not None and kind is not None and Value.of(v).kind() is not kind:
                    raise ValidationError(f"field {n!r} takes {kind.name}, not {Value.of(v).kind().name}")
                if kind is Kind.DECIMAL and v is not None and not state.fits(v, f.dataType):
                    raise ValidationError(f"{v} does not fit {f.dataType.simpleString()}")
            data.append(tuple(v.payload if isinstance(v, Value) else v for v in values))
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in self.config.schema.fields])
        # one slice keeps the rows in order
        return self.spark.createDataFrame(data, nullable).coalesce(1)

    def upsert(self, *rows) -> None:
        """Append rows (tuples, dicts or what the table's encoder takes) in order; the last row of a key wins."""
        self._stage(_Staged(self._rows_df(rows), False))

    def mark(self, name: str) -> int | None:
        """Last number committed under a name by ``upsert_df(mark=...)``."""
        return self._store.load().marks.get(name)

    def upsert_df(self, df: DataFrame, order_by: Sequence[str | Column] = (), mark: tuple[str, int] | None = None, assume_unique: bool = False) -> None:
        """Append a DataFrame.  Without ``order_by`` its keys must be unique.

        That is checked, which shuffles the keys; ``assume_unique`` takes the caller's word.

        ``mark`` is a (name, number) that becomes visible together with the rows.
        """
        if missing := set(self.config.schema.names) - set(df.columns):
            raise ValidationError(f"missing fields {sorted(missing)}")
        for f in self.config.schema.fields:
            if df.schema[f.name].dataType != f.dataType:
                raise ValidationError(f"field {f.name!r} is {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        df = df.select(*self.config.schema.names, *[F.col(c).alias(f"__order{i}") if isinstance(c, str) else c.alias(f"__order{i}") for i, c in enumerate(order_by)])
        if not order_by and not assume_unique and df.groupBy(self.config.primary_key).count().where("count > 1").take(1):
            raise ValidationError("repeated keys need order_by")
        self._stage(_Staged(df, False, tuple(F.col(f"__order{i}") for i in range(len(order_by))), mark))

    def delete(self, key):
        """Delete by primary key; the deleted row (decoded if the table has a decoder), or None."""
        return self._decoded(self.delete_by(self.config.primary_key, key).take(1))

    def delete_by(self, name: str, value) -> DataFrame:
        """Append full-row tombstones for the matching rows and return those rows.

        The result reads the version before the delete, so it stays right after the commit.
        Lookup and append happen under one lock: nothing can be written in between.
        """
        if self._tx is not None:
            found = self.find_by(name, value)
            if not found.isEmpty():
                self._tx.append(_Staged(found, True))
            return found
        with self._lock:
            self.refresh()
            found = self.find_by(name, value)
            if not found.isEmpty():
                self._commit([_Staged(found, True)])
        return found

    def _stage(self, op: _Staged) -> None:
        if self._tx is not None:
            self._tx.append(op)
            return
        with self._lock:
            self._commit([op])

    # -- transactions ----------------------------------------------------------

    def tx_begin(self) -> None:
        """Take the writer lock and pin the version that reads inside the transaction see."""
        if self._tx is not None:
            raise TransactionError("a transaction is active")
        self._lock.acquire()
        try:
            self.refresh()
        except BaseException:
            self._lock.release()
            raise
        self._tx = []

    def tx_commit(self) -> None:
        if self._tx is None:
            raise TransactionError("no transaction is active")
        ops, self._tx = self._tx, None
        try:
            self._commit(ops)
        finally:
            self._lock.release()

    def tx_rollback(self) -> None:
        if self._tx is None:
            raise TransactionError("no transaction is active")
        self._tx = None
        self._lock.release()

    @contextlib.contextmanager
    def transaction(self):
        self.tx_begin()
        try:
            yield self
        except BaseException:
            self.tx_rollback()
            raise
        self.tx_commit()

    def _commit(self, ops: Sequence[_Staged]) -> None:
        """Write every operation, then swap the manifest once."""
        if not ops:
            return
        m = self._store.load()
        new = m.copy()
        new.version += 1
        new.schema = self._wider(m)
        seg, written = new.active, []
        try:
            for op in ops:
                df = op.df
                if op.order_by:
                    df = df.orderBy(*op.order_by)
                # indexes rise with the partition number and, inside it, with the row: after a
                # range sort that is the sort order, and no shuffle is needed to number rows
                at = F.monotonically_increasing_id()
                row, task = at.bitwiseAND((1 << 33) - 1), F.shiftright(at, 33)
                df = df.select(F.lit(seg.number).alias(SEG), (F.shiftleft(task, TASK_BITS) + row + F.lit(seg.next_idx)).alias(IDX), F.lit(op.tombstone).alias(TOMB), *self.config.schema.names, row.alias("__row"))
                path = self._store.new_data_path()
                written.append(path)
                seen = Observation()  # counted while writing: no second pass
                df.observe(seen, F.max(IDX).alias("top"), F.count(F.lit(1)).alias("n"), F.max("__row").alias("row")).drop("__row").write.parquet(path)
                top, n = seen.get["top"], seen.get["n"]
                if n and (top >= MAX_INDEX or seen.get["row"] >> TASK_BITS):
                    raise StorageError(f"a commit may have {MAX_INDEX >> TASK_BITS} tasks of {1 << TASK_BITS} rows")
                seg.data.append(os.path.basename(path))
                if op.mark is not None:
                    new.marks[op.mark[0]] = op.mark[1]
                if n:
                    seg.next_idx, seg.rows, seg.compacted = top + 1, seg.rows + n, False
                if seg.next_idx >= MAX_INDEX >> 1:
                    seg = Segment(seg.number + 1)
                    new.segments.append(seg)
            self._store.publish(new, m.version)
        except BaseException:
            for p in written:
                shutil.rmtree(p, ignore_errors=True)
            raise
        self._pinned = new

    def _wider(self, m: Manifest) -> dict:
        stored = T.StructType.fromJson(m.schema)
        return (self.config.schema if len(self.config.schema) > len(stored) else stored).jsonValue()

    # -- maintenance -----------------------------------------------------------

    def maintain(self) -> bool:
        """Compact the active segment and start a new one once it holds ``segment_rows`` rows."""
        with self._lock:
            m = self._store.load()
            if m.active.rows < self.config.segment_rows:
                return False
            self._compact(m, [m.active])
            return True

    def rotate_and_compact(self) -> None:
        with self._lock:
            m = self._store.load()
            self._compact(m, [m.active])

    def compact_all(self) -> None:
        """Merge every segment into one; only then can tombstones be dropped."""
        with self._lock:
            m = self._store.load()
            self._compact(m, m.segments)

    def _compact(self, m: Manifest, segs: Sequence[Segment]) -> None:
        whole = len(segs) == len(m.segments)
        part = Manifest(m.version, m.schema, m.primary_key, m.secondary_keys, list(segs))
        # the data keeps fields that a narrower client does not know
        schema = T.StructType.fromJson(self._wider(m))
        wide = LogTable(self.spark, _with_schema(self.config, schema), self._store, part)
        rows = state.latest(wide._view(part), keep_tombstones=not whole).orderBy(m.primary_key)  # files cover key ranges, so that lookups skip them
        path = self._store.new_data_path()
        new = m.copy()
        new.version += 1
        try:
            rows.write.parquet(path)
            n = self.spark.read.parquet(path).count()
            last = segs[-1]
            kept = [s for s in new.segments if s.number not in {x.number for x in segs}]
            new.segments = [*kept, Segment(last.number, [os.path.basename(path)], last.next_idx, n, True), Segment(last.number + 1)]
            self._store.publish(new, m.version)
        except BaseException:
            shutil.rmtree(path, ignore_errors=True)
            raise
        self._pinned = new

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete manifests older than the newest ``keep_versions`` and data no kept manifest names."""
        if keep_versions < 1:
            raise ValidationError("keep at least one version")
        with self._lock:
            current = self._store.current_version()
            versions = [v for v in self._store.versions() if v <= current]
            keep = set(versions[-keep_versions:])
            named = {p for v in keep for s in self._store.load(v).segments for p in s.data}
            root = os.path.join(self.config.data_dir, "data")
            gone = [d for d in os.listdir(root) if d not in named]
            for d in gone:
                shutil.rmtree(os.path.join(root, d), ignore_errors=True)
            for v in self._store.versions():
                if v not in keep:
                    os.remove(os.path.join(self.config.data_dir, "manifest", f"v{v:08d}.json"))
            return gone


def _with_schema(config: TableConfig, schema: T.StructType) -> TableConfig:
    from dataclasses import replace

    return replace(config, schema=schema)
