"""Reader for directories of the older binary log format, as a Spark data source.

A segment N is a file ``metadata.N`` that lists (offset, length) pairs and names a data
file of packed rows.  The source yields the change log of this engine: ``_seg``, ``_idx``,
``_tombstone`` and the declared fields.  Segments are cut into ranges of entries, so a
large segment is read by many tasks; each task reads its own part of both files.

    spark.dataSource.register(BinaryLogSource)
    log = spark.read.format("binary_log").schema("id bigint, name string").load(path)

``load_table`` copies such a directory into a :class:`~ledgerloom.table.LogTable`.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.config import IDX, SEG, TOMB
from ledgerloom.errors import ConsistencyError, ValidationError
from ledgerloom.values import Kind, Value, column_kind

# fixed values of the format
VERSION = 1
HEADER = struct.Struct(">B7x16s")
ENTRY = np.dtype([("offset", ">u8"), ("length", ">u8")])
LIVE, DEAD = 0x00, 0xFF
NULL, INT, DECIMAL, STRING, BYTES = 0x0, 0x1, 0x2, 0x3, 0x4

_LONG = struct.Struct(">q")
_SIZE = struct.Struct(">Q")
_DECIMAL = struct.Struct("<IIII")  # sign and scale, then 96 bits from the lowest word up
_SEGMENT = re.compile(r"metadata\.(\d+)")

ENTRIES_PER_TASK = 200_000
_BATCH = 20_000


def encode_decimal(d: Decimal) -> bytes:
    sign, digits, exp = d.as_tuple()
    number = int("".join(map(str, digits)) or "0") * 10 ** max(exp, 0)
    scale = max(-exp, 0)
    if number >= 1 << 96 or scale > 28:
        raise ValidationError(f"{d} does not fit 96 bits and scale 28")
    return _DECIMAL.pack(sign << 31 | scale << 16, *(number >> s & 0xFFFFFFFF for s in (0, 32, 64)))


def decode_decimal(raw: bytes) -> Decimal:
    flags, lo, mid, hi = _DECIMAL.unpack(raw)
    return Decimal((flags >> 31, tuple(map(int, str(hi << 64 | mid << 32 | lo))), -(flags >> 16 & 0xFF)))


def encode_value(v: Any) -> bytes:
    v = Value.of(v)
    match v.kind():
        case Kind.NULL:
            return bytes([NULL])
        case Kind.INT:
            return bytes([INT]) + _LONG.pack(v.payload)
        case Kind.DECIMAL:
            return bytes([DECIMAL]) + encode_decimal(v.payload)
        case Kind.STRING:
            raw, tag = v.payload.encode(), STRING
        case _:
            raw, tag = v.payload, BYTES
    return bytes([tag]) + _SIZE.pack(len(raw)) + raw


def encode_row(values: list[Any], tombstone: bool = False) -> bytes:
    return bytes([DEAD if tombstone else LIVE]) + b"".join(map(encode_value, values))


def decode_row(raw: bytes) -> tuple[bool, list[Any]]:
    """(tombstone, plain values); raises ConsistencyError for what is no row."""
    try:
        at, out = 1, []
        dead = {LIVE: False, DEAD: True}[raw[0]]
        while at < len(raw):
            tag, at = raw[at], at + 1
            if tag == NULL:
                out.append(None)
                continue
            size = 8 if tag == INT else 16 if tag == DECIMAL else None
            if size is None:
                if tag not in (STRING, BYTES):
                    raise ConsistencyError(f"unknown value tag {tag}")
                (size,) = _SIZE.unpack_from(raw, at)
                at += 8
            body = raw[at : at + size]
            if len(body) != size:
                raise ConsistencyError("row ends inside a value")
            at += size
            out.append(_LONG.unpack(body)[0] if tag == INT else decode_decimal(body) if tag == DECIMAL else body.decode() if tag == STRING else body)
        return dead, out
    except (IndexError, KeyError, struct.error, UnicodeDecodeError) as e:
        raise ConsistencyError("unreadable row") from e


def read_header(path: str) -> str:
    """Name of the data file of a metadata file."""
    with open(path, "rb") as f:
        raw = f.read(HEADER.size)
    if len(raw) < HEADER.size:
        raise ConsistencyError(f"{path} has no header")
    version, data = HEADER.unpack(raw)
    if version != VERSION:
        raise ValidationError(f"unsupported metadata version {version}")
    return str(uuid.UUID(bytes=data))


def segments(root: str) -> list[int]:
    return sorted(int(m[1]) for x in os.listdir(root) if (m := _SEGMENT.fullmatch(x)))


class _Range(InputPartition):
    def __init__(self, seg: int, start: int, end: int):
        super().__init__(None)
        self.seg, self.start, self.end = seg, start, end


class BinaryLogReader(DataSourceReader):
    def __init__(self, root: str, schema: T.StructType, from_seg: int, from_idx: int, per_task: int):
        self.root, self.schema, self.from_seg, self.from_idx, self.per_task = root, schema, from_seg, from_idx, per_task
        self.fields = [f for f in schema.fields if f.name not in (SEG, IDX, TOMB)]

    def partitions(self) -> list[_Range]:
        out = []
        for seg in segments(self.root):
            if seg < self.from_seg:
                continue
            path = os.path.join(self.root, f"metadata.{seg}")
            read_header(path)
            # a torn last entry is not yet part of the log
            n = (os.path.getsize(path) - HEADER.size) // ENTRY.itemsize
            first = self.from_idx if seg == self.from_seg else 0
            out += [_Range(seg, a, min(a + self.per_task, n)) for a in range(first, n, self.per_task)]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        meta = os.path.join(self.root, f"metadata.{part.seg}")
        entries = np.fromfile(meta, ENTRY, part.end - part.start, offset=HEADER.size + part.start * ENTRY.itemsize)
        used = np.flatnonzero((entries["offset"] != 0) | (entries["length"] != 0))
        arrow = {f.name: _arrow(f.dataType) for f in self.fields}
        with open(os.path.join(self.root, read_header(meta)), "rb", buffering=1 << 20) as data:
            for lo in range(0, len(used), _BATCH):
                take = used[lo : lo + _BATCH]
                dead, cols = [], [[] for _ in self.fields]
                for i in take.tolist():
                    data.seek(int(entries["offset"][i]))
                    raw = data.read(int(entries["length"][i]))
                    if len(raw) != entries["length"][i]:
                        raise ConsistencyError(f"segment {part.seg}: entry {part.start + i} lies beyond its data file")
                    tomb, values = decode_row(raw)
                    dead.append(tomb)
                    for k, (f, col) in enumerate(zip(self.fields, cols)):
                        v = values[k] if k < len(values) else None  # a missing tail is NULL
                        if v is not None and Value.of(v).kind() is not column_kind(f.dataType):
                            raise ValidationError(f"field {f.name!r} holds {Value.of(v).kind().name}")
                        col.append(v)
                fixed = {SEG: pa.array([part.seg] * len(take), pa.int32()), IDX: pa.array((take + part.start).astype("int64")), TOMB: pa.array(dead)}
                made = fixed | {f.name: pa.array(c, arrow[f.name]) for f, c in zip(self.fields, cols)}
                yield pa.RecordBatch.from_arrays([made[f.name] for f in self.schema.fields], names=self.schema.names)


def _arrow(dt: T.DataType) -> pa.DataType:
    return {Kind.INT: pa.int64(), Kind.STRING: pa.string(), Kind.BYTES: pa.binary()}.get(column_kind(dt)) or pa.decimal128(dt.precision, dt.scale)


class BinaryLogSource(DataSource):
    """Options: path, from_seg, from_idx (start position), entries_per_task."""

    @classmethod
    def name(cls) -> str:
        return "binary_log"

    def schema(self) -> T.StructType:
        raise ValidationError("the format stores no schema; declare one")

    def reader(self, schema: T.StructType) -> BinaryLogReader:
        for f in schema.fields:
            if f.name not in (SEG, IDX, TOMB) and not isinstance(f.dataType, (T.LongType, T.StringType, T.BinaryType, T.DecimalType)):
                raise ValidationError(f"field {f.name!r}: {f.dataType.simpleString()} is not a type of the format")
        opt = lambda k, d: int(self.options.get(k, d))
        return BinaryLogReader(self.options["path"], schema, opt("from_seg", 0), opt("from_idx", 0), opt("entries_per_task", ENTRIES_PER_TASK))


def read_log(spark: SparkSession, path: str, fields: T.StructType, **options: Any) -> DataFrame:
    """The change log of a directory, from a start position if from_seg and from_idx are given."""
    spark.dataSource.register(BinaryLogSource)
    head = [T.StructField(SEG, T.IntegerType()), T.StructField(IDX, T.LongType()), T.StructField(TOMB, T.BooleanType())]
    schema = T.StructType(head + [T.StructField(f.name, f.dataType, True) for f in fields.fields])
    return spark.read.format("binary_log").schema(schema).options(**options).load(str(path))


def load_table(spark: SparkSession, path: str, table) -> None:
    """Upsert the newest live rows of a directory into an open table, in one commit."""
    from ledgerloom.operators.state import LogView, latest

    log = read_log(spark, path, table.config.schema)
    table.upsert_df(latest(LogView(log, table.config.primary_key, order=(SEG, IDX), tombstone=TOMB)), assume_unique=True)


def write_segment(root: str, number: int, rows: list[tuple[list[Any], bool] | None]) -> None:
    """Write rows (values, tombstone) as one segment of the format; None leaves an entry unused."""
    data_id = uuid.uuid4()
    at, entries = 0, np.zeros(len(rows), ENTRY)
    with open(os.path.join(root, str(data_id)), "wb") as f:
        for i, r in enumerate(rows):
            if r is not None:
                raw = encode_row(*r)
                f.write(raw)
                entries[i] = (at, len(raw))
                at += len(raw)
    tmp = os.path.join(root, f".metadata.{number}.tmp")
    with open(tmp, "wb") as f:
        f.write(HEADER.pack(VERSION, data_id.bytes) + entries.tobytes())
    os.replace(tmp, os.path.join(root, f"metadata.{number}"))
