"""Typed values, range bounds and their translation to Catalyst predicates.

Equality is strict by kind and ``NULL`` equals ``NULL``; the order over kinds is
NULL < INT < DECIMAL < STRING.  A comparison between a bound and a column of
another kind is decided here, before any ``Column`` is built, so that Spark
never coerces (and, in ANSI mode, never raises).
"""

from __future__ import annotations

import enum
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import ValidationError


class Kind(enum.IntEnum):
    """Kind codes as the public API reports them."""

    INT = 0
    DECIMAL = 1
    STRING = 2
    BYTES = 3
    NULL = 4


#: Position of each kind in the total order of keys; BYTES cannot be a key.
RANK = {Kind.NULL: 0, Kind.INT: 1, Kind.DECIMAL: 2, Kind.STRING: 3}


@dataclass(frozen=True)
class Value:
    """One typed value; equality compares kind and payload."""

    _kind: Kind
    payload: Any

    @staticmethod
    def int(v: int) -> Value:
        if isinstance(v, bool) or not -(2**63) <= v < 2**63:
            raise ValueError(f"not a 64-bit integer: {v!r}")
        return Value(Kind.INT, v)

    @staticmethod
    def decimal(v: str | Decimal) -> Value:
        try:
            d = Decimal(v)
        except InvalidOperation as e:
            raise ValueError(f"not a decimal: {v!r}") from e
        if not d.is_finite():
            raise ValueError(f"not a finite decimal: {v!r}")
        return Value(Kind.DECIMAL, d)

    @staticmethod
    def string(v: str) -> Value:
        return Value(Kind.STRING, str(v))

    @staticmethod
    def bytes(v: bytes) -> Value:
        return Value(Kind.BYTES, bytes(v))

    @staticmethod
    def null() -> Value:
        return Value(Kind.NULL, None)

    @staticmethod
    def of(v: Any) -> Value:
        """Wrap a plain Python value; a :class:`Value` passes through."""
        if isinstance(v, Value):
            return v
        if v is None:
            return Value.null()
        if isinstance(v, bool):
            raise ValidationError("booleans are not a value kind")
        if isinstance(v, int):
            return Value.int(v)
        if isinstance(v, Decimal):
            return Value.decimal(v)
        if isinstance(v, str):
            return Value.string(v)
        if isinstance(v, (bytes, bytearray, memoryview)):
            return Value.bytes(bytes(v))
        raise ValidationError(f"unsupported value: {v!r}")

    def kind(self) -> Kind:
        return self._kind

    def _as(self, kind: Kind) -> Any:
        if self._kind is not kind:
            raise ValidationError(f"value is {self._kind.name}, not {kind.name}")
        return self.payload

    def as_int(self) -> int:
        return self._as(Kind.INT)

    def as_decimal(self) -> str:
        return str(self._as(Kind.DECIMAL))

    def as_string(self) -> str:
        return self._as(Kind.STRING)

    def as_bytes(self) -> bytes:
        return self._as(Kind.BYTES)

    def as_null(self) -> None:
        return self._as(Kind.NULL)

    def as_indexable(self) -> Value:
        if self._kind is Kind.BYTES:
            raise ValidationError("a BYTES value cannot be a key")
        return self

    def __repr__(self) -> str:
        return f"Value.{self._kind.name.lower()}({'' if self.payload is None else repr(self.payload)})"


def order_key(v: Value) -> tuple:
    """Sort key of an indexable value in the total order over kinds."""
    v.as_indexable()
    return (RANK[v.kind()], 0 if v.payload is None else v.payload.encode() if v.kind() is Kind.STRING else v.payload)


@dataclass(frozen=True)
class Bound:
    """One end of a range."""

    how: str
    value: Value | None = None

    @staticmethod
    def unbounded() -> Bound:
        return Bound("unbounded")

    @staticmethod
    def included(v: Any) -> Bound:
        return Bound("included", Value.of(v).as_indexable())

    @staticmethod
    def excluded(v: Any) -> Bound:
        return Bound("excluded", Value.of(v).as_indexable())


def column_kind(dt: T.DataType) -> Kind | None:
    """Kind stored by a column type; None for types that are carried as payload only."""
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return Kind.INT
    if isinstance(dt, T.DecimalType):
        return Kind.DECIMAL
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return Kind.STRING
    if isinstance(dt, T.BinaryType):
        return Kind.BYTES
    return None


def key_literal(v: Value, dt: T.DataType) -> Column:
    """The value as a literal that compares with a column of type dt without touching the column."""
    if v.kind() is Kind.DECIMAL:
        sign, digits, exp = v.payload.as_tuple()
        scale = max(0, -exp)
        precision = max(len(digits) + max(0, exp), scale, 1)
        if precision > 38:
            raise ValidationError(f"decimal needs {precision} digits, 38 at most")
        return F.lit(v.payload).cast(T.DecimalType(precision, scale))
    if v.kind() is Kind.INT:
        return F.lit(v.payload).cast("bigint")
    return F.lit(v.payload)


def equals(col: Column, dt: T.DataType, v: Value) -> Column:
    """Null-safe, kind-strict equality."""
    v.as_indexable()
    if v.kind() is Kind.NULL:
        return col.isNull()
    if v.kind() is not column_kind(dt) and not _payload_key(dt):
        return F.lit(False)
    # a plain equality on a non-null literal is what Parquet can push down
    return col == key_literal(v, dt)


def _payload_key(dt: T.DataType) -> bool:
    return column_kind(dt) is None


def check_range(lo: Bound, hi: Bound) -> None:
    """Inverted ranges, and equal ends that are both excluded, are errors."""
    if lo.value is None or hi.value is None:
        return
    a, b = order_key(lo.value), order_key(hi.value)
    if a > b or (a == b and lo.how == hi.how == "excluded"):
        raise ValidationError("range start lies beyond its end")


def in_range(col: Column, dt: T.DataType, lo: Bound, hi: Bound) -> Column:
    """Range predicate in the total order, in which NULL is lowest."""
    check_range(lo, hi)
    kind = column_kind(dt)
    if kind is Kind.BYTES:
        raise ValidationError("binary columns cannot be keys")
    rank = RANK.get(kind, RANK[Kind.STRING])
    null_low = lo.how == "unbounded" or (lo.how == "included" and lo.value.kind() is Kind.NULL)
    # lower end; None stands for "no condition"
    if null_low:
        low = None
    elif lo.value.kind() is Kind.NULL or RANK[lo.value.kind()] < rank:
        low = col.isNotNull()
    elif RANK[lo.value.kind()] > rank:
        return F.lit(False)
    else:
        lit = key_literal(lo.value, dt)
        low = col >= lit if lo.how == "included" else col > lit
    # upper end
    if hi.how == "unbounded":
        high = None
    elif hi.value.kind() is Kind.NULL:
        high = col.isNull() if hi.how == "included" and null_low else F.lit(False)
    elif RANK[hi.value.kind()] < rank:
        high = col.isNull() if null_low else F.lit(False)
    elif RANK[hi.value.kind()] > rank:
        high = None
    else:
        lit = key_literal(hi.value, dt)
        high = col <= lit if hi.how == "included" else col < lit
        if null_low:
            high = high | col.isNull()
    if low is None and high is None:
        return F.lit(True)
    return high if low is None else low if high is None else low & high
