"""Keys whose kind varies from row to row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.values import RANK, Kind, Value

#: A mixed-kind key: rank of the kind, then the payload of that kind.
TAGGED = "struct<rank:int,i:bigint,d:decimal(38,10),s:string>"


def tagged(i: Column | None = None, d: Column | None = None, s: Column | None = None) -> Column:
    """First non-null of int, decimal, string as a struct that sorts NULL < int < decimal < string."""
    none = F.lit(None)
    i, d, s = (none if c is None else c for c in (i, d, s))
    rank = F.when(i.isNotNull(), RANK[Kind.INT]).when(d.isNotNull(), RANK[Kind.DECIMAL]).when(s.isNotNull(), RANK[Kind.STRING]).otherwise(RANK[Kind.NULL])
    taken = lambda c, kind: F.when(rank == RANK[kind], c)
    return F.struct(rank.alias("rank"), taken(i, Kind.INT).cast("bigint").alias("i"), taken(d, Kind.DECIMAL).cast("decimal(38,10)").alias("d"), taken(s, Kind.STRING).cast("string").alias("s")).cast(TAGGED)


def tagged_literal(v: Value) -> Column:
    v = Value.of(v).as_indexable()
    lit = None if v.payload is None else F.lit(v.payload)
    return tagged(**{{Kind.INT: "i", Kind.DECIMAL: "d", Kind.STRING: "s"}[v.kind()]: lit} if lit is not None else {})


def pack_position(seg: Column, idx: Column) -> Column:
    """16-bit segment and 48-bit index as one ordered BIGINT (segments below 2^15)."""
    return F.shiftleft(seg.cast("bigint"), 48).bitwiseOR(idx)


def unpack_position(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 48).cast("int"), key.bitwiseAND((1 << 48) - 1)
