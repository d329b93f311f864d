"""Latest-row-per-key views over a change log.

The log is any DataFrame with ordering columns, an optional tombstone column and a
key column.  ``row_number() = 1`` is planned by Catalyst as a partial and a final
``WindowGroupLimit``: every map task keeps one row per key before the shuffle, so
a key that holds a third of the log sends one row per map task, not its history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.errors import ValidationError
from ledgerloom.values import Kind, Value, column_kind, equals, in_range

_RN = "__rn"


@dataclass(frozen=True)
class LogView:
    """A change log and how to read it.

    ``unique`` states that every key occurs once (a compacted snapshot): the
    latest-per-key step, and its shuffle, are then left out.
    """

    df: DataFrame
    pk: str
    sks: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    tombstone: str | Column | None = None
    unique: bool = False
    allow_scan: bool = field(default=False)

    def kind_of(self, name: str) -> Kind | None:
        return column_kind(self.df.schema[name].dataType)

    def check_field(self, name: str) -> None:
        if name not in self.df.columns:
            raise ValidationError(f"no field {name!r}")
        if name != self.pk and name not in self.sks and not self.allow_scan:
            raise ValidationError(f"field {name!r} is not a key; pass allow_scan=True to scan for it")


def _tomb(view: LogView) -> Column | None:
    if view.tombstone is None:
        return None
    return F.col(view.tombstone) if isinstance(view.tombstone, str) else view.tombstone


def latest(view: LogView, keep_tombstones: bool = False, before: Column | None = None) -> DataFrame:
    """Newest row of every key; NULL is a key like any other.

    ``before`` restricts the log ahead of the dedup and may mention the key and
    the order columns only: anything else would bring superseded rows back.
    An empty log gives no rows.  Ties in the order columns are broken arbitrarily
    but a log position is unique by construction.
    """
    df = view.df if before is None else view.df.where(before)
    if not view.unique:
        if not view.order:
            raise ValidationError("a log with repeated keys needs order columns")
        w = Window.partitionBy(view.pk).orderBy(*[F.col(c).desc() for c in view.order])
        df = df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)
    t = _tomb(view)
    return df if t is None or keep_tombstones else df.where(~F.coalesce(t, F.lit(False)))


def state_as_of(view: LogView, before: Column) -> DataFrame:
    """State that a prefix of the log describes."""
    return latest(view, before=before)


def secondary_index(view: LogView, sk: str, log_key: str) -> DataFrame:
    """(sk, pk, log_key) of the live rows: the clean secondary index."""
    return latest(view).select(F.col(sk).alias("sk"), F.col(view.pk).alias("pk"), F.col(log_key).alias("log_key"))


def secondary_index_append_only(view: LogView, sk: str, log_key: str) -> DataFrame:
    """Newest position of each (sk, pk) pair ever written, superseded pairs included."""
    return view.df.groupBy(F.col(sk).alias("sk"), F.col(view.pk).alias("pk")).agg(F.max(log_key).alias("log_key"))


def _ordered(df: DataFrame, cols: Sequence[str], asc: bool, offset: int, limit: int | None) -> DataFrame:
    if offset < 0 or (limit is not None and limit < 0):
        raise ValidationError("offset and limit must not be negative")
    ordered = df.orderBy(*[F.col(c).asc() if asc else F.col(c).desc() for c in cols])
    if limit is not None:
        return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)
    if not offset:
        return ordered
    # everything behind a place: a bare offset would draw all rows into one task, so the key
    # at the place is looked up (a top-k of keys) and the rows behind it are filtered
    types = [df.schema[c].dataType for c in cols]
    edge = ordered.select(*cols).offset(offset - 1).limit(1).collect()
    if not edge:
        return df.limit(0)
    at, key = F.struct(*[F.lit(v).cast(t) for v, t in zip(edge[0], types)]), F.struct(*cols)
    return df.where(key > at if asc else key < at).orderBy(*[F.col(c).asc() if asc else F.col(c).desc() for c in cols])


def _present(df: DataFrame, view: LogView, order: str, asc: bool, tag: str | None = None) -> DataFrame:
    if order == "key":
        return df
    if order != "log" or not view.order:
        raise ValidationError(f"unknown presentation order {order!r}")
    cols = [*view.order[:1], *([tag] if tag else []), *view.order[1:]]
    return df.orderBy(*[F.col(c).asc() if asc else F.col(c).desc() for c in cols])


def find_by(view: LogView, name: str, value, *, offset: int = 0, limit: int | None = None, sort_asc: bool = True, order: str = "key", sort: bool = False) -> DataFrame:
    """Rows whose key ``name`` equals ``value``; paging follows primary-key order.

    A primary-key predicate runs before the dedup and reaches the Parquet scan; a
    secondary-key predicate must run after it.  Without paging the result is not
    sorted unless ``sort`` asks for it: a sort is a shuffle nobody may need.
    """
    v = Value.of(value).as_indexable()
    view.check_field(name)
    cond = equals(F.col(name), view.df.schema[name].dataType, v)
    df = latest(view, before=cond) if name == view.pk else latest(view).where(cond)
    if sort or offset or limit is not None:
        df = _ordered(df, [view.pk], sort_asc, offset, limit)
    return _present(df, view, order, sort_asc)


def batch_find_by(view: LogView, name: str, values: Sequence, *, offset: int = 0, limit: int | None = None, sort_asc: bool = True, tag: str = "tag", order: str = "key", sort: bool = False, inline_keys: int = 1000) -> DataFrame:
    """One row per (ordinal in ``values``, matching row); repeated keys repeat their rows.

    Up to ``inline_keys`` primary keys also become a pushed-down IN filter on the
    log.  The keys come from the driver, so their number is known: up to the same
    bound they are broadcast, beyond it Spark is free to shuffle both sides.
    """
    vs = [Value.of(v).as_indexable() for v in values]
    view.check_field(name)
    if tag in view.df.columns:
        raise ValidationError(f"tag column {tag!r} clashes with a field")
    dt = view.df.schema[name].dataType
    kind = column_kind(dt)
    keyed = [(i, v.payload) for i, v in enumerate(vs) if v.kind() is Kind.NULL or v.kind() is kind]
    spark = view.df.sparkSession
    key = "__key"
    key_type = f"decimal({dt.precision},{dt.scale})" if kind is Kind.DECIMAL else "bigint" if kind is Kind.INT else dt.simpleString()
    if kind is Kind.DECIMAL:  # a key that does not fit the column's scale cannot be stored in it
        keyed = [(i, p) for i, p in keyed if p is None or fits(p, dt)]
    keys = spark.createDataFrame(keyed, f"{tag} int, {key} {key_type}")
    before = None
    if name == view.pk and len(keyed) <= inline_keys:
        plain = list(dict.fromkeys(p for _, p in keyed if p is not None))
        before = F.col(name).isin(plain) if plain else F.lit(False)
        if any(p is None for _, p in keyed):
            before = before | F.col(name).isNull()
    rows = latest(view, before=before)
    if len(keyed) <= inline_keys:
        keys = F.broadcast(keys)
    df = rows.join(keys, F.col(name).eqNullSafe(F.col(key))).drop(key)
    df = df.select(tag, *view.df.columns)
    if sort or offset or limit is not None:
        df = _ordered(df, [tag, view.pk], sort_asc, offset, limit)
    return _present(df, view, order, sort_asc, tag)


def fits(p, dt) -> bool:
    """Whether a Decimal can be stored in decimal(p, s) without rounding."""
    _, digits, exp = p.normalize().as_tuple()
    scale = max(0, -exp)
    return scale <= dt.scale and len(digits) + exp <= dt.precision - dt.scale


def range_by(view: LogView, name: str, lo, hi, *, offset: int = 0, limit: int | None = None, sort_asc: bool = True, order: str = "key", sort: bool = False) -> DataFrame:
    """Rows whose key lies between two bounds; paging follows (key, primary key) order."""
    view.check_field(name)
    cond = in_range(F.col(name), view.df.schema[name].dataType, lo, hi)
    df = latest(view, before=cond) if name == view.pk else latest(view).where(cond)
    if sort or offset or limit is not None:
        df = _ordered(df, list(dict.fromkeys([name, view.pk])), sort_asc, offset, limit)
    return _present(df, view, order, sort_asc)


def newest(view: LogView, by: str, n: int) -> DataFrame:
    """The n rows with the greatest ``by``: a distributed top-k."""
    df = latest(view)
    return df.orderBy(*[F.col(c).desc() for c in dict.fromkeys([by, view.pk])]).limit(n)


def overlay(base: LogView, changes: DataFrame, tombstones: DataFrame | None = None) -> LogView:
    """A log made of a base snapshot, then changed rows, then deletions by key."""
    cols = base.df.columns
    gen, dead = "__gen", "__dead"
    parts = base.df.select(*cols, F.lit(0).alias(gen), F.lit(False).alias(dead))
    parts = parts.unionByName(changes.select(*cols, F.lit(1).alias(gen), F.lit(False).alias(dead)))
    if tombstones is not None:
        rest = [F.lit(None).cast(base.df.schema[c].dataType).alias(c) for c in cols if c != base.pk]
        parts = parts.unionByName(tombstones.select(F.col(base.pk), *rest, F.lit(2).alias(gen), F.lit(True).alias(dead)))
    return LogView(parts, base.pk, base.sks, (gen, *base.order), dead)


def live(view: LogView) -> DataFrame:
    """Latest live rows without the helper columns of :func:`overlay`."""
    return latest(view).drop("__gen", "__dead")
