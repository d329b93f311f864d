"""Ordered replay of a change feed of inserts, updates and deletes.

Entries may be repeated and out of order; their sequence number, not their
arrival, decides.  The replay runs twice with the same state machine:

* inside every input partition, over rows sorted by (key, sequence), so a key that
  holds a third of the feed leaves each map task as one folded state;
* after the one shuffle, repartitioned by key and sorted by (key, sequence), over
  the folded states.

The folded state of a key is: the last removal, the last live entry and, per
column, the value with the sequence that set it.  Folding it is associative and
idempotent, so the split between the two passes never shows, and a saved state
can be given back as ``base`` to continue from.  A partition is streamed in Arrow
batches; memory holds one batch and one open state, never a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import ValidationError

#: Sequence that stands for "never".
NEVER = -(2**63)
RESET, LIVE, FIRST = "__reset_seq", "__live_seq", "__seq"


def _set_by(c: str) -> str:
    return f"__set_{c}"


def _groups(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Start of each run of equal keys; NULL equals NULL."""
    n = t.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        codes = pc.fill_null(t[k].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _fold(t: pa.Table, keys: Sequence[str], values: Sequence[str]) -> pa.Table:
    """One state per run of equal keys in a table of states."""
    starts = _groups(t, keys)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
    num = lambda c: t[c].to_numpy()
    reset = np.maximum.reduceat(num(RESET), starts)
    out = {k: t[k].take(pa.array(starts)) for k in keys}
    out[FIRST] = pa.array(np.minimum.reduceat(num(FIRST), starts))
    out[RESET] = pa.array(reset)
    out[LIVE] = pa.array(np.maximum.reduceat(num(LIVE), starts))
    for c in values:
        at = num(_set_by(c))
        at = np.where(at > reset[group], at, NEVER)  # what a later removal wiped out
        best = np.maximum.reduceat(at, starts)
        hit = np.flatnonzero((at == best[group]) & (at != NEVER))
        first = np.full(len(starts), -1)
        g = group[hit]
        lead = np.append(True, g[1:] != g[:-1]) if len(hit) else np.zeros(0, bool)
        if not lead.all():  # same sequence, set more than once: the smallest value, NULL last
            hit = hit[np.lexsort((_ranks(t[c].take(pa.array(hit))), g))]
        first[g[lead]] = hit[lead]
        out[c] = t[c].take(pa.array(first, mask=first < 0))
        out[_set_by(c)] = pa.array(best)
    return pa.table(out).select(t.column_names)


def _ranks(values: pa.ChunkedArray) -> np.ndarray:
    """Ascending ranks of values, NULL last; of any type that can be ordered, others by their text."""
    if pa.types.is_nested(values.type) or pa.types.is_dictionary(values.type):
        values = pa.chunked_array([pa.array([None if v is None else repr(v) for v in values.to_pylist()], pa.string())])
    return pc.rank(values, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()


def _machine(keys: Sequence[str], values: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_state: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if open_state is not None:
                t = pa.concat_tables([open_state.cast(t.schema), t])
            t = _fold(t, keys, values)
            open_state = t.slice(t.num_rows - 1)
            yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
        if open_state is not None:
            yield from open_state.combine_chunks().to_batches()

    return run


def replay(feed: DataFrame, keys: Sequence[str], seq: Column, tombstone: Column, values: Sequence[str], *, partial: bool = False, base: DataFrame | None = None) -> DataFrame:
    """State of every key the feed mentions: keys, values and the bookkeeping columns.

    ``seq`` is a BIGINT that orders the entries of a key.  With ``partial`` a NULL
    value leaves a column as it was; otherwise an entry sets every column, NULL
    included.  A NULL tombstone means live.  Entries without a sequence cannot be
    ordered and are left out.  Keys may be NULL and are compared null-safely.
    An entry at a sequence that was applied before changes nothing; if two entries
    of a key with one sequence disagree, a removal wins over values, and a smaller
    value over a greater one.  ``base`` is an earlier result of this function.
    An empty feed gives the base; columns not named here are ignored.
    """
    names = [*keys, *values]
    if clash := [c for c in names if c.startswith("__")] or (len({c.lower() for c in names}) < len(names) and names):
        raise ValidationError(f"column names clash: {clash}")
    dead = F.coalesce(tombstone.cast("boolean"), F.lit(False))
    never = F.lit(NEVER).cast("bigint")
    src = feed.select(*[F.col(c) for c in names], seq.cast("bigint").alias(FIRST), dead.alias("__dead")).where(F.col(FIRST).isNotNull())
    set_when = lambda c: ~F.col("__dead") & F.col(c).isNotNull() if partial else ~F.col("__dead")
    states = src.select(
        *keys,
        FIRST,
        F.when(F.col("__dead"), F.col(FIRST)).otherwise(never).alias(RESET),
        F.when(~F.col("__dead"), F.col(FIRST)).otherwise(never).alias(LIVE),
        *[x for c in values for x in (F.when(~F.col("__dead"), F.col(c)).alias(c), F.when(set_when(c), F.col(FIRST)).otherwise(never).alias(_set_by(c)))],
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in states.schema.fields])
    machine = _machine(list(keys), list(values))
    order = [*keys, FIRST]
    folded = states.sortWithinPartitions(*order).mapInArrow(machine, schema)
    if base is not None:
        folded = folded.unionByName(base.select(*schema.names))
    return folded.repartition(*keys).sortWithinPartitions(*order).mapInArrow(machine, schema)


def live_rows(state: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Records that exist: keys, values and ``_set_seq``, the last live entry's sequence."""
    return state.where(F.col(LIVE) > F.col(RESET)).select(*keys, *values, F.col(LIVE).alias("_set_seq"))
