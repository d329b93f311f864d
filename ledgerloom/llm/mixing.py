"""Mixing sources to target shares of tokens.

Weights come from temperature mixing: the natural share q of a source is exponentiated
against its target share t, ``w ~ t * (q / t) ** x`` (uniform targets give the usual
``q ** x``).  x = 0 is the target, x = 1 the natural mixture; x is bisected to the
smallest value at which no source would have to be repeated more often than allowed.
Sources that are over their limit even at x = 0 cannot reach their share: they are pinned to
all they can give, and what they leave open is divided among the others.  The weights times
the budget are realised as block permutations: a block is all documents of a source in an
order of its own, one block per repetition, the last one cut where the budget is spent.

Token counts are sums per source, combined map-side.  Places in a block and the running
token sum that cuts it are taken over hash buckets first and inside a bucket second, so a
source that holds a third of the corpus is spread over ``BUCKETS`` tasks.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern of the vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 4096
#: Distinct space-delimited pieces whose token counts a task remembers.
_MEMORY = 1 << 19


class TokenCounter(dict):
    """Token count of a piece of text; whole texts are cut at single spaces.

    A pre-token takes at most one space, and takes it in front, so a text without
    double spaces has exactly the pre-tokens of its pieces " word".
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self._encode(piece))
        if len(self) >= _MEMORY:
            self.clear()
        if len(piece) < 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if "  " in text:
            return len(self._encode(text))
        first, *rest = text.split(" ")
        return (self[first] if first else 0) + sum(map(self.__getitem__, [" " + p for p in rest]))


_counters: dict[str, TokenCounter] = {}


def _counter(path: str) -> TokenCounter:
    if path not in _counters:
        sent = SparkFiles.get(os.path.basename(path))
        _counters[path] = TokenCounter(sent if os.path.exists(sent) else path)
    return _counters[path]


def n_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of a text; NULL has none.  The driver sends the vocabulary to the executors."""
    sc = SparkSession.active().sparkContext
    if os.path.abspath(path) not in map(os.path.abspath, (f.removeprefix("file:") for f in sc.listFiles)):
        sc.addFile(path)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = _counter(path)
        for s in batches:
            yield pd.Series([c.count(t) if t else 0 for t in s], dtype="int64")

    return F.pandas_udf(count, "bigint")(text)


@dataclass(frozen=True)
class SourcePlan:
    source: str
    tokens: int
    target: float
    max_repeat: int
    weight: float
    amount: float
    reachable: bool


def weights(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None = None, rounds: int = 60) -> list[SourcePlan]:
    """Weights of the sources in ``targets`` {source: (share, max_repeat)}; they sum to at most 1.

    A source is reachable if all its tokens times max_repeat are not fewer than its
    share of the budget, by default the tokens of all documents, of unlisted sources
    too.  Sums below 1 occur only if no source has anything left to give.
    """
    budget = sum(tokens.values()) if budget is None else budget
    most = {s: tokens.get(s, 0) * max(0, r) for s, (_, r) in targets.items()}
    if not budget:
        return [SourcePlan(s, tokens.get(s, 0), t, r, 0.0, 0.0, True) for s, (t, r) in targets.items()]
    w: dict[str, float] = {}
    open_share = 1.0
    free = {s: t for s, (t, _) in targets.items() if t > 0}
    # exponent 0 asks every source for its share: who cannot give it is pinned
    short = {s for s, t in free.items() if t * budget > most[s]}
    for s in short:
        w[s] = most[s] / budget
        open_share -= w[s]
        del free[s]
    while free and open_share > 1e-12:
        total = sum(tokens[s] for s in free)

        def tilted(x: float) -> dict[str, float]:
            raw = {s: t * (tokens[s] / total / t) ** x for s, t in free.items()}
            return {s: v * open_share / sum(raw.values()) for s, v in raw.items()}

        fits = lambda x: all(v * budget <= most[s] * (1 + 1e-12) for s, v in tilted(x).items())
        lo, hi = 0.0, 1.0
        if fits(lo):
            hi = lo
        elif fits(hi):
            for _ in range(rounds):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if fits(mid) else (mid, hi)
        else:  # even the natural mixture repeats something too often: pin what is over, tilt the rest
            over = [s for s, v in tilted(1.0).items() if v * budget > most[s]]
            for s in over:
                w[s] = most[s] / budget
                open_share -= w[s]
                del free[s]
            continue
        w |= tilted(hi)
        break
    return [SourcePlan(s, tokens.get(s, 0), t, r, w.get(s, 0.0), w.get(s, 0.0) * budget, s not in short) for s, (t, r) in targets.items()]


def sized(documents: DataFrame, doc_id: str, source: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), one row per document; a document delivered again counts once.

    If its deliveries disagree, the longest text counts, under its least source.
    Documents without id or source take no part, a NULL text has no tokens.
    """
    d = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_tokens(F.col(text), path).alias("tokens"))
    return d.where("doc_id IS NOT NULL AND source IS NOT NULL").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """{source: (target_share, max_repeat)}: one row per source, read by the driver.  NULLs mean 0."""
    return {r[0]: (r[1] or 0.0, r[2] or 0) for r in targets.select("source", "target_share", "max_repeat").where("source IS NOT NULL").distinct().collect()}


def plan(sizes: DataFrame, targets: dict[str, tuple[float, int]]) -> list[SourcePlan]:
    totals = {r[0]: r[1] for r in sizes.groupBy("source").agg(F.sum("tokens")).collect()}
    return weights(totals, targets)


def plan_frame(spark, plans: Sequence[SourcePlan]) -> DataFrame:
    rows = [(p.source, p.tokens, p.target, p.max_repeat, p.weight, p.reachable) for p in plans]
    return spark.createDataFrame(rows, "source string, tokens bigint, target_share double, max_repeat int, weight double, reachable boolean")


def realise(sizes: DataFrame, plans: Sequence[SourcePlan], seed: int = 0) -> DataFrame:
    """The mixture: (doc_id, source, tokens, block, position), one row per use of a document.

    A source with a budget of b tokens gives floor(b / tokens) whole blocks and, of one
    more, the first documents as long as they fit into the rest.  Every block has an order
    of its own; positions count from 0.  A document stands in a block once at most, so
    it is used as often as its source has blocks, never more than max_repeat times.
    """
    spark = sizes.sparkSession
    rows = []
    for p in plans:
        b = p.amount + 1e-6
        whole = min(int(b // p.tokens) if p.tokens else 0, p.max_repeat)
        rows.append((p.source, whole, b - whole * p.tokens if whole < p.max_repeat else -1.0))
    per = spark.createDataFrame(rows, "source string, whole int, rest double")
    # one row per source: bounded by the target table that the driver read
    d = sizes.join(F.broadcast(per), "source").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    d = d.where("block < whole OR rest >= 0").withColumn("h", F.xxhash64("doc_id", "block", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    of = ["source", "block"]
    along = Window.partitionBy(*of).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*of, "bucket").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    before = lambda c: F.coalesce(F.sum(c).over(along), F.lit(0))
    starts = sums.select(*of, "bucket", before("t").alias("t_start"), before("n").alias("n_start"))
    inside = Window.partitionBy(*of, "bucket").orderBy("h", "doc_id")
    upto = F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"upto": upto, "at": F.row_number().over(inside) - 1}).join(starts, [*of, "bucket"])
    d = d.where((F.col("block") < F.col("whole")) | (F.col("t_start") + F.col("upto") <= F.col("rest")))
    return d.select("doc_id", "source", "tokens", "block", (F.col("n_start") + F.col("at")).alias("position"))


def shares(mixture: DataFrame, plans: Sequence[SourcePlan]) -> DataFrame:
    """Target, planned and actual share, tokens and documents of every source."""
    got = mixture.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count_if(F.col("block") == 0).alias("n_docs"), (F.max("block") + 1).alias("most_copies"))
    out = plan_frame(mixture.sparkSession, plans).join(got, "source", "left").fillna(0, ["mixed_tokens", "n_docs", "most_copies"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # one row per source
    return out.withColumn("actual_share", F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0))
