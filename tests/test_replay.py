import random

from pyspark.sql import functions as F

from ledgerloom.operators.replay import live_rows, replay
from tests.conftest import rows

DDL = "k string, seq bigint, dead boolean, a string, b bigint, raw binary, other string"
COLS = ["a", "b", "raw"]


def run(df, partial=False, base=None):
    return replay(df, ["k"], F.col("seq"), F.col("dead"), COLS, partial=partial, base=base)


def brute(entries, partial):
    state = {}
    seen = set()
    for k, seq, dead, a, b, raw, _ in sorted((e for e in entries if e[1] is not None), key=lambda e: e[1]):
        if (k, seq) in seen:
            continue
        seen.add((k, seq))
        if dead:
            state.pop(k, None)
            continue
        old = state.get(k, (None, None, None, None))
        new = [n if n is not None or not partial else o for n, o in zip((a, b, raw), old)]
        state[k] = (*new, seq)
    return [(k, *v) for k, v in state.items()]


def feed(seed, n=800):
    rng = random.Random(seed)
    out = []
    for seq in rng.sample(range(n * 2), n):
        k = rng.choice(["hot"] * 6 + ["x", "y", None, ""])
        out.append((k, seq, rng.random() < 0.15 or None, rng.choice([None, "p", "q", ""]), rng.choice([None, 2**60 + seq]), rng.choice([None, b"", b"\x01"]), "z"))
    return out + rng.sample(out, 60)


def test_against_brute_force(spark):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    for partial in (False, True):
        entries = feed(5 + partial)
        random.Random(1).shuffle(entries)
        df = spark.createDataFrame(entries, DDL).repartition(6)
        got = live_rows(run(df, partial), ["k"], COLS)
        want = sorted(((k, a, b, None if raw is None else bytearray(raw), s) for k, a, b, raw, s in brute(entries, partial)), key=key)
        assert rows(got) == want


def test_incremental_equals_whole_and_is_idempotent(spark):
    entries = feed(9)
    df = spark.createDataFrame(entries, DDL)
    first, second = df.where("seq % 3 = 0"), df.where("seq % 3 <> 0")
    whole = rows(run(df, True))
    once = run(second, True, base=run(first, True))
    assert rows(once) == whole
    assert rows(run(second, True, base=once)) == whole


def test_ties_nulls_and_empty(spark):
    e = [("k", 1, False, "b", 1, None, ""), ("k", 1, False, "a", 1, None, ""), ("d", 4, True, None, None, None, ""), ("d", 4, False, "x", 1, None, ""), ("n", None, False, "x", 1, None, "")]
    df = spark.createDataFrame(e, DDL)
    assert rows(live_rows(run(df), ["k"], COLS)) == [("k", "a", 1, None, 1)]
    assert rows(live_rows(run(df.repartition(5)), ["k"], COLS)) == [("k", "a", 1, None, 1)]
    assert run(df.limit(0)).count() == 0


def test_repeated_sequences_fold_in_linear_time():
    import time

    import pyarrow as pa

    from ledgerloom.operators.replay import NEVER, _fold

    n = 80_000
    k = [i // 2 for i in range(n)]
    t = pa.table({"k": k, "__seq": k, "__reset_seq": pa.array([NEVER] * n), "__live_seq": k, "v": [b"%d" % (i % 7) if i % 5 else None for i in range(n)], "__set_v": k})
    began = time.process_time()
    out = _fold(t, ["k"], ["v"])
    assert time.process_time() - began < 1
    pair = lambda i: [x for x in (t["v"][i].as_py(), t["v"][i + 1].as_py()) if x is not None]
    assert out["v"].to_pylist() == [min(pair(i), default=None) for i in range(0, n, 2)]
