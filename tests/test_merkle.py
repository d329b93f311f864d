import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import merkle
from tests.conftest import rows

T0 = dt.datetime(2021, 1, 1)


def at(m):
    return T0 + dt.timedelta(minutes=m)


def brute(entries, runs):
    want = []
    for d, k, v in entries:
        after = sorted((t, run) for db, run, t in runs if db == d and t >= v)
        if after:
            want.append((d, after[0][1], k))
    return sorted(want, key=lambda x: tuple((False, str(y)) for y in x))


LOG, RUNS = "db int, key bigint, v timestamp_ntz, name string", "db int, run bigint, started timestamp_ntz"


def test_backfill_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    entries = [(d, s << 48 | i, at(rng.randrange(0, 1000)), "x") for d in (1, 2) for s in (1, 2) for i in rng.sample(range(1500), 300)]
    again = [(d, k, v + dt.timedelta(minutes=rng.randrange(500)), x) for d, k, v, x in entries[::3]]
    runs = [(d, r + 100 * d, at(t)) for d in (1, 2) for r, t in enumerate([50, 400, 400, 401, 900])]
    e = spark.createDataFrame([*entries, *again, (1, None, at(1), ""), (None, 1, at(1), ""), (2, 5, None, "")], LOG)
    r = spark.createDataFrame(runs + runs[:2] + [(3, 1, at(5)), (None, 7, at(5))], RUNS)
    mk = lambda: merkle.MerkleTail(spark, str(tmp_path), ["db"], "key", ["name"])
    want = brute([x[:3] for x in entries], runs)
    # the first three runs of each part, later the others against the published tree
    early = r.where("run % 100 < 3")
    first = rows(mk().backfill(e.where(F.col("v") <= F.lit(at(400))), early, "v", "run", "started"))
    rest = rows(mk().backfill(e, r.where("run % 100 >= 3"), "v", "run", "started"))
    assert sorted(first + rest, key=str) == sorted(want, key=str)
    # a run over a snapshot goes on from the same state
    late = {(d, k) for d, k, v, _ in entries if v > at(900)}
    snap = e.where("db IS NOT NULL AND v IS NOT NULL")
    assert {tuple(x)[:2] for x in mk().refresh(snap).collect()} == late
    assert mk().backfill(e, r, "v", "run", "started").count() == 0


def test_backfill_in_one_pass(spark, tmp_path):
    entries = [(1, k, at(k // 100), "x") for k in range(0, 3000, 7)]
    runs = [(1, i, at(10 * i)) for i in range(5)]
    t = merkle.MerkleTail(spark, str(tmp_path), ["db"], "key", ["name"])
    assert rows(t.backfill(spark.createDataFrame(entries, LOG), spark.createDataFrame(runs, RUNS), "v", "run", "started")) == brute([x[:3] for x in entries], runs)


@pytest.fixture
def tail(spark, tmp_path):
    return lambda: merkle.MerkleTail(spark, str(tmp_path / "state"), ["db"], "key", ["name"])


def test_refresh_hands_out_each_change_once(spark, tail):
    mk = lambda rs: spark.createDataFrame(rs, "db int, key bigint, name string, node string")
    a = [(1, 0, "a", "x"), (1, 300, None, "x"), (None, 5, "", "x"), (1, 0, "a", "y"), (1, None, "lost", "")]
    assert rows(tail().refresh(mk(a))) == sorted([(1, 0, "a"), (1, 300, None), (None, 5, "")], key=lambda r: tuple((x is None, str(x)) for x in r))
    assert tail().refresh(mk(a)).count() == 0
    b = [*a, (1, 1, "late", ""), (1, 300, "changed", "")]
    b = [r for r in b if r[:3] != (1, 300, None)]
    assert rows(tail().refresh(mk(b), publish=False)) == rows(tail().refresh(mk(b)))  # a failed run keeps nothing
    assert tail().refresh(mk(b)).count() == 0
    assert rows(tail().refresh(mk([*b, (2, 9, "z", "")]))) == [(2, 9, "z")]
    back = [r if r[1] != 300 else (1, 300, None, "x") for r in b] + [(2, 9, "z", "")]
    assert rows(tail().refresh(mk(back))) == [(1, 300, None)]  # an earlier content is a change again


def test_a_change_beside_the_old_row_is_handed_out(spark, tail):
    mk = lambda rs: spark.createDataFrame(rs, "db int, key bigint, name string")
    old = [(p, k, "old") for p in (1, None) for k in range(20)]
    new = [(p, k, f"new{k}") for p, k, _ in old]
    by_text = lambda rs: sorted(rs, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows(tail().refresh(mk(old))) == by_text(old)
    assert rows(tail().refresh(mk(old + new))) == by_text(new)  # whichever hash is the smaller
    assert tail().refresh(mk(old + new + new)).count() == 0
    assert tail().refresh(mk(new)).count() == 0  # the old rows were compacted away


def test_crash_before_publishing_skips_and_repeats_nothing(spark, tail, monkeypatch):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "db int, key bigint, name string")
    tail().refresh(df.where("key = 0"))
    monkeypatch.setattr(merkle.SharedFolder, "publish", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        tail().refresh(df)
    monkeypatch.undo()
    assert rows(tail().refresh(df)) == [(1, 1, "b")]
    assert tail().refresh(df).count() == 0


def test_a_removed_record_that_comes_back_is_handed_out(spark, tail):
    mk = lambda rs: spark.createDataFrame(rs, "db int, key bigint, name string")
    both = [(1, 1, "a"), (1, 2, "b")]
    assert rows(tail().refresh(mk(both))) == both
    assert tail().refresh(mk(both[1:])).count() == 0
    assert rows(tail().removed()) == [(1, 1)]
    assert rows(tail().refresh(mk(both))) == both[:1]
    assert tail().removed().count() == 0


def test_any_number_of_contents_beside_each_other(spark, tail, monkeypatch):
    monkeypatch.setattr(merkle, "MERGE_AFTER", 3)
    mk = lambda rs: spark.createDataFrame(rs, "db int, key bigint, name string")
    for n in range(1, 5):  # passes the merging of versions
        seen = [(1, 7, chr(96 + i)) for i in range(1, n + 1)]
        assert rows(tail().refresh(mk([*seen, (1, 9000, "still")]))) == ([seen[-1]] if n > 1 else [*seen, (1, 9000, "still")])
    assert len(tail()._published()[1]) < 3


def test_with_an_order_the_newest_content_counts(spark, tmp_path):
    mk = lambda rs: spark.createDataFrame(rs, "db int, key bigint, name string, at int")
    t = merkle.MerkleTail(spark, str(tmp_path), ["db"], "key", ["name"], order="at")
    log = [(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "c", None)]
    assert rows(t.refresh(mk(log))) == [(1, 1, "b"), (1, 2, "c")]
    assert t.refresh(mk([*log, (1, 1, "older", 0)])).count() == 0
    assert rows(t.refresh(mk([*log, (1, 1, "d", 3)]))) == [(1, 1, "d")]


def test_of_two_runs_at_once_one_fails_and_nothing_is_lost(spark, tail):
    mk = lambda rs: spark.createDataFrame(rs, "db int, key bigint, name string")
    slow, quick = tail(), tail()
    begun = slow._published()
    slow._published = lambda: begun
    assert rows(quick.refresh(mk([(1, 1, "a")]))) == [(1, 1, "a")]
    with pytest.raises(merkle.ConsistencyError):
        slow.refresh(mk([(1, 1, "a"), (1, 2, "b")]))
    assert rows(tail().refresh(mk([(1, 1, "a"), (1, 2, "b")]))) == [(1, 2, "b")]


def test_equal_subtrees_are_not_read(spark, tail):
    ids = [(db, k, "x") for db in (1, 2) for k in range(0, 256 * 40, 64)]
    mk = lambda rs: spark.createDataFrame(rs, "db int, key bigint, name string")
    tail().refresh(mk(ids))
    t = tail()
    assert t.refresh(mk(ids)).count() == 0 and t.compared == [4]  # two roots on either side, no more
    assert rows(t.refresh(mk([*ids, (2, 300, "new")]))) == [(2, 300, "new")]
    assert t.compared == [4, 2, 2, 80]  # the 40 leaves of db 2 on either side; none of db 1
    leaves = spark.createDataFrame([(2, 1)], "db int, __node bigint")
    held = t._held(t._published()[1], leaves)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan or "PartitionFilters: [__bucket" in plan
    assert held.select("key").distinct().count() == 5


def test_empty(spark, tail):
    df = spark.createDataFrame([], "db int, key bigint, name string")
    assert tail().refresh(df).count() == 0
    e = df.withColumn("v", F.current_timestamp())
    r = spark.createDataFrame([], "db int, run bigint, s timestamp")
    assert tail().backfill(e, r, "v", "run", "s").count() == 0
    assert tail().removed() is None
