import random

from pyspark.sql import functions as F

from ledgerloom.operators.sessions import sessions
from tests.conftest import rows

DDL = "id string, ts bigint, username string, session_no string, __u string"


def brute(events, gap):
    out, by = [], {}
    for _, ts, u, *_ in events:
        if u is not None and ts is not None:
            by.setdefault(u, []).append(ts)
    for u, tss in by.items():
        tss.sort()
        s, no = [tss[0]], 1
        for t in tss[1:]:
            if t - s[-1] > gap:
                out.append((u, no, s[0], s[-1], s[-1] - s[0], len(s)))
                s, no = [], no + 1
            s.append(t)
        out.append((u, no, s[0], s[-1], s[-1] - s[0], len(s)))
    return out


def test_against_brute_force_with_clashing_columns(spark):
    rng = random.Random(3)
    # a hot user, bucket borders, ties, gaps of exactly the limit, negative times
    ev = [(str(i), rng.choice([0, 0, 10, 30, 31, 100, 7, -500]) + rng.randrange(-200, 4000) // 10 * 10, rng.choice(["hot"] * 5 + ["a", "A", ""]), "x", "y") for i in range(600)]
    ev += [("n1", None, "a", "", ""), ("n2", 5, None, "", ""), ("b0", 99, "edge", "", ""), ("b1", 129, "edge", "", ""), ("b2", 160, "edge", "", "")]
    df = spark.createDataFrame(ev, DDL)
    got = sessions(df, "username", "ts", 30, bucket=100)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert rows(got) == sorted(brute(ev, 30), key=key)


def test_redelivery_counts_once_and_kinds_are_counted(spark):
    ev = [("1", 0, "u", "", ""), ("1", 0, "u", "", ""), ("2", 10, "u", "", ""), (None, 11, "u", "", ""), (None, 11, "u", "", "")]
    df = spark.createDataFrame(ev, DDL)
    got = sessions(df, "username", "ts", 30, event_id="id", kinds={"late": F.col("ts") > 5})
    assert rows(got) == [("u", 1, 0, 11, 11, 4, 3)]


def test_empty(spark):
    assert sessions(spark.createDataFrame([], DDL), "username", "ts", 30, event_id="id").count() == 0
