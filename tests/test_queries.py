"""Every core query against its SQL on the smallest tables."""

import pytest

from ledgerloom.plans import core_queries, table_queries
from tests.conftest import rows

ALL = {**table_queries.QUERIES, **core_queries.QUERIES}
SQL = {**table_queries.ORACLE_SQL, **core_queries.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, data, name):
    df = ALL[name](spark, data)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(r[cols.index(c)] for c in df.columns) for r in cur.fetchall()]
    assert rows(df) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_registry(spark, data):
    import __spark_entry__ as e

    assert set(ALL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_streaming_batches_survive_redelivery(spark, data, tmp_path):
    from ledgerloom.streaming.tail import MaterialisedLatest

    ev = spark.read.parquet(f"{data}/events.parquet")
    m = MaterialisedLatest(spark, str(tmp_path), ev.schema, "user_id", ["event_id"])
    m._apply(ev.where("event_id % 2 = 0"), 0)
    m._apply(ev.where("event_id % 2 = 1"), 1)
    version = m.table.version
    m._apply(ev.where("event_id % 2 = 1"), 1)
    assert m.table.version == version
    m._apply(ev.where("event_id < 100"), 2)  # late
    m.table.compact_all()
    assert rows(m.latest().select("event_id")) == rows(ev.groupBy("user_id").agg({"event_id": "max"}).drop("user_id"))
    assert m.latest().count() == ev.select("user_id").distinct().count()
