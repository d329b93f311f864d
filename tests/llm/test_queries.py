"""Queries of the text problems on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, data, name):
    df = queries.QUERIES[name](spark, data)
    cur = duck.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert rows(df) == sorted((tuple(r[cols.index(c)] for c in df.columns) for r in cur.fetchall()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_rates_add_up(spark, data):
    r = queries.p2_rates(spark, data).collect()
    n = spark.read.parquet(f"{data}/chat_message.parquet").where("id IS NOT NULL").select("id").distinct().count()
    assert sum(x.n for x in r if x.kind == "abuse") == n and all(abs(x.rate - x.n_cases / x.n) < 1e-12 for x in r)


def test_mixture_blocks(spark, data):
    m = queries.p8_mixture(spark, data).cache()
    assert m.groupBy("source", "block", "doc_id").count().where("count > 1").isEmpty()
    whole = m.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"), F.count_distinct("position").alias("d"))
    assert whole.where("d != n OR last != n - 1").isEmpty()  # places without gaps
    order = {}
    for r in m.orderBy("source", "block", "position").collect():
        order.setdefault((r.source, r.block), []).append(r.doc_id)
    again = [(s, b) for s, b in order if b and len(order[s, b]) == len(order[s, 0]) > 5]
    assert again and all(order[s, b] != order[s, 0] and set(order[s, b]) == set(order[s, 0]) for s, b in again)
    s = queries.p8_shares(spark, data).collect()
    limits = {r.source: r.max_repeat for r in spark.read.parquet(f"{data}/mix_target.parquet").collect()}
    assert abs(sum(r.actual_share for r in s) - 1) < 1e-9 and all(r.most_copies <= limits[r.source] for r in s)
    m.unpersist()


def test_profile_counts_every_document(spark, data):
    p = queries.p9_profile(spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    assert sum(r.n_docs for r in p) == docs
    v = queries.p9_validation(spark, data).collect()
    assert sum(r.n_right for r in v) >= 0.9 * sum(r.n for r in v)
