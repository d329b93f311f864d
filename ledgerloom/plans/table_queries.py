"""Queries of the keyed-log engine: scans, lookups, paging, mutations, maintenance."""

from __future__ import annotations

import atexit
import os
import re
import shutil
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.config import IDX, SEG, TableConfig
from ledgerloom.functions.keys import tagged
from ledgerloom.operators import compaction, state
from ledgerloom.operators.state import LogView
from ledgerloom.sources.shared import fresh
from ledgerloom.streaming.tail import MaterialisedLatest
from ledgerloom.table import LogTable
from ledgerloom.values import Bound


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh directory for a table in the checkpoint folder; removed when the driver ends.

    Tables need a POSIX file system; another kind of folder is refused.
    """
    path = fresh(spark, "ledger")
    if "://" in path and not path.startswith("file://"):
        raise RuntimeError(f"tables need a shared POSIX folder, not {path}")
    path = re.sub("^file:(//)?", "", path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return os.path.join(path, "table")


# -- views of the given tables -------------------------------------------------------------


def events_log(spark: SparkSession, sf_dir: str) -> LogView:
    """events as a change log: key user_id, order event_id, a tombstone where event_type is 'error'."""
    return LogView(table(spark, sf_dir, "events"), "user_id", ("event_type",), ("event_id",), F.col("event_type") == "error")


def customers(spark: SparkSession, sf_dir: str) -> LogView:
    return LogView(table(spark, sf_dir, "customer"), "c_custkey", ("c_mktsegment", "bal"), unique=True)


def orders(spark: SparkSession, sf_dir: str) -> LogView:
    return LogView(table(spark, sf_dir, "orders"), "o_orderkey", ("o_orderstatus",), unique=True)


# -- scans and state -----------------------------------------------------------------------


def log_latest_state(spark, sf_dir):
    return state.latest(events_log(spark, sf_dir))


def log_state_as_of(spark, sf_dir):
    return state.state_as_of(events_log(spark, sf_dir), F.col("event_id") < 5000)


def _event_log(spark, sf_dir) -> LogTable:
    e = table(spark, sf_dir, "events")
    t = LogTable.open(spark, TableConfig(scratch(spark), e.schema, "user_id", ("event_type",)))
    t.upsert_df(e, order_by=["event_id"])
    return t


def log_scan_from(spark, sf_dir):
    """Offset scan: log entries at or after the position of an entry."""
    t = _event_log(spark, sf_dir)
    at = t.log().where("event_id >= 7500").agg(F.min(F.struct(SEG, IDX))).first()[0]
    log = t.log(at[0], at[1]) if at else t.log().limit(0)
    return log.select("event_id", "user_id", "event_type")


def fetch_positions(spark, sf_dir):
    """Random-access fetch of log positions."""
    t = _event_log(spark, sf_dir)
    at = {r.event_id: (r[0], r[1]) for r in t.log().where(F.col("event_id").isin(17, 4000, 3)).select(SEG, IDX, "event_id").collect()}
    return t.fetch([at.get(k, (0, -1)) for k in (17, 4000, 3, 17)]).select("tag", "event_id", "user_id")


def _compacted_orders(spark, sf_dir) -> LogTable:
    o = table(spark, sf_dir, "orders")
    t = LogTable.open(spark, TableConfig(scratch(spark), o.schema, "o_orderkey", ("o_orderstatus",)))
    t.upsert_df(o)
    t.compact_all()
    return t


def table_get(spark, sf_dir):
    """Point lookup in a compacted table: a pruned scan without a window."""
    return _compacted_orders(spark, sf_dir).find_by("o_orderkey", 7)


def table_range(spark, sf_dir):
    return _compacted_orders(spark, sf_dir).range_by("o_orderkey", Bound.included(3), Bound.excluded(70))


def table_page_rest(spark, sf_dir):
    """Everything behind an offset."""
    return _compacted_orders(spark, sf_dir).find_by("o_orderstatus", "F", offset=10).select("o_orderkey", "o_custkey")


# -- lookups ---------------------------------------------------------------------------------


def get_by_pk(spark, sf_dir):
    return state.find_by(customers(spark, sf_dir), "c_custkey", 7)


def get_after_tombstone(spark, sf_dir):
    v = events_log(spark, sf_dir)
    every = state.latest(v, keep_tombstones=True).withColumn("dead", F.col("event_type") == "error")
    return every.agg(F.count_if(~F.col("dead")).alias("n_live"), F.count_if("dead").alias("n_dead"))


def find_by_sk(spark, sf_dir):
    return state.find_by(customers(spark, sf_dir), "c_mktsegment", "BUILDING")


def find_by_superseded_sk(spark, sf_dir):
    """A secondary key is compared with the newest row of each key only."""
    return state.find_by(events_log(spark, sf_dir), "event_type", "click")


def find_by_null(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return state.find_by(LogView(df, "c_custkey", ("seg",), unique=True), "seg", None)


def batch_find_by_pk(spark, sf_dir):
    return state.batch_find_by(customers(spark, sf_dir), "c_custkey", [2, 3, 4, 3, -1])


def batch_find_by_sk_paged(spark, sf_dir):
    return state.batch_find_by(customers(spark, sf_dir), "c_mktsegment", ["MACHINERY", "BUILDING"], offset=300, limit=20).select("tag", "c_custkey", "c_mktsegment")


def _orders_range(lo: Bound, hi: Bound):
    return lambda spark, sf_dir: state.range_by(orders(spark, sf_dir), "o_orderkey", lo, hi)


range_half_open = _orders_range(Bound.included(3), Bound.excluded(7))
range_closed = _orders_range(Bound.included(3), Bound.included(7))
range_to = _orders_range(Bound.unbounded(), Bound.included(7))
range_from = _orders_range(Bound.included(14990), Bound.unbounded())
range_open = _orders_range(Bound.excluded(3), Bound.excluded(7))


def range_sk_string(spark, sf_dir):
    return state.range_by(customers(spark, sf_dir), "c_mktsegment", Bound.included("BUILDING"), Bound.excluded("HOUSEHOLD"))


def range_decimal(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(15,2)").alias("bal"))
    return state.range_by(LogView(df, "c_custkey", ("bal",), unique=True), "bal", Bound.included(Decimal("1000.00")), Bound.excluded(Decimal("2500.50")))


def range_mixed_kinds(spark, sf_dir):
    """Keys of several kinds in one column sort NULL < int < string."""
    df = table(spark, sf_dir, "customer")
    third = F.col("c_custkey") % 3
    key = tagged(i=F.when(third == 1, F.col("c_custkey")), s=F.when(third == 2, F.col("c_name")))
    return df.select("c_custkey", key.alias("k")).where(F.col("k") >= tagged(i=F.lit(700))).orderBy("k", "c_custkey").limit(400).select("c_custkey", F.col("k.rank").alias("rank"))


def page_asc(spark, sf_dir):
    return state.range_by(orders(spark, sf_dir), "o_orderkey", Bound.included(2), Bound.excluded(800), offset=10, limit=30).select("o_orderkey", "o_custkey")


def page_desc(spark, sf_dir):
    return state.find_by(orders(spark, sf_dir), "o_orderstatus", "F", offset=10, limit=30, sort_asc=False).select("o_orderkey", "o_custkey")


def newest_100(spark, sf_dir):
    view = LogView(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "event_id", ("ts",), unique=True)
    return state.newest(view, "ts", 100)


# -- mutations -------------------------------------------------------------------------------

_CUSTOMER = "c_custkey bigint, c_name string, c_acctbal double"


def _customer_table(spark: SparkSession, sf_dir: str, schema: str, keys: tuple[str, ...] = ()) -> LogTable:
    t = LogTable.open(spark, TableConfig(scratch(spark), T.StructType.fromDDL(schema), "c_custkey", keys))
    t.upsert_df(table(spark, sf_dir, "customer").select(*t.config.schema.names))
    return t


def _changes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    raised = c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100)
    added = c.where("c_custkey < 5").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return [raised, added]


def upsert_overlay(spark, sf_dir):
    base = LogView(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", unique=True)
    raised, added = _changes(spark, sf_dir)
    return state.live(state.overlay(base, raised.unionByName(added)))


def tx_commit(spark, sf_dir):
    t = _customer_table(spark, sf_dir, _CUSTOMER)
    with t.transaction():
        for df in _changes(spark, sf_dir):
            t.upsert_df(df)
    return t.latest()


def tx_rollback(spark, sf_dir):
    full = table(spark, sf_dir, "customer").schema
    t = LogTable.open(spark, TableConfig(scratch(spark), full, "c_custkey", ("c_mktsegment",)))
    t.upsert_df(table(spark, sf_dir, "customer"))
    t.tx_begin()
    t.delete_by("c_mktsegment", "BUILDING")
    t.tx_rollback()
    return t.latest()


def _deleted(spark, sf_dir, name, value):
    full = table(spark, sf_dir, "customer").schema
    t = LogTable.open(spark, TableConfig(scratch(spark), full, "c_custkey", ("c_mktsegment",)))
    t.upsert_df(table(spark, sf_dir, "customer"))
    return t, t.delete_by(name, value)


def delete_by_pk(spark, sf_dir):
    return _deleted(spark, sf_dir, "c_custkey", 7)[0].latest()


def delete_by_sk(spark, sf_dir):
    return _deleted(spark, sf_dir, "c_mktsegment", "BUILDING")[0].latest()


def delete_by_sk_returning(spark, sf_dir):
    return _deleted(spark, sf_dir, "c_mktsegment", "BUILDING")[1]


def delete_overlay(spark, sf_dir):
    """Deletes as an anti-match of tombstones over a snapshot, without a table."""
    base = LogView(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", unique=True)
    none = base.df.limit(0)
    return state.live(state.overlay(base, none, base.df.where("c_acctbal < 0")))


# -- maintenance -----------------------------------------------------------------------------


def _segment():
    return F.floor(F.col("event_id") / 1000).cast("bigint")


def compact_segment(spark, sf_dir):
    return compaction.compact_segments(events_log(spark, sf_dir), _segment()).select("seg", "user_id", "event_id")


def compact_stats(spark, sf_dir):
    return compaction.segment_stats(events_log(spark, sf_dir), _segment())


def sk_index(spark, sf_dir):
    return state.secondary_index(events_log(spark, sf_dir), "event_type", "event_id")


def sk_index_append_only(spark, sf_dir):
    return state.secondary_index_append_only(events_log(spark, sf_dir), "event_type", "event_id")


def schema_add_field(spark, sf_dir):
    """Old rows of a table opened with one more nullable field read it as NULL."""
    c = table(spark, sf_dir, "customer")
    narrow = T.StructType.fromDDL("c_custkey bigint, c_name string")
    wide = T.StructType.fromDDL("c_custkey bigint, c_name string, maybe_str string")
    at = scratch(spark)
    LogTable.open(spark, TableConfig(at, narrow, "c_custkey")).upsert_df(c.where("c_custkey < 750").select("c_custkey", "c_name"))
    t = LogTable.open(spark, TableConfig(at, wide, "c_custkey"))
    t.upsert_df(c.where("c_custkey >= 750").select("c_custkey", "c_name", F.col("c_mktsegment").alias("maybe_str")))
    return t.latest()


def _events_table(spark, sf_dir) -> LogTable:
    e = table(spark, sf_dir, "events")
    t = LogTable.open(spark, TableConfig(scratch(spark), e.schema, "user_id", ("event_type",), segment_rows=1))
    cut = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for part in (e.where(F.col("event_id") <= cut), e.where(F.col("event_id") > cut)):
        with t.transaction():
            t.upsert_df(part, order_by=["event_id"])
        t.maintain()
    return t


def reopen_after_compaction(spark, sf_dir):
    t = _events_table(spark, sf_dir)
    t.compact_all()
    t.vacuum()
    again = LogTable.open(spark, t.config)
    return again.latest().where("event_type <> 'error'")


def incremental_refresh(spark, sf_dir):
    """A reader pinned to a version sees later commits after a refresh only; this is its refreshed view."""
    from dataclasses import replace

    from ledgerloom.config import ReadConsistency

    t = _events_table(spark, sf_dir)
    reader = LogTable.open(spark, replace(t.config, read_consistency=ReadConsistency.EVENTUAL))
    t.delete_by("event_type", "error")
    reader.refresh()
    return reader.latest()


def streaming_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    root = os.path.dirname(scratch(spark))
    e.repartition(4, "user_id").write.parquet(os.path.join(root, "source"))
    m = MaterialisedLatest(spark, root, e.schema, "user_id", ["event_id"])
    m.run(os.path.join(root, "source"), files_per_trigger=2)
    return m.latest().where("event_type <> 'error'")


_NAMES = (
    "log_latest_state log_state_as_of log_scan_from fetch_positions table_get table_range table_page_rest get_by_pk get_after_tombstone find_by_sk find_by_superseded_sk find_by_null batch_find_by_pk batch_find_by_sk_paged "
    "range_half_open range_closed range_to range_from range_open range_sk_string range_decimal range_mixed_kinds page_asc page_desc newest_100 upsert_overlay tx_commit tx_rollback delete_by_pk delete_by_sk delete_by_sk_returning delete_overlay "
    "compact_segment compact_stats sk_index sk_index_append_only schema_add_field reopen_after_compaction incremental_refresh streaming_latest"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}


def _latest_sql(where: str = "") -> str:
    return f"""SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events {where}) t
WHERE rn = 1 AND event_type <> 'error'"""


_OVERLAY = """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT c_custkey, c_name, c_acctbal + 100 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_custkey + 1000000 AS c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey < 5"""
_SEG = "CAST(floor(event_id / 1000) AS BIGINT)"

ORACLE_SQL = {
    "log_latest_state": _latest_sql(),
    "log_state_as_of": _latest_sql("WHERE event_id < 5000"),
    "table_get": "SELECT * FROM orders WHERE o_orderkey = 7",
    "table_range": "SELECT * FROM orders WHERE o_orderkey >= 3 AND o_orderkey < 70",
    "table_page_rest": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey OFFSET 10",
    "log_scan_from": f"SELECT event_id, user_id, event_type FROM events WHERE event_id >= 7500",
    "fetch_positions": "SELECT k.tag, e.event_id, e.user_id FROM (VALUES (0, 17), (1, 4000), (2, 3), (3, 17)) AS k(tag, key) JOIN events e ON e.event_id = k.key",
    "get_by_pk": "SELECT * FROM customer WHERE c_custkey = 7",
    "get_after_tombstone": f"SELECT count(*) AS n_live, (SELECT count(DISTINCT user_id) FROM events) - count(*) AS n_dead FROM ({_latest_sql()}) s",
    "find_by_sk": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
    "find_by_superseded_sk": f"SELECT * FROM ({_latest_sql()}) s WHERE event_type = 'click'",
    "find_by_null": "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM NULL",
    "batch_find_by_pk": "SELECT k.tag, c.* FROM (VALUES (0, 2), (1, 3), (2, 4), (3, 3), (4, -1)) AS k(tag, key) JOIN customer c ON c.c_custkey = k.key",
    "batch_find_by_sk_paged": "SELECT k.tag, c.c_custkey, c.c_mktsegment FROM (VALUES (0, 'MACHINERY'), (1, 'BUILDING')) AS k(tag, key) JOIN customer c ON c.c_mktsegment = k.key ORDER BY k.tag, c.c_custkey LIMIT 20 OFFSET 300",
    "range_half_open": "SELECT * FROM orders WHERE o_orderkey >= 3 AND o_orderkey < 7",
    "range_closed": "SELECT * FROM orders WHERE o_orderkey >= 3 AND o_orderkey <= 7",
    "range_to": "SELECT * FROM orders WHERE o_orderkey <= 7 OR o_orderkey IS NULL",
    "range_from": "SELECT * FROM orders WHERE o_orderkey >= 14990",
    "range_open": "SELECT * FROM orders WHERE o_orderkey > 3 AND o_orderkey < 7",
    "range_sk_string": "SELECT * FROM customer WHERE c_mktsegment >= 'BUILDING' AND c_mktsegment < 'HOUSEHOLD'",
    "range_decimal": "SELECT c_custkey, CAST(c_acctbal AS DECIMAL(15,2)) AS bal FROM customer WHERE CAST(c_acctbal AS DECIMAL(15,2)) >= 1000.00 AND CAST(c_acctbal AS DECIMAL(15,2)) < 2500.50",
    "range_mixed_kinds": """SELECT c_custkey, rank FROM (
  SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS rank, CASE WHEN c_custkey % 3 = 1 THEN c_custkey END AS i, CASE WHEN c_custkey % 3 = 2 THEN c_name END AS s FROM customer) t
WHERE rank = 3 OR (rank = 1 AND i >= 700) ORDER BY rank, i, s, c_custkey LIMIT 400""",
    "page_asc": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 2 AND o_orderkey < 800 ORDER BY o_orderkey LIMIT 30 OFFSET 10",
    "page_desc": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 30 OFFSET 10",
    "newest_100": "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "upsert_overlay": _OVERLAY,
    "tx_commit": _OVERLAY,
    "tx_rollback": "SELECT * FROM customer",
    "delete_by_pk": "SELECT * FROM customer WHERE c_custkey <> 7",
    "delete_by_sk": "SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "delete_by_sk_returning": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
    "delete_overlay": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT c_acctbal < 0",
    "compact_segment": f"SELECT {_SEG} AS seg, user_id, max(event_id) AS event_id FROM events GROUP BY {_SEG}, user_id",
    "compact_stats": f"SELECT {_SEG} AS seg, count(*) AS n_rows, count(DISTINCT user_id) AS n_unique FROM events GROUP BY {_SEG}",
    "sk_index": f"SELECT event_type AS sk, user_id AS pk, event_id AS log_key FROM ({_latest_sql()}) s",
    "sk_index_append_only": "SELECT event_type AS sk, user_id AS pk, max(event_id) AS log_key FROM events GROUP BY event_type, user_id",
    "schema_add_field": "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS maybe_str FROM customer WHERE c_custkey < 750 UNION ALL SELECT c_custkey, c_name, c_mktsegment AS maybe_str FROM customer WHERE c_custkey >= 750",
    "reopen_after_compaction": _latest_sql(),
    "incremental_refresh": _latest_sql(),
    "streaming_latest": _latest_sql(),
}
