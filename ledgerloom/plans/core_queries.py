"""Queries of the general problems: incremental runs, drift, replay, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.keys import pack_position, unpack_position
from ledgerloom.operators import drift, merkle, replay, sessions
from ledgerloom.plans.table_queries import table
from ledgerloom.sources.shared import fresh

SESSION_GAP_S = 1800


_CONTENT = ["_tombstone", "id", "name", "data"]


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "inst_log").withColumn("key", pack_position(F.col("_seg"), F.col("_idx")))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of runs, worked off from an empty state."""
    runs = table(spark, sf_dir, "refresh_run").where("status = 'ok' AND finished_at IS NOT NULL").select("db_id", "run_id", "started_at")
    tail = merkle.MerkleTail(spark, fresh(spark, "merkle"), ["db_id"], "key", _CONTENT)
    return tail.backfill(_positions(spark, sf_dir), runs, "arrived_at", "run_id", "started_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, idx = unpack_position(F.col("key"))
    return _assigned(spark, sf_dir).select("run_id", seg.alias("_seg"), idx.alias("_idx"))


def p1_run_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries per run and segment."""
    seg, _ = unpack_position(F.col("key"))
    return _assigned(spark, sf_dir).groupBy("db_id", "run_id", seg.alias("_seg")).agg(F.count(F.lit(1)).alias("n_entries"))


#: Times at which p1_incremental takes a snapshot; the run at the second one fails.
_SNAPSHOTS = ("2021-01-08 00:00:00", "2021-01-12 00:00:00", "2021-01-16 00:00:00", "9999-01-01 00:00:00")


def p1_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production operator: four refreshes over growing snapshots, the second of which fails."""
    log = _positions(spark, sf_dir)
    tail = merkle.MerkleTail(spark, fresh(spark, "merkle"), ["db_id"], "key", _CONTENT)
    seg, idx = unpack_position(F.col("key"))
    out = []
    for step, until in enumerate(_SNAPSHOTS):
        rows = tail.refresh(log.where(F.col("arrived_at") <= F.lit(until).cast("timestamp_ntz")), publish=step != 1)
        if step != 1:
            out.append(rows.select(F.lit(step).alias("step"), "db_id", seg.alias("_seg"), idx.alias("_idx")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_report(table(spark, sf_dir, "inst_file")).select("file_id", "drift", "field_before", "field_after")


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all feeds under canonical names, one row per record."""
    out = drift.unify(table(spark, sf_dir, "inst_file"))
    return out.select("feed_id", "file_id", "line_no", F.to_json("fields").alias("fields"))


_RECORD = ["name", "data"]


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "inst_log")
    state = replay.replay(log, ["db_id", "id"], pack_position(F.col("_seg"), F.col("_idx")), F.col("_tombstone"), _RECORD)
    return replay.live_rows(state, ["db_id", "id"], _RECORD)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, idx = unpack_position(F.col("_set_seq"))
    return _replayed(spark, sf_dir).select("db_id", "id", seg.alias("_seg"), idx.alias("_idx"))


def p5_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current records with their values."""
    return _replayed(spark, sf_dir).select("db_id", "id", "name", F.hex("data").alias("data"))


def p5_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial-column updates: a NULL in an entry leaves the column as it was."""
    log = table(spark, sf_dir, "inst_log")
    state = replay.replay(log, ["db_id", "id"], pack_position(F.col("_seg"), F.col("_idx")), F.col("_tombstone"), _RECORD, partial=True)
    return replay.live_rows(state, ["db_id", "id"], _RECORD).select("db_id", "id", "name", F.hex("data").alias("data"))


def _chat_sessions(spark: SparkSession, sf_dir: str, event_id: str | None) -> DataFrame:
    return sessions.sessions(table(spark, sf_dir, "chat_message"), "username", "ts", SESSION_GAP_S, event_id=event_id)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a message delivered again has the same ts: it cannot move a border
    return _chat_sessions(spark, sf_dir, None).select("username", "start_ts", "end_ts")


def p6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat_sessions(spark, sf_dir, "id")


QUERIES = {f.__name__: f for f in (p1_found, p1_run_sizes, p1_incremental, p3_found, p3_unified, p5_found, p5_current, p5_partial, p6_found, p6_sessions)}

_SEEN = "SELECT db_id, _seg, _idx, min(arrived_at) AS v FROM inst_log WHERE db_id IS NOT NULL AND _seg IS NOT NULL AND _idx IS NOT NULL GROUP BY db_id, _seg, _idx"
_OK = "SELECT DISTINCT db_id, run_id, started_at FROM refresh_run WHERE status = 'ok' AND finished_at IS NOT NULL AND started_at IS NOT NULL"
_ASSIGNED = f"""SELECT db_id, run_id, _seg, _idx FROM (
  SELECT e.db_id, e._seg, e._idx, r.run_id, row_number() OVER (PARTITION BY e.db_id, e._seg, e._idx ORDER BY r.started_at, r.run_id) AS rn
  FROM ({_SEEN}) e JOIN ({_OK}) r ON r.db_id = e.db_id AND r.started_at >= e.v) t WHERE rn = 1"""
_CURRENT = """SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY db_id, id ORDER BY _seg DESC, _idx DESC) AS rn FROM inst_log) t
  WHERE rn = 1 AND NOT coalesce(_tombstone, false)"""


def _sessions_sql(source: str) -> str:
    return f"""SELECT username, session_no, min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration, count(*) AS n_events FROM (
  SELECT username, ts, 1 + sum(CASE WHEN ts - prev > {SESSION_GAP_S} THEN 1 ELSE 0 END) OVER (PARTITION BY username ORDER BY ts, id) AS session_no FROM (
    SELECT username, ts, id, lag(ts) OVER (PARTITION BY username ORDER BY ts, id) AS prev FROM ({source}) s) t) u
  GROUP BY username, session_no"""


_MESSAGES = "SELECT DISTINCT id, ts, username FROM chat_message WHERE username IS NOT NULL AND ts IS NOT NULL"

ORACLE_SQL = {
    "p1_found": f"SELECT run_id, _seg, _idx FROM ({_ASSIGNED}) a",
    "p1_run_sizes": f"SELECT db_id, run_id, _seg, count(*) AS n_entries FROM ({_ASSIGNED}) a GROUP BY db_id, run_id, _seg",
    "p1_incremental": f"""SELECT CASE WHEN v <= TIMESTAMP '{_SNAPSHOTS[0]}' THEN 0 WHEN v <= TIMESTAMP '{_SNAPSHOTS[2]}' THEN 2 ELSE 3 END AS step, db_id, _seg, _idx FROM ({_SEEN}) e""",
    "p5_found": f"SELECT db_id, id, _seg, _idx FROM ({_CURRENT}) c",
    "p5_current": f"SELECT db_id, id, name, hex(data) AS data FROM ({_CURRENT}) c",
    "p5_partial": """SELECT db_id, id, arg_max(name, pos) FILTER (WHERE name IS NOT NULL) AS name, hex(arg_max(data, pos) FILTER (WHERE data IS NOT NULL)) AS data
      FROM (SELECT *, max(CASE WHEN dead THEN pos END) OVER (PARTITION BY db_id, id) AS wiped
        FROM (SELECT *, (_seg::BIGINT << 48) | _idx AS pos, coalesce(_tombstone, false) AS dead FROM inst_log) t) u
      WHERE NOT dead AND pos > coalesce(wiped, -1) GROUP BY db_id, id""",
    "p6_found": f"SELECT username, start_ts, end_ts FROM ({_sessions_sql(_MESSAGES)}) x",
    "p6_sessions": f"SELECT username, CAST(session_no AS BIGINT) AS session_no, start_ts, end_ts, duration, n_events FROM ({_sessions_sql(_MESSAGES)}) x",
}
