"""A small chat log: every argument is posted as a message, then the newest ones are shown.

    python examples/chat_log.py /tmp/chat ada "hello there"
"""

from __future__ import annotations

import os
import sys
import time
import uuid

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom import Bound, LogTable  # noqa: E402


def open_log(spark: SparkSession, path: str) -> LogTable:
    return LogTable.configure(spark).data_dir(path).fields("id string, ts bigint, username string, msg string").primary_key("id").secondary_keys("ts", "username").initialize()


def post(log: LogTable, username: str, *messages: str) -> None:
    log.upsert(*[(uuid.uuid4().hex, int(time.time()), username, m) for m in messages])
    log.maintain()


def newest(log: LogTable, n: int = 20) -> list:
    return log.range_by("ts", Bound.unbounded(), Bound.unbounded(), sort_asc=False, limit=n).collect()


def main() -> None:
    path, username, *messages = sys.argv[1:]
    spark = SparkSession.builder.master("local[*]").getOrCreate()
    log = open_log(spark, path)
    if messages:
        post(log, username, *messages)
    for r in reversed(newest(log)):
        print(f"{r.username}: {r.msg}")
    spark.stop()


if __name__ == "__main__":
    main()
