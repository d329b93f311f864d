"""Sessions of activity separated by inactivity gaps.

A window per user would put a user's whole history into one task.  Here the
history is cut into time buckets first:

1. events are pre-aggregated to one row per (user, ts) with a map-side combine;
2. a window per (user, bucket) flags gaps, and the running sum of flags numbers
   the pieces of sessions inside the bucket, one row per piece;
3. a window per user over the pieces joins those that continue across a bucket
   border.  A user has at most (time span / gap + number of buckets) pieces,
   however many events they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.errors import ValidationError


def sessions(events: DataFrame, user: str, ts: str, gap: int, *, event_id: str | None = None, kinds: dict[str, Column] | None = None, bucket: int = 86_400) -> DataFrame:
    """(user, session_no, start_ts, end_ts, duration, n_events, one count per entry of ``kinds``).

    ``ts`` is a whole number of seconds (any unit works if gap and bucket use it).
    Neighbours exactly ``gap`` apart stay together.  With ``event_id`` an event
    delivered more than once counts once; rows with a NULL id are then left out of
    the dedup and each count.  Rows without user or ts are left out.  Users are
    compared exactly.  Equal timestamps belong together; an empty table gives no
    rows; columns not named here, whatever they are called, are ignored.
    """
    if gap < 0 or bucket < 1:
        raise ValidationError("gap must not be negative and bucket must be positive")
    kinds = kinds or {}
    cols = [F.col(user).alias("__u"), F.col(ts).cast("bigint").alias("__t"), *[c.cast("boolean").alias(f"__k{i}") for i, c in enumerate(kinds.values())]]
    if event_id:
        cols.append(F.col(event_id).alias("__id"))
    df = events.select(*cols).where(F.col("__u").isNotNull() & F.col("__t").isNotNull())
    if event_id:
        df = df.where("__id IS NOT NULL").dropDuplicates(["__id"]).unionByName(df.where("__id IS NULL"))
    counts = [F.count_if(F.col(f"__k{i}")).alias(f"__k{i}") for i in range(len(kinds))]
    sums = [F.sum(f"__k{i}").alias(f"__k{i}") for i in range(len(kinds))]
    df = df.withColumn("__b", F.floor(F.col("__t") / F.lit(bucket)))
    df = df.groupBy("__u", "__b", "__t").agg(F.count(F.lit(1)).alias("__n"), *counts)

    inside = Window.partitionBy("__u", "__b").orderBy("__t")
    df = df.withColumn("__gap", F.col("__t") - F.lag("__t").over(inside) > gap)
    df = df.withColumn("__p", F.sum(F.col("__gap").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # first rows have no lag, so their flag and sum are NULL until a gap is seen
    df = df.withColumn("__p", F.coalesce("__p", F.lit(0)))
    pieces = df.groupBy("__u", "__b", "__p").agg(F.min("__t").alias("__s"), F.max("__t").alias("__e"), F.sum("__n").alias("__n"), *sums)

    along = Window.partitionBy("__u").orderBy("__s")
    pieces = pieces.withColumn("__new", F.coalesce(F.col("__s") - F.lag("__e").over(along) > gap, F.lit(True)))
    pieces = pieces.withColumn("session_no", F.sum(F.col("__new").cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    out = pieces.groupBy("__u", "session_no").agg(F.min("__s").alias("start_ts"), F.max("__e").alias("end_ts"), F.sum("__n").alias("n_events"), *sums)
    return out.select(
        F.col("__u").alias(user), "session_no", "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration"), "n_events", *[F.col(f"__k{i}").alias(name) for i, name in enumerate(kinds)]
    )
