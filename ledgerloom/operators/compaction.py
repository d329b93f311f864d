"""Segment-local dedup and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.state import LogView


def compact_segments(view: LogView, seg: Column, seg_name: str = "seg") -> DataFrame:
    """Last row per (segment, key), tombstones kept: an older segment may hold the key."""
    df = view.df.withColumn(seg_name, seg)
    w = Window.partitionBy(seg_name, view.pk).orderBy(*[F.col(c).desc() for c in view.order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def segment_stats(view: LogView, seg: Column, seg_name: str = "seg") -> DataFrame:
    """Rows and distinct keys per segment.

    Grouping by (segment, key) first keeps the distinct count from gathering a
    segment in one task and combines map-side.
    """
    per_key = view.df.groupBy(seg.alias(seg_name), F.col(view.pk).alias("__pk")).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.groupBy(seg_name).agg(F.sum("__n").alias("n_rows"), F.count("__pk").alias("n_unique"))
