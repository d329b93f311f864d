"""Enough partitions for work that is bound by Python, not by reading."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores if the input has fewer partitions than there are cores.

    A small table in one file would keep one core busy.  Inputs of many files have
    more partitions than cores and are left as they are: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
