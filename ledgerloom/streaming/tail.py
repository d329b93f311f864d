"""Streaming refresh: fold a stream of log entries into a materialised latest view."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.config import IDX, SEG, TableConfig
from ledgerloom.table import LogTable


def _newest(df: DataFrame, pk: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(pk).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


class MaterialisedLatest:
    """Latest row per key of a stream of log files, kept in a :class:`LogTable`.

    Each micro-batch is reduced to one row per key; rows that are newer than the
    table's are appended in one commit, which also carries the batch id.  A batch that
    is delivered again after a failure changes nothing, and late files cannot bring
    older rows back.  Since the log order of the table is then the order of the stream,
    the table may be compacted at any time.
    """

    MARK = "stream"

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, pk: str, order: Sequence[str]):
        self.spark, self.pk, self.order, self.schema, self.root = spark, pk, tuple(order), schema, root
        self.table = LogTable.open(spark, TableConfig(os.path.join(root, "table"), schema, pk))

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        done = self.table.mark(self.MARK)
        if done is not None and batch_id <= done:
            return
        top = _newest(batch, self.pk, self.order)
        # only keys of the batch are looked up: the table's history is filtered before it is reduced
        keys = batch.select(F.col(self.pk).alias("__pk")).distinct()
        log = self.table.log()
        near = log.join(keys, F.col(self.pk).eqNullSafe(F.col("__pk")), "left_semi")
        current = _newest(near, self.pk, (SEG, IDX)).select(F.col(self.pk).alias("__pk"), F.struct(*self.order).alias("__at"))
        newer = F.col("__at").isNull() | (F.struct(*self.order) > F.col("__at"))
        top = top.join(current, F.col(self.pk).eqNullSafe(F.col("__pk")), "left").where(newer)
        self.table.upsert_df(top.select(*self.schema.names), mark=(self.MARK, batch_id), assume_unique=True)
        self.table.maintain()  # compacts once a segment is full

    def run(self, source_dir: str, files_per_trigger: int = 1) -> None:
        """Process everything that has arrived, then stop; restarts resume from the checkpoint."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
        q = stream.writeStream.foreachBatch(self._apply).option("checkpointLocation", os.path.join(self.root, "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()

    def latest(self) -> DataFrame:
        return self.table.latest()
