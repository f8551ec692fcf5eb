"""Votes as a stream: latest value per user, team, candidate and hour, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.votes import KEY, vote_bucket


def hourly_counts(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Windowed counts with a watermark; late rows within the delay still count."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "tier").agg(F.count("*").alias("votes"), F.sum("value").alias("balance"))


class UpsertSink:
    """foreachBatch sink: merges each batch into a table of latest votes, partitioned by hour.

    Only the hours that a batch touches are read and written again. A batch that is replayed merges to the same rows, so
    the sink is idempotent; all its state is the table, so it goes on after a restart. Several hours are not replaced in one
    step: if a batch fails between two of them, readers see some of its hours until its replay. Votes carry vote_id, which
    decides at equal times.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        names = [*KEY, "bucket", "value", "ts", "vote_id"]
        rows = batch.withColumn("bucket", vote_bucket(F.col("ts"))).select(*names)
        # a batch spans few hours (as many as its votes are late), and as values they prune the table's partitions
        hours = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        known = self._table()
        if known is not None:
            rows = rows.unionByName(known.where(F.col("bucket").isin(hours)).select(*names))
        latest = rows.groupBy(*KEY, "bucket").agg(F.max_by(F.struct("value", "ts", "vote_id"), F.struct("ts", "vote_id")).alias("v")).select(*KEY, "bucket", "v.*")
        # read and written in one place: by way of a staging table
        latest.write.mode("overwrite").parquet(f"{self.path}/staging")
        staged = self.spark.read.schema(latest.schema).parquet(f"{self.path}/staging")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/votes")

    def _table(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            found = self.spark.read.option("recursiveFileLookup", False).parquet(f"{self.path}/votes")
        except AnalysisException:  # nothing written yet
            return None
        return found.withColumn("bucket", F.col("bucket").cast("string"))

    def latest(self) -> DataFrame:
        found = self._table()
        if found is None:
            raise ValueError(f"no votes at {self.path}")
        return found.select(*KEY, "bucket", "value", "ts")
