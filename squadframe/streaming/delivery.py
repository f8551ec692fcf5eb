"""Delivery with a queue: rows that a receiver refuses wait and are tried again, each is delivered once it is accepted."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists


class RetryQueue:
    """foreachBatch sink that sends rows by their id.

    `send` gets a pandas frame of rows (in the tasks that hold them) and returns which were accepted. A batch tries what
    waits and what is new; accepted rows leave the queue, the others stay with attempts + 1. Rows whose id waits already
    keep their place and take the newer reason; ids that were delivered are not sent again. A batch writes one version of
    the queue and of the deliveries under its own number, so a batch that is replayed after a failure starts from the
    version before it: rows are sent at least once, with the same id.
    """

    def __init__(self, spark: SparkSession, path: str, send: Callable[[pd.DataFrame], pd.Series], schema: str, id_col: str = "id"):
        self.spark, self.path, self.send, self.schema, self.id_col = spark, path.rstrip("/"), send, schema, id_col

    def _versions(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/queue"):
            return []
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/queue")
        found = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at)
        names = [f.getPath().getName() for f in found if exists(self.spark, f"{f.getPath()}/_SUCCESS")]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def _queue(self, version: int | None) -> DataFrame:
        kind = f"{self.schema}, attempts int"
        return self.spark.createDataFrame([], kind) if version is None else self.spark.read.schema(kind).parquet(f"{self.path}/queue/version={version}")

    def waiting(self) -> DataFrame:
        """What waits after the last batch, with the attempts so far."""
        versions = self._versions()
        return self._queue(versions[-1] if versions else None)

    def delivered(self) -> DataFrame:
        """(id, batch) of all accepted rows."""
        kind = f"{self.id_col} {self._queue(None).schema[self.id_col].dataType.simpleString()}, batch long"
        return self.spark.read.schema(kind).parquet(f"{self.path}/delivered") if exists(self.spark, f"{self.path}/delivered") else self.spark.createDataFrame([], kind)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        i, before = self.id_col, [v for v in self._versions() if v < batch_id]
        held = self._queue(before[-1] if before else None)
        names = [c for c in held.columns if c != "attempts"]
        rows = batch.select(*names).withColumn("attempts", F.lit(0)).dropDuplicates([i])
        done = self.delivered().where(F.col("batch") < batch_id).select(i)
        rows = rows.join(done, i, "left_anti")
        # an id that waits keeps its row and its attempts; only the reason is taken from the newer one
        old = held.join(rows.select(i, F.col("reason").alias("_reason")), i, "left").withColumn("reason", F.coalesce("_reason", "reason")).drop("_reason") if "reason" in names else held
        tried = old.select(*held.columns).unionByName(rows.join(held.select(i), i, "left_anti").select(*held.columns))
        send = self.send

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(accepted=list(send(frame))) if len(frame) else frame.assign(accepted=pd.Series(dtype=bool))

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tried.schema)
        outcome = tried.mapInPandas(each, f"{fields}, accepted boolean")
        # written once, so that what was sent and what is kept agree
        outcome.write.mode("overwrite").parquet(f"{self.path}/tried/batch={batch_id}")
        outcome = self.spark.read.schema(outcome.schema).parquet(f"{self.path}/tried/batch={batch_id}")
        outcome.where("accepted").select(i).write.mode("overwrite").parquet(f"{self.path}/delivered/batch={batch_id}")
        left = outcome.where("not accepted").withColumn("attempts", F.col("attempts") + 1).select(*held.columns)
        left.write.mode("overwrite").parquet(f"{self.path}/queue/version={batch_id}")


def deliver(stream: DataFrame, queue: RetryQueue, checkpoint: str, trigger: dict[str, Any] | None = None):
    """Starts sending a stream; trigger is what DataStreamWriter.trigger takes (say {"processingTime": "10 minutes"}), by
    default all that is there is taken and the stream ends."""
    return stream.writeStream.foreachBatch(queue).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def flush(queue: RetryQueue) -> None:
    """Tries what waits without any new rows, as a batch after the last one."""
    versions = queue._versions()
    queue(queue.waiting().drop("attempts").limit(0), versions[-1] + 1 if versions else 0)
