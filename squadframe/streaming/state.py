"""Keyed state over streams: the first row of a key wins, and votes remembered until their hour is over.

The processors keep one small value for each key in the state store (RocksDB, so state may outgrow memory), and go on
where they were after a restart from their checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.votes import KEY, vote_bucket
from ..sources.adapter import table, votes
from ..sources.files import MATCHES, shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Processors need the RocksDB store; a session that names another one keeps its setting for other queries only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def first_wins(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The stream's rows without those whose key has come before: of rows that arrive together the first by `order`
    stays, and what a later batch brings of a known key changes nothing. The order columns must not be null. To be
    written in mode `update`, as keep_first does.

    One aggregate holds the first row of a key, by the time of the batch and then by order, and the time of the newest
    batch that brought the key. Of the keys that a batch touches, those are new whose first and newest batch are the same.
    A batch's time is in its log, so a replay has the same.
    """
    use_state_store(stream.sparkSession)
    others = [c for c in stream.columns if c not in keys and c not in order]
    rows = stream.withColumn("at_batch", F.current_timestamp())
    known = rows.groupBy(*keys).agg(F.min(F.struct("at_batch", *order, F.struct(F.lit(0), *others).alias("others"))).alias("first"), F.max("at_batch").alias("newest"))
    held = {c: f"first.others.{c}" for c in others} | {c: f"first.{c}" for c in order} | {c: c for c in keys}
    return known.where("newest = first.at_batch").select(*[F.col(held[c]).alias(c) for c in stream.columns])


def keep_first(firsts: DataFrame, to: str, checkpoint: str, trigger: dict[str, Any] | None = None):
    """Starts the stream that adds what first_wins lets through to the table at `to`, each batch as a partition of its
    own, so a batch that is replayed replaces what it wrote."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

    return firsts.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def arriving_teams(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """Teams of the match files that arrive in a folder, in the order of the files' times and names and of their places."""
    read = spark.readStream.schema(MATCHES).option("multiLine", True)
    read = read.option("maxFilesPerTrigger", files_at_once) if files_at_once else read
    rows = read.json(folder).select(F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file"), F.posexplode("teams").alias("at", "team"))
    return rows.where("team.gameId is not null and team.teamKey is not null").select("arrived", "file", "at", "team.*")


def accumulate(spark: SparkSession, folder: str, to: str, checkpoint: str, trigger: dict[str, Any] | None = None, files_at_once: int | None = None):
    """Starts the stream that adds the teams of arriving files to the table at `to`, each (gameId, teamKey) once.

    trigger is what DataStreamWriter.trigger takes; by default all that is there is taken and the stream ends.
    """
    teams = first_wins(arriving_teams(spark, folder, files_at_once), ["gameId", "teamKey"], ["arrived", "file", "at"])
    return keep_first(teams, to, checkpoint, trigger)


#: Slices that the keys of votes are dealt to; a slice's keys are one value in the state store.
SLICES = 2048


class RecentVotes(StatefulProcessor):
    """Flags votes whose key voted before in the same hour. A key's state is its newest hour; when the watermark passes
    the end of that hour, the state is dropped and an `expired` row says so.

    The keys of a slice are handled together as a frame, so a vote costs no call of its own to the state store: their
    newest hours are one value, with one timer for the earliest of their ends.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("hours", "hours binary, next long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.held.get()
        votes = pd.concat(list(rows), ignore_index=True)
        votes = votes.sort_values(["at", "vote_id"], kind="stable", ignore_index=True)
        known = [*KEY, "bucket", "ends"]
        hours = self._read(state)
        both = votes if hours is None else pd.concat([hours[known], votes], ignore_index=True)
        # known hours come first, so that a vote of one is a repetition
        repeated = both.duplicated([*KEY, "bucket"]).to_numpy()[len(both) - len(votes):]
        yield votes[[*KEY, "vote_id", "bucket"]].assign(kind="vote", was_duplicate=repeated)
        newest = both.sort_values("bucket", kind="stable")[known].drop_duplicates(KEY, keep="last")
        self._keep(newest, state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self.held.get()
        hours = self._read(state)
        if hours is not None:
            over = hours["ends"] <= timerValues.getCurrentWatermarkInMs()
            self._keep(hours[~over], None)
            yield hours.loc[over, [*KEY, "bucket"]].assign(vote_id=None, kind="expired", was_duplicate=None)[[*KEY, "vote_id", "bucket", "kind", "was_duplicate"]]

    @staticmethod
    def _read(state: tuple | None) -> pd.DataFrame | None:
        return None if state is None else pa.ipc.open_stream(bytes(state[0])).read_pandas()

    def _keep(self, hours: pd.DataFrame, state: tuple | None) -> None:
        """Keeps the hours and moves the timer, if the earliest end is another than that of the state held before."""
        if not len(hours):
            self.held.clear()
            return
        table, sink = pa.Table.from_pandas(hours, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        first = int(hours["ends"].min())
        if state is None or state[1] != first:
            if state is not None:
                self.handle.deleteTimer(state[1])
            self.handle.registerTimer(first)
        self.held.update((sink.getvalue().to_pybytes(), first))

    def close(self) -> None:
        pass


def recent_votes(stream: DataFrame, delay: str = "1 hour", slices: int = SLICES) -> DataFrame:
    """Every vote of the stream with was_duplicate, and a row of kind `expired` when a key's hour is over and forgotten.

    ts is a timestamp; votes that come later than the delay are dropped by the watermark. The number of slices is part of
    the state: a stream goes on with the number it began with.
    """
    use_state_store(stream.sparkSession)
    ends = F.unix_millis(F.date_trunc("hour", F.col("ts")) + F.expr("interval 1 hour"))
    rows = stream.select(*KEY, "vote_id", "ts", vote_bucket(F.col("ts")).alias("bucket"), ends.alias("ends")).withWatermark("ts", delay)
    # keys as text: frames would make numbers with nulls among them doubles; and times of any year sort as microseconds
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(*KEY), F.lit(slices)).cast("int")).withColumn("at", F.unix_micros("ts")).withColumns({c: F.col(c).cast("string") for c in KEY})
    out = ", ".join(f"{c} string" for c in KEY) + f", vote_id {stream.schema['vote_id'].dataType.simpleString()}, bucket string, kind string, was_duplicate boolean"
    flagged = rows.groupBy("slice").transformWithStateInPandas(statefulProcessor=RecentVotes(), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return flagged.withColumns({c: F.col(c).cast(stream.schema[c].dataType) for c in KEY})


def _as_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; the pattern also finds a table that is a single file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _run(out: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote."""
    to = shared_folder(out.sparkSession, f"streams/{name}")
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start(f"{to}/rows").awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{to}/rows")


def streamed_first_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First wins over the orders as they arrive: of each customer and day the order with the lowest key."""
    rows = _as_stream(spark, sf_dir, "orders").selectExpr("o_custkey", "cast(o_orderdate as date) as day", "o_orderkey", "o_totalprice")
    firsts, to = first_wins(rows, ["o_custkey", "day"], ["o_orderkey"]), shared_folder(spark, "streams/first")
    keep_first(firsts, f"{to}/rows", f"{to}/checkpoint").awaitTermination()
    return spark.read.schema(firsts.schema).parquet(f"{to}/rows").select(*firsts.columns)


def streamed_recent_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vote flagged by a stream if its hour already had one of the same key."""
    rows = votes(spark, sf_dir, _as_stream(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(recent_votes(rows), "recent").where("kind = 'vote'").select("vote_id", "bucket", "was_duplicate")
