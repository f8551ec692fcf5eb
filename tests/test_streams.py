"""Streams with state: arriving files, votes that expire, deliveries that are tried again."""

import datetime
import json
import os

import pandas as pd
from pyspark.sql import functions as F

from squadframe.sources import files
from squadframe.streaming import delivery, state


def put(folder, name, teams, at):
    path = folder / name
    path.write_text(json.dumps({"teams": [{"gameId": g, "teamKey": k, "rank": r} for g, k, r in teams]}))
    os.utime(path, (at, at))


def test_first_team_wins_as_files_arrive(spark, tmp_path):
    inbox, to, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    inbox.mkdir()
    got = lambda: sorted((r.gameId, r.teamKey, r["rank"]) for r in spark.read.parquet(to).collect())
    put(inbox, "b.json", [(1, "x", 1), (1, "x", 9), (2, "y", 2), (None, "z", 3)], 1_000_000)
    put(inbox, "a.json", [(1, "x", 7), (3, "w", 3)], 2_000_000)
    state.accumulate(spark, str(inbox), to, log).awaitTermination()
    assert got() == [(1, "x", 1), (2, "y", 2), (3, "w", 3)]
    put(inbox, "c.json", [(3, "w", 8), (2, "y", 8), (4, "v", 4)], 3_000_000)
    state.accumulate(spark, str(inbox), to, log).awaitTermination()  # as after a restart
    first = got()
    assert first == [(1, "x", 1), (2, "y", 2), (3, "w", 3), (4, "v", 4)]
    state.accumulate(spark, str(inbox), to, log).awaitTermination()  # nothing new
    assert got() == first
    batch = files.match_teams(spark, *[str(inbox / x) for x in ("b.json", "a.json", "c.json")])
    assert sorted((r.gameId, r.teamKey, r["rank"]) for r in batch.collect()) == first
    # one file at a time, from nothing, gives the same
    state.accumulate(spark, str(inbox), str(tmp_path / "out2"), str(tmp_path / "log2"), files_at_once=1).awaitTermination()
    assert sorted((r.gameId, r.teamKey, r["rank"]) for r in spark.read.parquet(str(tmp_path / "out2")).collect()) == first


def test_votes_are_forgotten_after_their_hour(spark, tmp_path):
    inbox, to, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    schema = "user_id long, tier string, team_key string, candidate_id string, vote_id long, ts timestamp"
    day = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC)
    number = iter(range(1, 99))

    def batch(*rows):
        made = [(u, "all", "a+b", "c", next(number), (day + datetime.timedelta(minutes=m)).replace(tzinfo=None)) for u, m in rows]
        spark.createDataFrame(made, "user_id long, tier string, team_key string, candidate_id string, vote_id long, t timestamp_ntz").withColumn("ts", F.col("t").cast("timestamp")).drop("t").write.mode("append").parquet(inbox)
        out = state.recent_votes(spark.readStream.schema(schema).parquet(inbox), "30 minutes")
        out.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(to).awaitTermination()

    batch((1, 5), (1, 50), (2, 10))
    batch((1, 55), (2, 61), (1, 25))  # a restart between; 2 begins a new hour, 1 is in the old one, late but in time
    batch((3, 400))  # the watermark passes both hours
    batch((1, 405), (3, 410))
    batch((4, 900))
    rows = spark.read.parquet(to).collect()
    flags = {r.vote_id: r.was_duplicate for r in rows if r.kind == "vote"}
    assert flags == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: False, 9: True, 10: False}
    expired = sorted((r.user_id, r.bucket) for r in rows if r.kind == "expired")
    assert expired == [(1, "2024-05-01T00"), (1, "2024-05-01T06"), (2, "2024-05-01T01"), (3, "2024-05-01T06")]


def test_deliveries_are_tried_until_accepted(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    def send(frame: pd.DataFrame) -> pd.Series:
        """Refuses `bad` twice and `never` always; notes every call."""
        out = []
        for row in frame.itertuples():
            with open(f"{calls}/{row.id}", "a") as f:
                f.write("x")
            out.append(not (row.id == "never" or row.id == "bad" and row.attempts < 2))
        return pd.Series(out)

    tries = lambda i: len(open(f"{calls}/{i}").read())
    at, schema = str(tmp_path / "queue"), "id string, value int, reason string"
    queue = delivery.RetryQueue(spark, at, send, schema)
    assert queue.waiting().count() == 0 and queue.delivered().count() == 0
    rows = lambda *x: spark.createDataFrame(x, schema)
    queue(rows(("good", 1, "a"), ("bad", 2, "a"), ("bad", 2, "a"), ("never", 3, "a")), 0)
    assert sorted(map(tuple, queue.waiting().collect())) == [("bad", 2, "a", 1), ("never", 3, "a", 1)]
    queue = delivery.RetryQueue(spark, at, send, schema)  # as after a restart
    queue(rows(("good", 1, "again"), ("never", 3, "newer")), 1)
    assert sorted(map(tuple, queue.waiting().collect())) == [("bad", 2, "a", 2), ("never", 3, "newer", 2)]
    queue(rows(("good", 1, "again"), ("never", 3, "newer")), 1)  # the batch comes again
    assert sorted(map(tuple, queue.waiting().collect())) == [("bad", 2, "a", 2), ("never", 3, "newer", 2)]
    delivery.flush(queue)
    assert sorted(map(tuple, queue.waiting().collect())) == [("never", 3, "newer", 3)]
    assert sorted((r.id, r.batch) for r in queue.delivered().collect()) == [("bad", 2), ("good", 0)]
    assert (tries("good"), tries("bad")) == (1, 4)


def test_delivery_of_a_stream(spark, tmp_path):
    inbox, schema = str(tmp_path / "in"), "id string, value int"
    queue = delivery.RetryQueue(spark, str(tmp_path / "queue"), lambda frame: frame["attempts"] >= frame["value"], schema)
    for rows in ([("a", 0), ("b", 1)], [("c", 2)], [("a", 0), ("d", 0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        delivery.deliver(spark.readStream.schema(schema).parquet(inbox), queue, str(tmp_path / "log"), {"availableNow": True}).awaitTermination()
    assert sorted((r.id, r.batch) for r in queue.delivered().collect()) == [("a", 0), ("b", 1), ("d", 2)]
    assert [tuple(r) for r in queue.waiting().collect()] == [("c", 2, 2)]


def test_first_wins_keeps_its_state_without_python(spark, tmp_path):
    """A key's first row stays over restarts, nulls among what it carries included, and no row passes through Python."""
    inbox, schema = str(tmp_path / "in"), "k long, at long, v string"
    for rows in ([(1, 5, "b"), (1, 2, None), (2, 9, "c"), (None, 1, "n")], [(1, 1, "late"), (3, 1, "d"), (3, 0, "e"), (None, 0, "late")], [(2, 0, "late")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        firsts = state.first_wins(spark.readStream.schema(schema).parquet(inbox), ["k"], ["at"])
        stream = state.keep_first(firsts, str(tmp_path / "out"), str(tmp_path / "log"))
        stream.awaitTermination()
        assert "InPandas" not in stream._jsq.explainInternal(False)
    got = spark.read.parquet(str(tmp_path / "out")).select("k", "at", "v").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, None), (2, 9, "c"), (None, 1, "n"), (3, 0, "e")], key=str)


def test_votes_of_a_slice_keep_their_keys_apart(spark, tmp_path):
    """Keys that share a slice, one of them null and one beyond doubles, over a restart, out of one call for all of them."""
    big, schema = 2**60 + 1, "user_id long, tier string, team_key string, candidate_id string, vote_id long, ts timestamp"
    inbox, at = str(tmp_path / "in"), lambda h, m: datetime.datetime(2024, 5, 1, h, m, tzinfo=datetime.UTC)
    for rows in ([(big, 1, at(0, 1)), (big + 1, 2, at(0, 2)), (None, 3, at(0, 3)), (None, 4, at(0, 4)), (7, 5, at(0, 5))], [(big, 6, at(0, 6)), (None, 7, at(1, 0)), (7, 8, at(1, 1))]):
        spark.createDataFrame([(u, "all", None, "c", n, t) for u, n, t in rows], schema).write.mode("append").parquet(inbox)
        out = state.recent_votes(spark.readStream.schema(schema).parquet(inbox), "5 hours", slices=1)
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.vote_id: (r.user_id, r.was_duplicate) for r in rows} == {
        1: (big, False), 2: (big + 1, False), 3: (None, False), 4: (None, True), 5: (7, False), 6: (big, True), 7: (None, False), 8: (7, False)}
