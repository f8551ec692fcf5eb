"""Files in and out."""

import json

import pytest

from pyspark.sql import Row

from squadframe.sources import files, remote


def team(game, key, rank, players=()):
    return {"gameId": game, "teamKey": key, "rank": rank, "players": list(players), "more": 1}


def test_match_teams(spark, tmp_path):
    player = {"character": 3, "traits": {"core": "7", "firstSub": ["1", "2"], "secondSub": 5}, "stats": {"kills": 2}}
    (tmp_path / "a.json").write_text(json.dumps({"teams": [team(1, "x", 1, [player]), team(1, "x", 9), team(None, "x", 2)]}))
    (tmp_path / "b.json").write_text(json.dumps({"source": "s", "teams": [team(1, "x", 5), team(2, "y", 4)]}))
    (tmp_path / "c.json").write_text("no json")
    got = files.match_teams(spark, *[str(tmp_path / x) for x in ("a.json", "b.json", "c.json")])
    assert sorted((r.gameId, r.teamKey, r["rank"]) for r in got.collect()) == [(1, "x", 1), (2, "y", 4)]
    rows = files.match_players(got).collect()
    assert [(r.character, r.core, r.firstSub, r.secondSub, r.kills, r.assists) for r in rows] == [(3, "7", ["1", "2"], ["5"], 2.0, None)]


def test_metrics_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("\ufeffid,name,difficulty,damage,defense,crowdControl,mobility,utility\na,A b,1,2,3,4,5,1\nb,B,0,2,3,4,5,1\n,C,1,2,3,4,5,1\nd,\"D, e\",1,2,3,,5,1\n", encoding="utf-8")
    assert [tuple(r) for r in files.metrics_csv(spark, str(tmp_path / "m.csv")).collect()] == [("a", "A b", 1, 2, 3, 4, 5, 1)]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([Row(a='x "y", z', b=1), Row(a=None, b=2)])
    files.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(spark.read.json(str(tmp_path / "j")).collect(), key=lambda r: r.b) == df.collect()
    files.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()
    assert sorted((r.b, r.a) for r in back) == [("1", 'x "y", z'), ("2", None)]


def test_json_paths(spark):
    df = spark.createDataFrame([('{"k": 3, "s": "t"}',), ('{"k": -1}',), (None,), ("broken",)], "p string")
    assert {tuple(r) for r in files.json_paths(df, "p").collect()} == {("k", 2, 2, -1.0, 3.0), ("s", 1, 0, None, None)}


def test_files_that_are_not_there_and_strict_metrics(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert files.match_teams(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.csv").write_text("id,name,damage\na,A,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.metrics_csv(spark, str(tmp_path / "m.csv"))
    (tmp_path / "n.csv").write_text("id,name,difficulty,damage,defense,crowdControl,mobility,utility\na,A,1,2,3,4,5,6\n")
    with pytest.raises(Exception, match="utility of a is no number"):
        files.metrics_csv(spark, str(tmp_path / "n.csv"), strict=True).collect()


def test_pages_and_stored_json(spark, tmp_path):
    for page, ids in ((1, [1, 2]), (2, [3]), (3, []), (4, [9])):
        (tmp_path / f"{page}.json").write_text(json.dumps({"rows": [{"id": i} for i in ids]}))
    assert [r.id for r in files.pages(spark, str(tmp_path), "rows", 10, "id: int").collect()] == [1, 2, 3]
    assert [r.id for r in files.pages(spark, str(tmp_path), "rows", 2, "id: int").collect()] == [1, 2]
    assert files.pages(spark, str(tmp_path / "no"), "rows", 2, "id: int").count() == 0
    (tmp_path / "kv.json").write_text('{"likes": 3}')
    assert files.stored_json(spark, str(tmp_path / "kv.json"), "likes int").collect()[0].likes == 3
    (tmp_path / "kv.json").write_text("broken")
    assert files.stored_json(spark, str(tmp_path / "kv.json"), "likes int").collect()[0].likes is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, bucket string")
    at = str(tmp_path / "p")
    files.write_partitions(df, at, "bucket")
    files.write_partitions(spark.createDataFrame([(7, "b")], "id int, bucket string"), at, "bucket")
    assert sorted((r.id, r.bucket) for r in spark.read.parquet(at).collect()) == [(1, "a"), (7, "b")]
    files.append_rows(df, str(tmp_path / "log"))
    files.append_rows(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    files.write_breakdown(df, str(tmp_path / "b"), "bucket")
    assert spark.read.json(str(tmp_path / "b/breakdown")).count() == 2
    files.write_csv(df.coalesce(1), str(tmp_path / "c"), mark=True)
    assert next((tmp_path / "c").glob("*.csv")).read_text(encoding="utf-8").startswith("\ufeffid,bucket")
    files.swap_table(spark, "swapped", str(tmp_path / "log"))
    files.swap_table(spark, "swapped", at)
    assert spark.table("swapped").count() == 2
    assert remote.cache_name("a?b>") == "YT9iPg.json"
    assert spark.createDataFrame([("ｱﾞＡ①",), (None,)], "x string").select(files.nfkc("x")).collect()[0][0] == "ア゙A1"


def test_stored_answers(spark, tmp_path):
    at, schema = str(tmp_path / "answers"), "cache_key string, fetched_at long, payload string"
    read = lambda: files.newest_rows(spark, at, schema, ["cache_key"], "fetched_at")
    assert read().count() == 0
    files.append_rows(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", None, "z")], schema), at)
    files.append_rows(spark.createDataFrame([("a", 5, "new"), ("b", 2, "yy"), ("b", 1, "old"), ("c", 0, "w"), (None, 3, "n")], schema), at)
    assert {tuple(r) for r in read().collect()} == {("a", 5, "new"), ("b", 2, "yy"), ("c", 0, "w"), (None, 3, "n")}
    wanted = spark.createDataFrame([("a",), ("q",)], "cache_key string")
    assert [r[0] for r in files.not_stored(wanted, read(), ["cache_key"]).collect()] == ["q"]
