"""Payloads: discovery, search and team assembly against plain Python on nested, odd and broken JSON."""

import json

from pyspark.sql import functions as F

from squadframe.operators import payload

ODD = [
    '{"b": [1, {"x": null, "c": [[], [5]]}, [2], [3, 4, 5, 6, 7]], "a": {"c": "s", "d": [{"k": 1, "j": 2}], "e": true}}', "[1, 2]", '"text"', "no json", "", None, "{}", "null", "[]", '{"z": [], "y": [{"m": 1}, {"n": 2}], "x": [0, 1]}',
    json.dumps({"deep": {"er": {"and": {"er": [{"v": [1, 2, 3, 4]}] * 5}}}}), json.dumps({"many": [{"i": i, "more": list(range(i))} for i in range(6)]}),
]


def arrays(value, path=()):
    """(path, array) of every array, fields by name, three items of each array."""
    if isinstance(value, list):
        yield ".".join(path) or "$", value
        for x in value[:3]:
            yield from arrays(x, (*path, "[]"))
    elif isinstance(value, dict):
        for k in sorted(value):
            yield from arrays(value[k], (*path, k))


def parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def test_discovery(spark):
    table = spark.createDataFrame(list(enumerate(ODD)), "id int, p string").repartition(3)
    got = {r["id"]: r for r in payload.payload_summary(table, "id", "p").collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        value = parsed(text)
        found = [(p, a) for p, a in arrays(value) if a]
        path, best = max(found, key=lambda x: len(x[1]), default=(None, []))
        keys = sorted(best[0]) if best and isinstance(best[0], dict) else []
        assert (got[i]["payload_keys"], got[i]["path"], got[i]["row_count"], got[i]["sample_keys"]) == (sorted(value) if isinstance(value, dict) else [], path, len(best), keys), text
    every = sorted((r["id"], r["path"], r["row_count"]) for r in payload.arrays_in(table, "id", "p").collect())
    assert every == sorted((i, p, len(a)) for i, t in enumerate(ODD) for p, a in arrays(parsed(t)) if a)
    assert payload.payload_summary(table.limit(0), "id", "p").count() == 0


def test_named_objects_and_user_ids(spark):
    rows = [
        '{"data": [{"code": 1, "name": "a", "inner": {"id": 9, "name": "in"}}, {"code": 2}, {"key": "k", "korName": ""}, {"key": "k", "korName": "n"}]}', '{"characterNum": 5, "nameKr": "x"}', '{"code": "", "name": "y", "id": 7}', '[[[{"id": 3, "name": "deep"}]]]', "no", None,
        '{"b": {"uid": "late"}, "a": [{"user_id": ""}, {"z": {"userId": 77}}, {"userId": 78}]}', '{"userId": null, "uid": "own", "a": {"userId": "inner"}}', '{"userId": {"x": 1}}',
    ]
    rows += ['{"a": [{"x": 1}, {"uid": 7}], "user_id": ""}', '[[], [{"user_id": 3}]]', '{"uid": 0, "c": {"uid": 4}}']
    table = spark.createDataFrame(list(enumerate(rows)), "id int, p string")
    named = sorted((r["id"], r["code"], r["name"]) for r in payload.named_objects(table, "id", "p").collect())
    assert named == [(0, "1", "a"), (0, "k", "n"), (1, "5", "x"), (2, "7", "y"), (3, "3", "deep")]
    ids = {r["id"]: r["user_id"] for r in payload.user_ids(table, "id", "p").collect()}
    assert ids == {0: None, 1: None, 2: None, 3: None, 4: None, 5: None, 6: "77", 7: "own", 8: '{"x":1}', 9: "7", 10: "3", 11: "4"}


def test_teams_from_raw_rows(spark):
    row = lambda team, who, **more: {"teamNumber": team, "characterNum": who, **more}
    games = [
        {"userGames": None, "games": [row(1, 5, gameRank=2, victory=False, playerKill=3, seasonId=30), row(2, 6, gameRank=0, victory=True), row(1, 7, gameRank=9, victory=True, kills="4", damageToPlayer="much")]},
        {"userGames": [], "games": [row(1, 5), row(1, 6)]},  # an empty array is an answer
        {"gameDetails": [{"teamId": "x", "character_code": "a", "victory": 1, "game_rank": "1", "traitFirstSub": [1, 2]}, {"team": "x", "characterNum": "", "characterCode": "b"}, {"team_id": "", "team": "y", "characterNum": 1}, {"characterNum": 2}, {"team": "y"}]},
        {"data": [row(3, 1, victory="no", gameRank=-1), row(3, 1, sightScore=2.5, totalDamageToPlayer=10), 5, None, []]},
        {"data": {"userGames": [row(1, 1), row(1, 2)]}}, [], None,
    ]
    table = spark.createDataFrame([(i, None if g is None else json.dumps(g)) for i, g in enumerate(games)] + [(9, "broken {")], "game_id int, p string").repartition(4)
    teams = payload.team_results(payload.assembled_teams(payload.game_rows(table, "game_id", "p"), "game_id"))
    got = {(r["game_id"], r["team_key"]): r for r in teams.collect()}
    assert set(got) == {(0, "1"), (2, "x"), (3, "3")}
    one, two, three = got[0, "1"], got[2, "x"], got[3, "3"]
    assert (one["rank"], one["victory"], one["season_id"], one["win"], one["top3"], one["placement"]) == (2, False, 30, False, True, 2)  # the first row's
    assert [(p["character"], p["kills"], p["damage"], p["rank"]) for p in one["players"]] == [("5", 3.0, 0.0, 2), ("7", 4.0, 0.0, 9)]
    assert (two["win"], two["placement"], two["players"][0]["first_sub"], [p["character"] for p in two["players"]]) == (True, 1, "[1,2]", ["a", "b"])
    assert (three["victory"], three["win"], three["placement"], three["top3"]) == (True, True, None, False)
    assert [(p["vision"], p["damage"]) for p in three["players"]] == [(0.0, 0.0), (2.5, 10.0)]
    assert set(payload.STATS) <= set(three["players"][0].asDict()) and len(payload.STATS) == 17


def test_teams_from_a_file(spark, tmp_path):
    answer = {"userGames": [{"teamNumber": 1, "characterNum": c, "gameRank": 1} for c in (3, 4, 5)]}
    (tmp_path / "7.json").write_text(json.dumps(answer))
    files = spark.read.text(str(tmp_path), wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).alias("game_id"), "value")
    teams = payload.assembled_teams(payload.game_rows(files, "game_id", "value"), "game_id").collect()
    assert [(t["game_id"], t["rank"], len(t["players"])) for t in teams] == [("7", 1, 3)]


def test_payloads_are_read_where_they_are(spark):
    """Discovery and search read each payload once: no shuffle, no table of nodes."""
    table = spark.createDataFrame(list(enumerate(ODD)), "id int, p string")
    for found in (payload.payload_summary, payload.arrays_in, payload.named_objects, payload.user_ids):
        plan = found(table, "id", "p")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "nodes-" not in plan
    odd = ['{"uid":0.0}', '{"uid":0.0,"x":{"uid":"0.0"}}', '{"uid":1.50}', '{"":[1]}', '{"a":[1],"a":[2]}', '{"a":[1,2]} more', '{"uid":NaN}']
    table = spark.createDataFrame(list(enumerate(odd)), "id int, p string")
    assert {r["id"]: r["user_id"] for r in payload.user_ids(table, "id", "p").collect()} == {0: None, 1: "0.0", 2: "1.5", 3: None, 4: None, 5: None, 6: None}
    assert sorted((r["id"], r["path"], r["row_count"]) for r in payload.arrays_in(table, "id", "p").collect()) == [(3, "", 1), (5, "a", 2)]


def test_payload_arrays_looks_into_every_item(spark, monkeypatch):
    rows = [(1, json.dumps({"a": [{"v": [1]}] * 3 + [{"v": [1, 2]}, {"w": [[], [5, 6, 7]]}]})), (2, '[[1, 2], [], [3], [4], [5, 6, 7, 8]]'), (3, "no json"), (4, json.dumps({"a": [[], [], [], [9]], "a.[]": [1]}))]
    table = spark.createDataFrame(rows, "game_id int, payload string")
    monkeypatch.setattr(payload, "game_payloads", lambda spark, sf_dir: table)
    got = {r["path"]: (r["payloads"], r["items"], r["longest"]) for r in payload.payload_arrays(spark, "").collect()}
    assert got == {"a": (2, 9, 5), "a.[].v": (1, 5, 2), "a.[].w": (1, 2, 2), "a.[].w.[]": (1, 3, 3), "$": (1, 5, 5), "[]": (1, 8, 4), "a.[]": (1, 2, 1)}
    assert (2, "[]", 4) in {(r["game_id"], r["path"], r["row_count"]) for r in payload.arrays_in(table, "game_id", "payload", None).collect()}


def test_teams_in_payloads_are_those_of_the_rows(spark):
    """Reading a payload once gives what rows of variants give, for odd values too, without a shuffle."""
    odd = ["1", '"1"', "1.0", "1.50", "-0", "0", "-7", "1e2", "12345678901234567890", "true", "false", "null", '""', '"\\u0000x"', '" 2 "', '"n\u00e9\u4e2d"', "[1,2]", "[]", '[1.5,"a"]', '{"b":1,"a":"x"}', '"NaN"', '"1d"', "0.1"]
    row = lambda team, x, more="": f'{{"teamNumber":{team},"characterNum":{x},"weapon":{x},"gameRank":{x},"victory":{x},"traitCore":{x},"kills":{x},"ccTime":{x}{more}}}'
    games = [f'{{"games":[{row(1, 1)},{row(1, x)},{row(x, x)},{row(x, 5)},{row("1.00", 6)}]}}' for x in odd]
    games += ['{"data":[], "games":[1]}', '{"userGames":{"a":1},"games":[' + row(1, 1) + "," + row(1, 2) + "]}", "[1]", "no", None, '{"games":[' + row(1, 1) + "," + row(1, 2, ',"kills":3') + "]}", '{"userGames":null,"gameDetails":[3,null,' + row(2, 9) + ",[]," + row(2, 8) + "]} more"]
    table = spark.createDataFrame(list(enumerate(games)), "game_id int, p string").repartition(3)
    rows = payload.assembled_teams(payload.game_rows(table, "game_id", "p"), "game_id")
    once = payload.teams_in(table, "game_id", "p")
    assert once.columns == rows.columns
    get = lambda df: sorted(map(repr, df.collect()))
    assert get(once) == get(rows) and once.count() > len(odd)
    assert "Exchange" not in payload.teams_in(spark.createDataFrame([(g,) for g in games], "p string").selectExpr("1 as game_id", "p"), "game_id", "p")._jdf.queryExecution().executedPlan().toString()
    few = payload.teams_in(table, "game_id", "p", ["kills"])
    assert few.columns == ["game_id", "team_key", "rank", "victory", "players"]
