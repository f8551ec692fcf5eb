"""Queries read their whole tables: small tables of their own, against brute force."""

import random

from pyspark.sql import functions as F

from squadframe.operators import search, stats, text


def test_graph_expand_depth2_walks_the_whole_graph(spark, tmp_path):
    r = random.Random(4)
    edges = [(0, 7), (1, 8), (2, 9), (5, 7), (5, 11), (6, 11)] + [(r.randrange(3, 90), r.randrange(7, 150)) for _ in range(120)]
    spark.createDataFrame(edges, "l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    depth = {u: 0 for u, _ in edges if u < 3}
    for step in (1, 2):
        games = {g for u, g in edges if depth.get(u) == step - 1}
        for u in {u for u, g in edges if g in games}:
            depth.setdefault(u, step)
    assert set(depth.values()) == {0, 1, 2}
    assert {x["u"]: x["depth"] for x in search.graph_expand_depth2(spark, str(tmp_path)).collect()} == depth


def test_initial_search_reads_the_whole_text(spark, tmp_path):
    rows = [(1, "the a b"), (2, "a b c d Other"), (3, "a b c d"), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(x["doc_id"] for x in text.initial_search(spark, str(tmp_path)).collect()) == [1, 2]


def test_stat_id_resolution_reads_the_whole_table(spark, tmp_path):
    rows = [("A", "x", 1), ("A", "y", 50), ("B", "x", 30), ("B", "x", 2)]
    spark.createDataFrame(rows, "p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(x) for x in stats.stat_id_resolution(spark, str(tmp_path)).collect()}
    assert got == {("A", "A:x", "A:x"), ("A", "A:y", "A:y"), ("B", "B:x", "B:x")}


def test_capped_walk_against_brute_force(spark):
    r = random.Random(12)
    edges = [(r.randrange(40), r.randrange(90)) for _ in range(300)] + [(0, 5), (0, 5)]
    for depth, games, most in ((0, 3, 9), (1, 2, 4), (2, 3, 6), (3, 100, 100)):
        own = {u: sorted({g for v, g in edges if v == u})[:games] for u, _ in edges}
        users, found, added = {}, {}, {0, 1, 2} & {u for u, _ in edges}
        for level in range(depth + 1):
            taken = sorted(added)[:most]
            users |= dict.fromkeys(taken, level)
            new = {g for u in taken for g in own[u]} - set(found)
            found |= dict.fromkeys(new, level)
            added = {u for u, g in edges if g in new} - set(users)
        table = spark.createDataFrame(edges, "u int, g int")
        got = {(x["kind"], x["id"]): x["level"] for x in search.capped_walk(table, table.where("u < 3"), depth, games, most).collect()}
        assert got == {("user", u): k for u, k in users.items()} | {("game", g): k for g, k in found.items()}


def test_union_combos_scored_searches_all_members(spark, monkeypatch):
    """Rosters of more than a dozen members: every pair of two rosters meets every member of the third."""
    ids = [f"Brand#{k}:{c * n}" for k in (3, 4, 5) for n in range(1, 20) for c in ("A" if k != 5 else "B")]
    stats = spark.createDataFrame([("all", x, 100 - i, 1 / (i + 2)) for i, x in enumerate(ids)], "bucket string, stat_id string, games long, win_rate double")
    roster = {x["id"]: x["roster"] for x in search._rosters(stats, None).collect()}
    assert set(roster) == set(ids) and max(list(roster.values()).count(k) for k in range(3)) > 12
    worst = {k: max((x for x in ids if roster[x] == k), key=lambda x: (x.split(":")[0] == f"Brand#{k + 3}", ids.index(x))) for k in range(3)}
    monkeypatch.setattr(search, "Base", lambda spark, sf_dir: type("B", (), {"stats": stats}))
    seen = []

    def scored(base, asked, pool):
        seen.append((asked.count(), pool.count()))
        return pool.join(asked, "sel").select("sel", "variant", F.when(F.forall(F.concat("picked", F.array("variant")), lambda v: v.isin(list(worst.values()))), 9.0).otherwise(1.0).alias("total"))

    monkeypatch.setattr(search, "evaluated", scored)
    best = search.union_combos_scored(spark, "").first()
    who = lambda x: x.split(":")[0]
    assert len({who(x) for x in worst.values()}) == 3 and (best["id0"], best["id1"], best["id2"], best["score"]) == (*(worst[k] for k in range(3)), 9.0)
    assert seen[0][0] == sum(roster[a] < roster[b] and who(a) != who(b) for a in ids for b in ids)
