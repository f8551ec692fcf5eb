"""Statistics don't depend on the order in which rows are added up, and look-ups take the first statistics that there are."""

import math
import random

import pytest

from squadframe.operators import recommend, stats
from squadframe.sources import adapter

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("query", [stats.official_trait_build, stats.official_candidate_stats, stats.official_combat_stats, stats.recency_weighted_pairs])
def test_same_at_any_number_of_partitions(spark, query):
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(as_rows(query(spark, SF)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got[0] and got[0] == got[1] == got[2]


def test_planted_ties_round_up_in_any_order(spark):
    """Sums of tenths that are whole only in exact arithmetic: their means lie at .5."""
    r = random.Random(2)
    rows = []
    for k in range(60):
        parts = [r.randrange(1, 4000) / 100 for _ in range(7)]
        total = round(sum(parts) * 100)
        parts.append((8 * (r.randrange(40, 90) * 100 + 50) - total) / 100)  # eight games, mean n + .5
        rows += [("b", f"m{k}", p, k) for p in parts]
    hoped = {}
    for _, m, p, _ in rows:
        hoped[m] = hoped.get(m, 0) + round(p * 100)
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        table = spark.createDataFrame(rows, "bucket string, stat_id string, damage double, k int").repartition(5)
        for c in ("rank", "basic", "skill", "item_skill", "direct", "unique_skill", "damage_from", "from_basic", "from_skill", "cc_time", "cc_count"):
            table = table.selectExpr("*", f"{'3' if c == 'rank' else 'damage'} as {c}")
        found = stats.finalized(stats.rolled_up(table, ["stat_id"], stats.SUMS), ["stat_id"], 1)
        for x in found.collect():
            assert x["avg_damage"] == hoped[x["stat_id"]] // 800 + 1 and math.isclose(x["basic_share"], 1.0), x


def test_known_stats_take_the_first_row_that_there_is(spark):
    held = [("d", "A:x", 1), ("d", "B", 2), ("all", "A:x", 3), ("all", "A", 4), ("all", "B:x", 5), ("all", "C:x", 6), ("all", "D", 7), ("d", "A", 8)]
    table = spark.createDataFrame(held, "bucket string, stat_id string, games int")
    members = spark.createDataFrame([(f"{c}:{w}", c) for c in "ABCDE" for w in "xy"], "variant string, character string")
    buckets = spark.createDataFrame([("d",), ("all",), ("e",)], "bucket string")
    got = {(x["bucket"], x["variant"]): (x["level"], x["games"]) for x in recommend.known_stats(table, members, buckets).collect()}
    rows = {(b, i): g for b, i, g in held}
    for b in ("d", "all", "e"):
        for c in "ABCDE":
            for w in "xy":
                keys = [(b, f"{c}:{w}"), (b, c), ("all", f"{c}:{w}"), ("all", c)]
                first = next(((k + 1, rows[key]) for k, key in enumerate(keys) if key in rows), None)
                assert got.get((b, f"{c}:{w}")) == first
    own = {(x["bucket"], x["variant"]): x["games"] for x in recommend.known_in(table, members).collect()}
    assert own["d", "A:y"] == 8 and own["d", "A:x"] == 1 and own["all", "D:y"] == 7 and ("e", "A:x") not in own


def test_pair_synergies_fall_back_to_characters(spark):
    members = spark.createDataFrame([("A:x", "A"), ("A:y", "A"), ("B:x", "B"), ("C:x", "C")], "variant string, character string")
    rates = {("d", "A:x"): (10, 0.2), ("d", "B"): (20, 0.1), ("d", "C:x"): (30, 0.3)}
    held = spark.createDataFrame([(b, i, g, w) for (b, i), (g, w) in rates.items()], "bucket string, stat_id string, games int, win_rate double")
    played = {("A", "B"): (8.0, 0.5), ("A:x", "B:x"): (4.0, 0.25), ("A", "C:x"): (6.0, 1.0)}
    pairs = spark.createDataFrame([("d", a, b, g, w) for (a, b), (g, w) in played.items()], "bucket string, a string, b string, games double, win_rate double")
    picked = spark.createDataFrame([("s", "d", "B:x", "B"), ("s", "d", "C:x", "C")], "sel string, bucket string, variant string, character string")
    got = {x["variant"]: x["pair_above"] for x in recommend.pair_synergies(picked, members, held, pairs).collect()}
    mean = (10 * 0.2 + 20 * 0.1 + 30 * 0.3) / 60
    rate = lambda i: next(((g * w + 80 * mean) / (g + 80) for (_, k), (g, w) in rates.items() if k in (i, i.split(":")[0])), mean)

    def above(a, b, games, wins):
        e = (rate(a) + rate(b)) / 2
        return (games * wins + 80 * e) / (games + 80) - e

    assert got["A:x"] == pytest.approx(above("A:x", "B:x", 4, 0.25) + above("A:x", "C:x", 6, 1.0))
    assert got["A:y"] == pytest.approx(above("A:y", "B:x", 8, 0.5) + above("A:y", "C:x", 6, 1.0))


def test_measures_of_the_adapter_have_six_digits_at_most(spark):
    """What the exact sums cut off is nothing."""
    rows = adapter.players(spark, SF).selectExpr(*[f"max(abs({c} - cast({stats.exact(c)} as double)) / greatest(1, abs({c}))) as {c}" for c in ("damage", "basic", "skill", "item_skill", "direct", "unique_skill", "damage_from", "from_basic", "from_skill", "cc_time")])
    assert max(rows.first()) < 1e-15
