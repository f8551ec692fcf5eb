"""The rules of the recommendation at hand-made teams, and their limits over the tables."""

import pytest
from pyspark.sql import functions as F

from squadframe.functions import rules as K
from squadframe.operators import recommend
from squadframe.sources.dimension import BY_ROLE, KEYS, PROFILE, layered

D = "/root/testdata/sf0.001"


def member(name, role, **more):
    """A member without any tag, control or style, but for those given."""
    base = {c: 0 for c in [*PROFILE, *(f"t_{t}" for t in K.TAGS)] if c.startswith(("t_", "cc_", "is_"))}
    base |= {"character": name, "variant": f"{name}:X", "role": role, "damage": "skill", "style": "neutral", "difficulty": 3, "initiate": 0, "escape": 0, "weapon_range": "melee" if role in ("frontline", "bruiser", "assassin") else "ranged", "front_damage": None, "back_damage": None, "range_score": 1, "rt_damage": None}
    base |= {f"w_{m}": 3 for m in K.METRICS}
    return base | more


TANK = member("tank", "frontline", front_damage="low", t_peel=1, t_initiate=1, cc_targeted=2, style="guardSometimesEngage")
SHOT = member("shot", "ranged", back_damage="high", damage="basic", t_range=1, t_sustained=1, w_damage=5)
MAGE = member("mage", "mage", back_damage="low", t_poke=1, w_damage=4, cc_wide=1, style="counterOnlyRanged")
BRAWL = member("brawl", "bruiser", front_damage="high", t_dive=1, t_focus=1, style="firstEngage", w_damage=4)
BLADE = member("blade", "assassin", t_burst=1, t_hyper=1, w_damage=5, style="delayedEngage")
CARE = member("care", "support", weapon_range="hybrid", t_healing=1, t_speed=1, w_damage=2)


@pytest.fixture(scope="module")
def scores(spark):
    ints = {c for c in TANK if c.startswith(("t_", "cc_", "is_", "w_")) and c != "weapon_range"} | {"difficulty", "initiate", "escape", "range_score"}
    schema = ", ".join(f"{c} {'int' if c in ints else 'double' if c == 'rt_damage' else 'string'}" for c in TANK)
    rows = spark.createDataFrame([tuple(m.values()) for m in (TANK, SHOT, MAGE, BRAWL, BLADE, CARE)], schema)
    rows = layered(rows.withColumn("rt_reference", F.lit(None).cast("double")), K.ESTIMATED, K.CHOSEN, K.ROLE_FLAGS, K.DAMAGE_LEVEL, K.PREDICATES, K.CONTRIBUTORS)
    asked = [("tank+shot", ["tank:X", "shot:X"]), ("shot+mage", ["shot:X", "mage:X"]), ("tank+brawl", ["tank:X", "brawl:X"]), ("shot", ["shot:X"]), ("none", [])]
    asked = spark.createDataFrame([(s, "all", "all", p) for s, p in asked], "sel string, tier string, bucket string, picked array<string>")
    got = layered(recommend.grid(asked, rows), K.LABEL, K.TEAM_REASONS).collect()
    return {(r["sel"], r["character"]): r.asDict() for r in got}


def test_control_power_and_shape(scores):
    r = scores["shot+mage", "tank"]
    assert r["cc_power"] == pytest.approx(2.5) and r["g_cc_power"] == pytest.approx(2.5 + 0.94)
    assert (r["g_tank"], r["g_backline"], r["g_reliable"], r["g_low"], r["g_high"]) == (1, 2, 2, 2, 1)
    assert r["shape_label"] == "1 tank 2 ranged" and r["union_reason"] == "frontlineRanged"


def test_scores_by_hand(scores):
    r = scores["shot+mage", "tank"]
    # initiate and peel are new (1.8); the team's control is 0.94 (2.5 x 0.42 = 1.05), it has no targeted one (0.45)
    assert r["coverage"] == pytest.approx(1.8 + 1.05 + 0.45)
    assert r["role_balance"] == 1.35 and r["front_damage_score"] == 0.0 and r["back_damage_score"] == 0.0
    # two members that deal little, one that deals much
    assert r["damage_budget"] == pytest.approx(-1.15)
    # damage 12, defense 9, control 9, mobility 3, utility 9: .55 + .35 + .5 + .25, at most 1.25
    assert r["metric_balance"] == pytest.approx(1.25)
    # one tank that deals little before two ranged 1.2, carry that is kept safe .85
    assert r["team_shape"] == pytest.approx(1.2 + 0.85)
    assert r["weapon_balance"] == pytest.approx(0.6)
    assert r["conflict"] == 0.0
    # first engager, so no charge (guards at times); counter-only ranged without a dive direction: nothing but the engage
    assert r["composition_guide"] == 0.0

    r = scores["tank+shot", "mage"]
    # the tank deals skill damage too, so a second skill dealer adds nothing
    assert r["back_damage_score"] == pytest.approx(-1.0) and r["kill_pressure"] == 0.0 and r["role_balance"] == 0.35
    r = scores["tank+brawl", "blade"]
    # second melee dealer with a tank and nobody behind: tank engages (.85), first engager with a delayed one (.25), two divers without a helper
    assert r["composition_guide"] == pytest.approx(0.85 + 0.25)
    # all melee, damage 12, control 9: 1.05; engages with two that follow .9; hyper carry, a front, set-up 1.25: -.8
    assert r["team_shape"] == pytest.approx(1.05 + 0.9 - 0.8)
    r = scores["tank+shot", "care"]
    assert r["role_balance"] == -1.4 and r["weapon_balance"] == 0.0
    # damage 10 but one reliable dealer: -2.4, tank and support -2.4; speed with a front, mean range 1: +1.3; carry kept safe +.85
    assert r["team_shape"] == pytest.approx(-2.4 - 2.4 + 1.3 + 0.85)


def test_selections_of_one_and_none(scores):
    assert scores["none", "tank"]["role_balance"] == 1.0 and scores["none", "tank"]["team_shape"] == 0.0 and scores["none", "tank"]["damage_budget"] == 0.0
    r = scores["shot", "brawl"]
    assert r["role_balance"] == 1.35 and r["conflict"] == 0.0 and r["weapon_balance"] == pytest.approx(0.6)
    assert ("shot", "shot") not in scores


def test_limits_hold_and_pool(spark):
    rows = recommend.score_rules(spark, D).agg(*[F.min(c).alias(f"low_{c}") for c in K.SCORES], *[F.max(c).alias(f"high_{c}") for c in K.SCORES]).first()
    for c, low, high in (("front_damage_score", -1.6, 1.4), ("back_damage_score", -1.5, 1.6), ("metric_balance", -1.6, 1.25), ("team_shape", -5.4, 3.0), ("composition_guide", -4.0, 2.2), ("conflict", -9, 0)):
        assert low <= rows[f"low_{c}"] <= rows[f"high_{c}"] <= high
    stats, _, members = recommend._base(spark, D)
    asked = recommend.selections(stats)
    assert {r["character"] for r in recommend.grid(asked, members, ["Brand#3", "Brand#4"]).select("character").distinct().collect()} <= {"Brand#3", "Brand#4"}
    one = members.select("variant").orderBy("variant").first()[0]
    assert {r["variant"] for r in recommend.grid(asked, members, [one]).select("variant").distinct().collect()} <= {one}


def test_keys_of_a_dimension(spark):
    r = layered(spark.createDataFrame([("Brand#12", "PROMO", "Brand#12:PROMO")], "character string, weapon string, variant string"), KEYS, PROFILE, BY_ROLE).first()
    assert (r["b"], r["t"], r["role"], r["weapon_range"]) == (12, 3, "ranged", "ranged")
