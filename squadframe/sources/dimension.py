"""The dimension of members (variants of characters), derived from the part table, and its pairs of characters.

A real dimension has the same columns and comes from a file; here every attribute is a rule over the number of the
brand (b) and of the type (t).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import CHOSEN, ESTIMATED, ROLE_FLAGS, Layer, doubles, flag
from .adapter import table

WEAPONS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
KEYS: Layer = {
    "b": "cast(substring(character, 7) as int)",
    "t": "case weapon when 'ECONOMY' then 0 when 'LARGE' then 1 when 'MEDIUM' then 2 when 'PROMO' then 3 when 'SMALL' then 4 else 5 end",
}
_TAGGED = {
    "initiate": "(b + t) % 5 = 0 or (b + 2 * t) % 4 >= 2", "focus": "b % 3 = 0", "peel": "(b + 2 * t) % 5 = 0", "cc": "(b + t) % 3 = 1", "sustained": "b % 4 = 1", "poke": "t % 3 = 1", "burst": "b % 5 = 2", "short": "b % 7 = 3", "shield": "(b + t) % 7 = 2",
    "healing": "(b + 3 * t) % 8 = 1", "dive": "(b + t) % 5 = 3", "mobility": "(2 * b + t) % 5 = 1", "zone": "(b + t) % 6 = 4", "durable": "b % 6 = 0", "utility": "t % 4 = 2", "speed": "b % 4 = 3", "hyper": "b % 5 = 4", "range": "t % 2 = 0",
}
PROFILE: Layer = {
    "role": "case (b + t) % 6 when 0 then 'frontline' when 1 then 'bruiser' when 2 then 'assassin' when 3 then 'ranged' when 4 then 'mage' else 'support' end",
    "damage": "case (b + 2 * t) % 3 when 0 then 'basic' when 1 then 'skill' else 'hybrid' end",
    "style": "case (b * 5 + t * 2) % 13 when 0 then 'firstEngage' when 1 then 'delayedEngage' when 2 then 'cannotStart' when 3 then 'rangedEngageHelper' when 4 then 'diveFollowRanged' when 5 then 'counterOnlyRanged' when 6 then 'pokeThenEngage' when 7 then 'guardOnly' when 8 then 'guardSometimesEngage' else 'neutral' end",
    "difficulty": "b % 5 + 1", "initiate": "(b + 2 * t) % 4", "escape": "(b + t) % 3",
    **{f"t_{k}": flag(c) for k, c in _TAGGED.items()},
    "cc_targeted": "b % 3", "cc_other": "t % 3", "cc_single": "b % 2", "cc_very": "t % 2", "cc_narrow": "(b + t) % 2", "cc_medium": flag("(b + t) % 3 = 0"), "cc_wide": flag("(b * t) % 4 = 1"), "cc_conditional": flag("(b + t) % 4 = 3"),
    "is_anchor": flag("b = 7"), "is_late_starter": flag("b = 9"), "is_late": flag("b = 11"), "is_needy": flag("b in (5, 13)"), "is_helper": flag("b = 17"), "is_loner": flag("b = 19"),
    **{f"w_{m}": f"case when b % 3 <> 0 then {e} end" for m, e in {"difficulty": "b % 5 + 1", "damage": "(b * 2) % 5 + 1", "defense": "(b * 3) % 5 + 1", "cc": "(b + 2) % 5 + 1", "mobility": "(b * 4 + 1) % 5 + 1", "utility": "(b * 3 + 2) % 5 + 1"}.items()},
}
BY_ROLE: Layer = {
    "weapon_range": "case when (b * t) % 11 = 7 then 'unknown' when role in ('frontline', 'bruiser', 'assassin') then 'melee' when role = 'support' then 'hybrid' else 'ranged' end",
    "front_damage": "case when role in ('frontline', 'bruiser', 'assassin') then case t % 3 when 0 then 'high' when 1 then 'low' else 'medium' end end",
    "back_damage": "case when role in ('ranged', 'mage') then case (b + 2 * t) % 3 when 0 then 'high' when 1 then 'low' else 'medium' end end",
    "range_score": "case role when 'ranged' then case when t_short = 1 then 2 when t = 5 then 5 else 4 end when 'mage' then 3 when 'support' then 2 else 1 end",
}
#: All layers from (character, weapon, variant) to the flags that need no measured statistics.
LAYERS = [KEYS, PROFILE, BY_ROLE, ESTIMATED, CHOSEN, ROLE_FLAGS]

#: Score of a pair of characters by their numbers (lower first); pairs without one count as usual.
PAIR_WHERE, PAIR_SCORE = "(lo + hi) % 7 = 0", "6.5 + (lo * hi) % 20 / 10.0"


def layered(df: DataFrame, *layers: Layer) -> DataFrame:
    """Adds the layers' columns, one select for each layer."""
    for layer in layers:
        df = df.selectExpr("*", *[f"{doubles(e)} as {c}" for c, e in layer.items()])
    return df


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each variant with its attributes and flags."""
    rows = table(spark, sf_dir, "part").selectExpr("p_brand as character", "p_type as weapon", "concat(p_brand, ':', p_type) as variant").distinct()
    return layered(rows, *LAYERS)


def synergy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, score) for the pairs of characters that have a score, in both orders."""
    who = table(spark, sf_dir, "part").selectExpr("p_brand as character").distinct()
    who = layered(who.selectExpr("character", "'' as weapon"), {"b": KEYS["b"]})
    pairs = who.selectExpr("character as a", "b as x").join(who.selectExpr("character as b", "b as y")).where("a <> b").selectExpr("a", "b", "least(x, y) as lo", "greatest(x, y) as hi")
    return pairs.where(PAIR_WHERE).selectExpr("a", "b", f"{doubles(PAIR_SCORE)} as score")
