"""Rules of the recommendation as expressions over numbered layers of columns.

A layer maps a column to its expression over the columns of the layers before it. Rules of a team are written over a
candidate's columns, the sums of the same columns over the selected members (`s_...`) and over the whole team (`g_...`),
and the number selected (`n`), so no rule needs an array of members. The thresholds are fixed values.
"""

from __future__ import annotations

import re

Layer = dict[str, str]


def doubles(expression: str) -> str:
    """Decimal literals as doubles."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", expression)


def flag(condition: str) -> str:
    return f"case when {condition} then 1 else 0 end"


def limit(expression: str, low: float, high: float) -> str:
    return f"greatest({low:.3f}, least({high:.3f}, {expression}))"


def cases(*branches: tuple[str, str], otherwise: str = "0.0") -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in branches) + f" else {otherwise} end"


def added(*terms: tuple[str, float]) -> str:
    """The sum of the amounts whose condition holds."""
    return "(" + " + ".join(f"case when {c} then {v:.3f} else 0.0 end" for c, v in terms) + ")"


def rounded(expression: str, digits: int) -> str:
    k = f"{float(10**digits)}"
    return f"floor(({expression}) * {k} + 0.5) / {k}"


TAGS = ["initiate", "focus", "peel", "cc", "sustained", "poke", "burst", "short", "shield", "healing", "dive", "mobility", "zone", "durable", "utility", "speed", "hyper", "range"]
#: Tags that a team should have among its members.
REQUIRED = ["initiate", "focus", "peel", "cc", "sustained", "poke", "burst"]
ROLES = ["frontline", "bruiser", "assassin", "ranged", "mage", "support"]
RANGES = ["melee", "ranged", "hybrid", "unknown"]
METRICS = ["difficulty", "damage", "defense", "cc", "mobility", "utility"]

#: Weight of each kind of control in a member's control power.
CC_POWER = "(cc_targeted * 1.25 + cc_other * 0.72 + cc_single * 0.58 + cc_very * 0.34 + cc_narrow * 0.46 + cc_medium * 0.68 + cc_wide * 0.94) * case when cc_conditional > 0 then 0.86 else 1.0 end"


def _metric(expression: str) -> str:
    return f"greatest(1.0, least(5.0, floor({expression} + 0.5)))"


#: A member's estimated metrics, from 1 to 5, where none are given.
ESTIMATED: Layer = {
    "e_difficulty": _metric("difficulty"),
    "e_damage": _metric("case when damage in ('basic', 'skill') then 4.0 else 3.0 end + t_burst * 0.45 + t_sustained * 0.35 + t_range * 0.2 - case when role = 'support' then 1.2 else 0.0 end"),
    "e_defense": _metric("2.0 + t_durable * 1.3 + t_shield * 0.5 + case when role = 'frontline' then 1.2 when role = 'bruiser' then 0.4 when role in ('ranged', 'mage') then -0.45 else 0.0 end"),
    "e_cc": _metric("1.0 + cc_targeted * 1.15 + cc_other * 0.8 + cc_medium * 0.45 + cc_wide * 0.6 + cc_single * 0.25"),
    "e_mobility": _metric("2.0 + t_mobility * 1.4 + t_dive * 0.8 + t_range * 0.2 - t_zone * 0.25"),
    "e_utility": _metric("1.0 + t_utility * 1.2 + t_peel * 1.0 + t_healing * 1.2 + t_shield * 0.8 + t_zone * 0.35"),
}
#: Given metrics (w_...) before estimated ones.
CHOSEN: Layer = {f"m_{m}": f"coalesce(w_{m}, e_{m})" for m in METRICS}

#: Predicates of a member. rt is its damage level among the measured ones of its group: high, low, medium or null.
ROLE_FLAGS: Layer = {
    "tank": flag("role = 'frontline'"), "melee": flag("role in ('bruiser', 'assassin')"), "backline": flag("role in ('ranged', 'mage')"), "support": flag("role = 'support'"),
    "front": flag("role in ('frontline', 'bruiser')"), "cc_power": CC_POWER, "area": "cc_medium + cc_wide",
    "first_engage": flag("style in ('firstEngage', 'guardSometimesEngage')"), "delayed": flag("style = 'delayedEngage'"), "cannot_start": flag("style = 'cannotStart'"),
    "helper": flag("style = 'rangedEngageHelper'"), "dive_ranged": flag("style = 'diveFollowRanged'"), "counter_only": flag("style = 'counterOnlyRanged'"), "poke_then": flag("style = 'pokeThenEngage'"),
    "guard_only": flag("style = 'guardOnly'"), "guard_sometimes": flag("style = 'guardSometimesEngage'"),
    "rt_group": "case when role in ('frontline', 'bruiser', 'assassin') then 'front' when role in ('ranged', 'mage') then 'backline' when role = 'support' then 'support' else 'all' end",
    **{f"r_{r}": flag(f"role = '{r}'") for r in ROLES}, **{f"x_{r}": flag(f"weapon_range = '{r}'") for r in RANGES},
    "basic": flag("damage = 'basic'"), "skill": flag("damage = 'skill'"),
}
DAMAGE_LEVEL: Layer = {"rt": "case when rt_damage is null or rt_damage = 0 then null when rt_damage >= rt_reference * 1.08 then 'high' when rt_damage <= rt_reference * 0.86 then 'low' else 'medium' end"}
PREDICATES: Layer = {
    "reliable": flag("melee + backline > 0"),
    "high_front": flag("front = 1 and (front_damage = 'high' or coalesce(rt, '') = 'high')"), "low_front": flag("front = 1 and (front_damage = 'low' or coalesce(rt, '') = 'low')"),
    "high_back": flag("backline = 1 and (back_damage = 'high' or coalesce(rt, '') = 'high')"), "low_back": flag("backline = 1 and (back_damage = 'low' or coalesce(rt, '') = 'low')"),
    "damage_tank": flag("tank = 1 and (front_damage = 'high' or damage = 'hybrid' or t_burst + t_sustained > 0)"),
    "long_carry": flag("backline = 1 and t_range = 1 and t_short = 0"), "sustained_carry": flag("t_sustained = 1 or damage = 'basic'"), "dive_follow": flag("t_dive + t_mobility + melee > 0"),
    "primary_engage": flag(f"first_engage = 1 or t_initiate = 1 or (tank = 1 and guard_only = 0) or (cc_power >= 2.4 and counter_only = 0 and guard_only = 0) or is_late_starter = 1"),
    "long_poke": flag("counter_only = 1 or poke_then = 1 or (t_poke + t_zone + t_range > 0 and t_dive = 0)"),
    "measured": flag("rt_damage is not null"), "rt_sum": "coalesce(rt_damage, 0.0)", "rt_hoped": "case when coalesce(rt_damage, 0.0) <> 0 then rt_reference else 0.0 end",
}
CONTRIBUTORS: Layer = {
    "high": flag("high_front + high_back > 0 or role = 'assassin'"), "low": flag("low_front + low_back + support > 0"),
    "tank_high": "tank * high_front", "tank_low": "tank * low_front", "tank_leaning": "tank * damage_tank",
    "tank_protects": flag("tank = 1 and (t_peel + t_shield + t_healing + guard_sometimes + guard_only > 0)"),
    "tank_charges": flag("tank = 1 and first_engage = 1 and t_peel + t_shield + guard_sometimes = 0"),
    "tank_engages": flag("tank = 1 and is_anchor = 0 and primary_engage = 1"),
    "diver": flag("t_dive + melee > 0"), "melee_help": flag("is_helper + helper > 0"), "wants_start": flag("is_needy + cannot_start > 0"),
    "protects": flag("t_peel + t_shield + t_healing > 0"),
}

#: Columns that are summed over the members of a team.
SHAPE = ["tank", "melee", "backline", "support", "reliable", "damage_tank", "high_front", "low_front", "high_back", "low_back", "high", "low", "long_carry", "sustained_carry", "dive_follow", "first_engage", "delayed", "cannot_start", "helper", "dive_ranged", "counter_only", "poke_then", "guard_only", "guard_sometimes"]
SUMMED = (
    SHAPE + [f"t_{x}" for x in TAGS] + [f"r_{x}" for x in ROLES] + [f"x_{x}" for x in RANGES] + [f"m_{x}" for x in METRICS]
    + ["front", "cc_power", "cc_targeted", "area", "basic", "skill", "primary_engage", "measured", "rt_sum", "rt_hoped", "tank_high", "tank_low", "tank_leaning", "tank_protects", "tank_charges", "tank_engages", "diver", "melee_help", "wants_start", "protects", "is_anchor", "is_needy", "initiate", "range_score"]
)
#: Sums that no rule reads for the whole team, only for the selected.
SELECTED_ONLY = {"x_hybrid", "x_unknown", "basic", "skill", "range_score", "initiate"}
TEAM: Layer = {f"g_{x}": f"{x} + s_{x}" for x in SUMMED if x not in SELECTED_ONLY}
#: Means of a team's metrics, two digits.
MEANS: Layer = {f"a_{m}": rounded(f"g_m_{m} / (n + 1.0)", 2) for m in METRICS}

_FULL = "n >= 2"
_TBM = "g_tank = 1 and g_melee = 1 and g_backline = 1"
_MM_B = "g_tank = 0 and g_melee = 2 and g_backline = 1"
_ENGAGES = "(g_t_initiate > 0 or g_cc_power >= 3.0)"
_SETUP = "(s_initiate + s_cc_power * 0.5)"
_HARD_DIVE = "(g_first_engage > 0 and (g_melee >= 1 or g_cannot_start >= 1 or g_delayed >= 1))"
_DIVES = "g_diver >= 2"

#: The sub-scores of a candidate for the selected, each by its rule; synergy comes from a table of pairs.
SCORES: Layer = {
    "coverage": "(" + " + ".join(f"case when t_{x} = 1 and s_t_{x} = 0 then 0.9 else 0.0 end" for x in REQUIRED) + """) + case when cc_power <= 0 then 0.0 else least(1.9,
        case when s_cc_power < 1.4 then least(1.5, cc_power * 0.42) when s_cc_power < 3.0 then least(0.9, cc_power * 0.22) else 0.0 end
        + case when s_cc_targeted = 0 and cc_targeted > 0 then 0.45 else 0.0 end + case when s_area = 0 and area > 0 then 0.38 else 0.0 end) end""",
    "role_balance": cases(
        ("n = 0", "1.0"), ("n >= 2 and tank = 1 and s_melee > 0 and s_backline > 0", "-0.8"), ("n >= 2 and support = 1 and s_tank > 0", "-1.4"),
        ("s_tank = 0 and front = 1", "1.35"), ("s_r_ranged = 0 and backline = 1", "1.0"), ("s_support = 0 and support = 1", "0.6"),
        (" + ".join(f"r_{r} * s_r_{r}" for r in ROLES) + " > 0", "-0.25"), otherwise="0.35"),
    "front_damage_score": "case when front = 0 or n = 0 then 0.0 else " + limit(added(
        ("high_front = 1 and g_reliable < 2", 0.75), (f"high_front = 1 and {_TBM} and tank = 1", 0.85), (f"high_front = 1 and {_TBM} and tank = 0", 0.45), (f"high_front = 1 and {_MM_B}", 0.35),
        ("low_front = 1 and g_reliable < 2", -1.1), (f"low_front = 1 and {_TBM}", -0.75), ("low_front = 1 and g_tank >= 1 and g_support >= 1", -0.45)), -1.6, 1.4) + " end",
    "back_damage_score": "case when backline = 0 or n = 0 then 0.0 else " + limit(added(
        ("high_back = 1 and s_reliable < 2", 0.9), ("high_back = 1 and s_backline = 0", 0.55), ("high_back = 1 and (g_tank >= 1 or g_melee >= 1)", 0.35), ("high_back = 1 and damage = 'basic'", 0.18),
        ("low_back = 1 and s_reliable < 2", -1.0), ("low_back = 1 and s_backline = 0", -0.45), ("low_back = 1 and g_tank >= 1 and g_support >= 1", -0.35)), -1.5, 1.6) + " end",
    "measured_damage": "case when g_measured < 2 or g_rt_hoped = 0 then 0.0 else " + cases(
        ("g_rt_sum / nullif(g_rt_hoped, 0) >= 1.12", "0.55"), ("g_rt_sum / nullif(g_rt_hoped, 0) >= 1.05", "0.25"), ("g_rt_sum / nullif(g_rt_hoped, 0) <= 0.78", "-1.15"),
        ("g_rt_sum / nullif(g_rt_hoped, 0) <= 0.88", "-0.65"), ("g_rt_sum / nullif(g_rt_hoped, 0) <= 0.94", "-0.3")) + " end",
    "metric_balance": f"case when not ({_FULL}) then 0.0 else " + limit(
        cases(("g_m_damage <= 8", "-1.2"), ("g_m_damage >= 11", "0.55")) + " + " + cases(("g_m_defense <= 6 and a_mobility < 3.4", "-0.75"), ("g_m_defense >= 9", "0.35")) + " + "
        + cases(("g_m_cc <= 5", "-0.65"), ("g_m_cc >= 9", "0.5")) + " + " + added(("a_mobility >= 3.7 and g_m_cc >= 7", 0.35), ("g_m_utility >= 8 and g_m_damage >= 9", 0.25), ("g_m_utility >= 8 and g_m_damage <= 8", -0.35)), -1.6, 1.25) + " end",
    "kill_pressure": "case when backline = 0 then 0.0 else " + cases(
        ("damage = 'basic' and s_basic = 0", "0.7"), ("damage = 'skill' and s_skill = 0", "0.45"), ("damage = 'hybrid' and s_basic = 0", "0.35"), ("damage = 'skill' and s_skill >= 2 and s_basic = 0", "-0.7")) + " end",
    "weapon_balance": cases(
        ("support = 1", "0.0"), ("weapon_range = 'unknown'", "-0.4"), (" + ".join(f"x_{r} * s_x_{r}" for r in RANGES) + " >= 2", "-0.8"),
        otherwise=cases(("s_x_melee > 0 and weapon_range = 'ranged'", "0.8"), ("s_x_ranged > 0 and weapon_range = 'melee'", "0.6"), otherwise="0.2") + " + "
        + cases(("t_short = 0", "0.0"), ("s_front > 0 and (s_t_cc > 0 or s_t_initiate > 0 or s_cc_power >= 2.0)", "0.55"), (_FULL, "-0.65"), otherwise="-0.15")),
    "team_shape": f"case when not ({_FULL}) then 0.0 else " + limit(" + ".join([
        added(
            ("g_reliable < 2", -2.4), ("g_tank >= 2 and g_m_damage < 10", -1.8), ("g_tank >= 1 and g_support >= 1 and g_reliable >= 2 and g_m_damage >= 10", -0.55),
            ("g_tank >= 1 and g_support >= 1 and not (g_reliable >= 2 and g_m_damage >= 10)", -2.4), ("g_support >= 1 and g_reliable >= 2 and g_m_damage >= 10 and (g_m_cc >= 7 or g_m_utility >= 8)", 0.75),
            (_MM_B, 1.25), ("g_tank = 0 and g_melee = 2 and g_support = 1", 1.1), (f"{_ENGAGES} and g_dive_follow >= 2", 0.9),
            ("g_long_carry >= 1 and g_sustained_carry >= 1 and (g_protects > 0 or g_cc_power >= 2.4)", 0.85), ("g_long_carry >= 2 and g_protects = 0 and g_cc_power < 2.0", -0.7), ("g_sustained_carry >= 2 and g_cc_power < 1.6", -0.6)),
        cases((f"not ({_TBM})", "0.0"), ("g_tank_high = 1", "-0.35"), ("g_tank_leaning = 1", "-0.85"), ("g_tank_low = 1", "-3.2"), otherwise="-2.2"),
        cases(("not (g_tank = 1 and g_backline = 2 and g_support = 0)", "0.0"), ("g_tank_low = 1", "1.2"), ("g_tank_protects = 1", "1.45"), otherwise="0.75"),
        cases(
            ("not (g_backline = 3 and g_tank = 0 and g_melee = 0)", "0.0"), ("g_m_damage >= 11 and (g_m_cc >= 8 or g_m_utility >= 7 or g_protects > 0)", "1.15"),
            ("g_helper >= 1 and g_m_damage >= 10 and g_cc_power >= 2.0", "0.45"), ("g_dive_ranged >= 1 and g_poke_then + g_counter_only >= 1 and g_m_damage >= 10", "0.25"), otherwise="-0.75"),
        cases(
            ("not (g_backline = 0 and g_support = 0 and g_tank + g_melee = 3)", "0.0"), (f"g_m_damage >= 10 and g_m_cc >= 8 and ({_ENGAGES} or a_mobility >= 3.2)", "1.05"),
            ("g_first_engage >= 1 and g_delayed + g_cannot_start >= 1 and g_m_damage >= 10", "0.35"), otherwise="-0.75"),
        cases(("not (t_speed = 1 and support = 1 and s_front > 0)", "0.0"), ("s_range_score < 2.0 * n", "1.3"), ("s_range_score < 2.8 * n", "0.7"), ("s_range_score < 3.5 * n", "0.2")),
        cases(("t_hyper = 0", "0.0"), ("s_front = 0", "-1.1"), (f"{_SETUP} >= 5.0", "1.4"), (f"{_SETUP} >= 3.0", "0.8"), (f"{_SETUP} >= 1.5", "0.1"), otherwise="-0.8"),
        cases(("not (role = 'assassin' and t_hyper = 0 and initiate <= 1)", "0.0"), (f"{_SETUP} < 1.5", "-0.7"), (f"{_SETUP} >= 4.0", "0.5"))]), -5.4, 3.0) + " end",
    "conflict": f"case when not ({_FULL}) then 0.0 else " + added(
        ("g_front = 0 and g_m_defense <= 6 and g_cc_power < 2.2", -1.4), ("g_backline = 0 and g_m_damage < 10 and g_cc_power < 3.0", -1.0), ("g_support >= 2", -1.2), ("g_r_assassin >= 2 and g_front = 0 and g_cc_power < 2.5", -1.0),
        ("g_x_melee = n + 1 and not (g_m_damage >= 10 and g_cc_power >= 8 and a_mobility >= 3.0)", -0.55), ("g_x_ranged = n + 1 and not (g_m_damage >= 11 and (g_cc_power >= 8 or g_m_utility >= 7))", -0.45),
        ("g_t_initiate = 0 and g_t_cc = 0 and g_cc_power < 4.5", -0.8), ("g_cc_power < 1.2", -0.65), ("g_t_focus = 0 and g_t_burst = 0 and g_m_damage < 10", -0.55)) + " end",
    "composition_guide": f"case when not ({_FULL}) then 0.0 else " + limit(added(
        ("g_is_anchor > 0 and g_backline >= 2 and g_melee = 0", 1.05), ("g_is_anchor > 0 and g_melee >= 1", -1.85), ("g_tank = 1 and g_backline = 2 and g_melee = 0 and g_tank_charges = 1", -0.75),
        ("g_guard_only >= 1 and g_melee >= 1", -1.15), ("g_guard_only >= 1 and g_backline >= 2 and g_counter_only + g_poke_then + g_helper >= 1", 0.55),
        ("g_support > 0 and (g_high >= 2 or g_m_damage >= 11)", 0.65), ("g_support > 0 and (g_low >= 2 or g_m_damage <= 8)", -1.75),
        ("g_primary_engage = 0 and wants_start = 1", -1.75), ("g_primary_engage = 0 and g_wants_start > 0", -0.95), ("g_first_engage = 0 and g_delayed >= 2", -0.75), ("g_first_engage > 0 and g_delayed >= 1", 0.25),
        ("g_tank = 1 and g_melee = 2 and g_backline = 0 and g_tank_engages = 1", 0.85), ("g_cc_power < 1.2", -1.2),
        (f"{_HARD_DIVE} and g_counter_only >= 1 and g_support = 0 and g_melee_help = 0", -1.15), (f"{_HARD_DIVE} and g_poke_then >= 1 and g_melee_help = 0", -0.35),
        (f"{_DIVES} and long_poke = 1 and g_support = 0 and g_melee_help = 0 and dive_ranged = 0", -0.75), (f"{_DIVES} and g_melee_help > 0", 0.7), (f"{_HARD_DIVE} and g_dive_ranged >= 1", 0.45), ("g_helper >= 1 and g_melee >= 1", 0.55),
        ("g_backline >= 3 and g_first_engage = 0 and g_counter_only + g_poke_then + g_helper >= 2 and g_cc_power >= 2.0", 0.55), (f"is_late = 1 and {_DIVES} and g_support = 0", -0.45),
        ("is_loner = 1 and g_backline = 0 and g_support = 0 and g_melee + g_tank >= 3", -0.6)), -4.0, 2.2) + " end",
}
BUDGET: Layer = {
    "damage_budget": f"case when not ({_FULL}) then 0.0 else " + limit(added(
        ("g_high = 0", -2.4), ("g_high = 1 and g_low >= 2", -1.15), ("g_low >= 3", -2.0), ("g_reliable < 2 and g_high <= 1", -1.0), ("g_high >= 2 and g_low <= 1", 0.6), ("g_high >= 1 and g_reliable >= 2 and g_low <= 1", 0.35)) + " + measured_damage", -3.4, 1.25) + " end",
}

#: Weight of every sub-score in the total.
TOTAL_WEIGHTS = {
    "synergy": 1.6, "coverage": 1.0, "role_balance": 1.0, "front_damage_score": 1.0, "back_damage_score": 1.0, "damage_budget": 1.0, "metric_balance": 1.0, "kill_pressure": 1.0, "weapon_balance": 1.0, "team_shape": 1.0, "conflict": 1.0,
    "composition_guide": 1.0, "ranker_composition": 0.35, "tournament_composition": 0.5, "tournament_archetype": 0.4, "meta": 1.0, "official_match": 0.35, "official_v2": 0.35, "relationship": 1.0, "difficulty": -0.08, "feedback": 1.7,
}
TOTAL: Layer = {"total": " + ".join(f"{c} * ({w})" for c, w in TOTAL_WEIGHTS.items())}

#: A member's value in one bucket, over its statistics there (or in `all`): games, rates and means, the group's averages
#: (q_...), the bucket's mean rate, the measured row (rt_...) with its averages (v_...), ranker and snapshot rows.
_DAMAGE = "case when coalesce(avg_damage, 0.0) = 0 then 0.0 else {} end"
_CONFIDENT = "least(1.0, log10(coalesce({}, 0) + 1.0) / {})"


def _placement_score(placement: str, top3: str, win: str) -> str:
    return limit(f"case when {placement} is null then 0.0 else (4.5 - {placement}) / 3.5 * 1.35 end + (coalesce({top3}, 0.0) - 0.375) * 1.15 + (coalesce({win}, 0.0) - 0.125) * 1.45", -2.4, 2.8)


OFFICIAL: Layer = {
    "official_meta": "case when coalesce(games, 0) < 10 then 0.0 else " + limit(
        "((win_rate - q_win_rate) * 2.2 + (top3_rate - q_top3_rate) * 1.35 + (q_avg_placement - coalesce(avg_placement, q_avg_placement)) * 0.36 + "
        + _DAMAGE.format(limit("(avg_damage / case when q_avg_damage > 0 then q_avg_damage else 14000.0 end - 1) * 0.62", -0.32, 0.42)) + " + case when front = 0 or coalesce(avg_damage_from, 0.0) = 0 then 0.0 else "
        + limit("(avg_damage_from / case when q_avg_damage_from > 0 then q_avg_damage_from else 14000.0 end - 1) * 0.28", -0.12, 0.22) + " end) * " + limit("log10(games + 1.0) / log10(261.0)", 0, 1), -1.05, 1.15) + " end",
    "official_candidate": "case when games is null then 0.0 else " + limit(
        "(" + _placement_score("avg_placement", "top3_rate", "win_rate") + " * 0.75 + " + _DAMAGE.format(limit("(avg_damage - 18000) / 22000.0", -0.35, 0.45)) + " * 0.35) * " + _CONFIDENT.format("games", 2.2), -0.95, 1.05) + " end",
    "power": "case when games is null then 0.0 else " + limit("((win_rate * games + 100 * mean_rate) / (games + 100.0) - mean_rate) * 4 * " + _CONFIDENT.format("games", 2.5), -1.0, 1.2) + " end",
    "combat": "case when coalesce(c_games, 0) = 0 then 0.0 else " + limit(
        "(" + limit("(avg_kills + avg_assists * 0.5 + avg_team_kills * 0.3) / 6.0", -0.5, 0.7) + " + " + limit("(c_damage - 15000) / 20000.0", -0.5, 0.6) + " * 0.4) * " + _CONFIDENT.format("c_games", 2.5), -0.8, 1.0) + " end",
    "tier_score": "case tier_label when 'OP' then 1.4 when 'S' then 1.1 when 'A' then 0.75 when 'B' then 0.3 when 'C' then -0.25 when 'D' then -0.65 else 0.0 end + case when k_games is null then 0.0 else "
    + _placement_score("k_placement", "k_top3", "k_win") + " * case when k_trick >= 0.82 then 0.15 when k_trick >= 0.68 then 0.35 when k_trick >= 0.52 then 0.65 else 1.0 end * " + _CONFIDENT.format("k_games", 2.5) + " * 0.35 end",
    "statistics_score": "case when p_games is null then 0.0 else " + limit(_placement_score("p_placement", "p_top3", "p_win") + " * " + _CONFIDENT.format("p_games", 2.5) + " * 0.85", -1.25, 1.35) + " end",
    "realtime_score": "case when rt_damage is null then 0.0 else " + limit(
        "((rt_win - v_win) * 0.08 + (rt_top3 - v_top3) * 0.045 + (v_rank - rt_rank) * 0.55 + (rt_kills - v_kills) * 0.2 + case when coalesce(rt_reference, 0.0) = 0 then 0.0 else "
        + limit("(rt_damage / rt_reference - 1) * 1.1", -0.55, 0.65) + " end + case rt_tier when 'S' then 0.42 when 'A' then 0.24 when 'B' then 0.03 when 'C' then -0.18 when 'D' then -0.38 else 0.0 end) * "
        + limit("log10(rt_games + 1.0) / 4", 0.35, 1), -1.2, 1.35) + " end",
}
META: Layer = {
    "legacy_meta": limit("tier_score * 0.35 + statistics_score * 0.35 + realtime_score * 0.30", -0.95, 1.05),
    "official_weight": "case when coalesce(games, 0) <= 0 then 0.0 else " + limit("log10(games + 1.0) / log10(421.0)", 0, 0.78) + " end", "official_match": limit("official_candidate * 0.45", -1.5, 1.65),
}
COMBINED: Layer = {"meta": limit("official_meta * official_weight + legacy_meta * (0.58 - official_weight * 0.42)", -1.1, 1.25)}
V2: Layer = {"official_v2": limit("power * 0.30 + pair_synergy * 0.35 + combat * 0.15", -1.5, 1.8)}
#: Letter of a measured member, and of a member of a tier snapshot.
RT_TIER = "case when rt_win >= 16 then 'S' when rt_win >= 14 then 'A' when rt_win >= 12 then 'B' when rt_win >= 9 then 'C' else 'D' end"
SNAPSHOT_TIER = "case when win_rate >= 0.2 then 'OP' when win_rate >= 0.16 then 'S' when win_rate >= 0.13 then 'A' when win_rate >= 0.1 then 'B' when win_rate >= 0.06 then 'C' else 'D' end"
#: Stored bucket of a tier by its alias; and the snapshot bucket.
TIER_ALIAS = {"iron_bronze": "iron_gold", "silver_gold": "iron_gold", "diamond": "platinum_diamond", "mithril_plus": "meteor_mithril"}
SNAPSHOT_ALIAS = {"iron_bronze": "bronze", "silver_gold": "gold", "platinum_diamond": "diamond_plus", "meteor_mithril": "mithril_plus", "demigod_eternity": "mithril_plus"}


def aliased(column: str, names: dict[str, str], otherwise: str) -> str:
    return f"case {column} " + " ".join(f"when '{a}' then '{b}'" for a, b in names.items()) + f" else {otherwise} end"


RANKER_SCORE = _placement_score("avg_placement", "top3_rate", "win_rate")
TRICK_WEIGHT = "case when one_trick >= 0.82 then 0.15 when one_trick >= 0.68 then 0.35 when one_trick >= 0.52 then 0.65 else 1.0 end"
RESULT_SCORE = limit("(4.5 - rank) / 3.5 * 0.78 + least(1.0, ts / 22.0) * 0.32 + least(1.0, ks / 14.0) * 0.28", -1.15, 1.35)

_LABELS = [
    ("g_tank = 1 and g_backline = 2 and g_melee = 0 and g_support = 0", "1 tank 2 ranged"), ("g_tank = 0 and g_melee = 1 and g_backline = 2 and g_support = 0", "1 melee 2 ranged"), ("g_tank = 0 and g_melee = 2 and g_backline = 1 and g_support = 0", "2 melee 1 ranged"),
    ("g_tank = 0 and g_melee = 2 and g_support = 1 and g_backline = 0", "2 melee 1 support"), ("g_tank = 1 and g_melee = 1 and g_backline = 1 and g_support = 0", "1 tank 1 melee 1 ranged"), ("g_backline = 3 and g_tank = 0 and g_melee = 0", "3 ranged"),
    ("g_melee + g_tank = 3 and g_backline = 0 and g_support = 0", "3 melee"), ("g_tank >= 1 and g_support >= 1", "tank and support"), ("g_tank >= 2", "2 tanks"),
]
_COUNTED = "concat(cast(g_tank as varchar(9)), ' tank ', cast(g_melee as varchar(9)), ' melee ', cast(g_backline as varchar(9)), ' ranged', case when g_support > 0 then concat(' ', cast(g_support as varchar(9)), ' support') else '' end)"
LABEL: Layer = {"shape_label": cases(*[(c, f"'{v}'") for c, v in _LABELS], otherwise=_COUNTED)}

#: Keys of a team's metric tags, in their order.
METRIC_TAGS = [("g_m_damage >= 11", "damageHigh"), ("g_m_damage <= 9", "damageLow"), ("g_m_defense >= 9", "defenseHigh"), ("g_m_defense <= 6", "defenseLow"), ("g_m_cc >= 9", "ccHigh"), ("g_m_cc <= 5", "ccLow"), ("a_mobility >= 3.6", "mobilityHigh"), ("a_mobility <= 2.2", "mobilityLow"), ("g_m_utility >= 8", "utilityHigh")]


def _reason(*rules: tuple[str, str]) -> str:
    """The first key whose condition holds, else null."""
    return "case " + " ".join(f"when {c} then '{k}'" for c, k in rules) + " end"


_SEL_ENGAGE, _SEL_DIVE = "s_primary_engage > 0", "(s_first_engage > 0 or s_diver >= 1)"
#: Keys of the reasons of a recommendation, in their order; the first three that hold are shown.
REASONS = [
    "case when composition_guide <= -0.75 then " + _reason(
        ("guard_only = 1 and s_melee >= 1", "counterEngagerInMeleeTeam"), (f"cannot_start = 1 and not ({_SEL_ENGAGE})", "engagerNoInitiator"), (f"counter_only = 1 and {_SEL_DIVE} and s_helper = 0", "counterOnlyInEngageTeam"),
        ("poke_then = 1 and s_melee >= 2", "pokeThenEngageMismatch"), ("support = 1 and g_m_damage <= 8", "supporterLowDamage")) + " end",
    _reason(("front_damage_score <= -0.6 and low_front = 1", "tankLowDamage")), _reason(("back_damage_score <= -0.65 and low_back = 1", "utilityOverDamage")), _reason(("damage_budget <= -1.4 and low = 1", "aggravatesDamageLack")),
    _reason((f"weapon_balance <= -0.5 and t_short = 1 and not ({_SEL_ENGAGE})", "shortRangeNoSupport")), _reason(("g_guard_only >= 1 and g_melee >= 1 and is_anchor = 0", "engagerInAnchorTeam")),
    "case when team_shape <= -2.2 then " + _reason(("g_tank >= 1 and g_support >= 1", "tankSupportNoDamage"), (f"{_TBM} and g_tank_leaning = 1", "tankMeleeRangedDamageTank"), (_TBM, "tankMeleeRangedLowDamage"), ("g_reliable < 2", "notEnoughDamageDealer")) + " end",
    "case when damage_budget <= -1.4 then " + _reason(("g_high = 0", "allLowDamage"), ("g_high > 0", "tooManyLowDamage")) + " end",
    _reason(("metric_balance >= 0.65", "metricPositive")), _reason(("metric_balance <= -0.75", "metricNegative")),
    "case when composition_guide >= 0.75 then " + _reason(("g_is_anchor > 0 and g_backline >= 2", "anchorDoubleRanged"), ("g_tank = 1 and g_melee = 2 and g_backline = 0", "tankDoubleMelee"), ("n >= 0", "tempoMatch")) + " end",
    "case when composition_guide <= -0.75 then " + _reason(("g_is_anchor > 0 and g_melee >= 1", "anchorMeleeConflict"), ("g_support > 0 and g_m_damage <= 8", "supporterLowTeamDamage"), ("g_primary_engage = 0 and is_needy + s_is_needy > 0", "noInitiatorForLateEngage"), ("g_cc_power < 1.2", "noTeamControl")) + " end",
    _reason((f"team_shape > -2.2 and {_TBM} and g_tank_leaning = 1", "tankMeleeRangedDamageTankBonus")),
    "case when team_shape >= 1.4 and damage_budget > -1.0 then " + _reason(
        ("g_backline = 3 and g_m_damage >= 11 and (g_m_cc >= 8 or g_m_utility >= 7)", "teamFeatureBackline"), ("g_backline = 0 and g_melee + g_tank = 3 and g_m_damage >= 10 and g_m_cc >= 8 and a_mobility >= 3.0", "teamFeatureMelee"),
        ("g_tank >= 1 and g_backline >= 1", "teamFeatureFrontBack"), ("g_melee >= 2 and g_backline >= 1", "teamFeatureDiveBackline"), ("g_support >= 1 and g_melee >= 2", "teamFeatureSupportMelee"), ("n >= 0", "teamFeatureDefault")) + " end",
    _reason(("front_damage_score >= 0.6 and high_front = 1", "tankWithDamage")), _reason(("front_damage_score <= -0.6 and low_front = 1", "tankLowDamagePenalty")), _reason(("back_damage_score >= 0.65 and high_back = 1", "dealerFillsDamage")), _reason(("back_damage_score <= -0.65 and low_back = 1", "utilityLowDamagePenalty")),
    _reason(("coverage >= 1.8 and added_tags > 0", "addsFunctionTags")), _reason(("cc_coverage >= 0.45 and cc_targeted + cc_other + cc_medium + cc_wide > 0", "addsControl")),
    _reason(("relationship >= 0.7", "feedbackPositive"), ("relationship <= -0.7", "feedbackNegative")), _reason(("kill_pressure > 0 and damage = 'basic'", "normalAttackDealer"), ("kill_pressure > 0 and damage = 'skill'", "skillDealer")),
    "case when weapon_balance > 0.5 then " + _reason(("t_short = 1", "weaponRangeShort"), ("weapon_range = 'ranged'", "weaponRangeRanged"), ("n >= 0", "weaponRangeMelee")) + " end",
    _reason(("t_short = 1 and s_front > 0 and (s_t_cc > 0 or s_t_initiate > 0 or s_cc_power >= 2.0)", "infighterInGoodTeam"), ("t_short = 1 and n >= 2", "infighterNoSupport")),
    _reason(("synergy >= 1.4", "synergyHigh")), _reason(("tournament_composition >= 0.8", "tournamentComboFull"), ("tournament_composition >= 0.25", "tournamentComboPair"), ("tournament_composition <= -0.45", "tournamentComboNegative")),
    _reason(("tournament_archetype >= 0.45", "tournamentArchetypePositive"), ("tournament_archetype <= -0.35", "tournamentArchetypeNegative")), _reason(("ranker_composition >= 1.8", "rankerCompositionPositive"), ("ranker_composition <= -1.1", "rankerCompositionNegative")),
    _reason(("official_match >= 0.75", "officialMatchPositive"), ("official_match <= -0.65", "officialMatchNegative")), _reason(("tier_score >= 1.1", "tierHigh")), _reason(("statistics_score >= 0.8", "statisticsPositive"), ("statistics_score <= -0.75", "statisticsNegative")),
    _reason(("realtime_score >= 0.9", "realtimePositive"), ("realtime_score <= -0.85", "realtimeNegative")), _reason(("conflict <= -2", "roleConflict")), _reason(("n = 0", "firstPickFlexible")),
]
#: What is said where no reason holds.
FALLBACK_REASON = _reason(("t_cc = 1", "controlFallback"), ("t_sustained = 1", "sustainedFallback"), ("t_poke = 1", "pokeFallback"), ("n >= 0", "genericFallback"))
#: What the reasons read besides scores and sums.
REASON_INPUTS: Layer = {
    "added_tags": " + ".join(f"t_{x} * case when s_t_{x} = 0 then 1 else 0 end" for x in REQUIRED),
    "cc_coverage": "coverage - 0.9 * (" + " + ".join(f"t_{x} * case when s_t_{x} = 0 then 1 else 0 end" for x in REQUIRED) + ")",
}


def relative(value: str, base: str, scale: float) -> str:
    """By how much a value is above its base, as a share of it, scaled and limited."""
    return f"case when {value} is null or {base} is null or {base} <= 0 then 0.0 else " + limit(f"({value} - {base}) / {base} * {scale}", -1.2, 1.2) + " end"


RANK_GROUP = "case when role = 'support' then 'support' when role in ('frontline', 'bruiser') then 'front' when role in ('ranged', 'mage') then 'backline' when role = 'assassin' then 'assassin' else 'all' end"
#: Weights of win rate, top-3 rate, placement, damage, durability and control by rank group.
RANK_WEIGHTS = {
    "support": (0.24, 0.34, 0.24, 0.04, 0.04, 0.10), "front": (0.24, 0.26, 0.20, 0.12, 0.10, 0.08), "backline": (0.22, 0.24, 0.16, 0.30, 0.02, 0.06),
    "assassin": (0.24, 0.22, 0.18, 0.28, 0.02, 0.06), "all": (0.24, 0.26, 0.20, 0.18, 0.04, 0.08),
}


def _by_group(k: int) -> str:
    return "case rank_group " + " ".join(f"when '{g}' then {w[k]}" for g, w in RANK_WEIGHTS.items()) + " end"


_VOTED = "coalesce(likes, 0) + coalesce(dislikes, 0)"
#: Ranking of a member over its row (or none), its group's averages, its ranked users' row (k_...) and its votes.
RANKING: Layer = {
    "raw": " + ".join([
        relative("win_rate", "q_win_rate", 1.15) + " * " + _by_group(0), relative("top3_rate", "q_top3_rate", 1.05) + " * " + _by_group(1),
        "case when avg_placement is null or q_avg_placement is null then 0.0 else " + limit("(q_avg_placement - avg_placement) / 1.35", -1.2, 1.2) + " end * " + _by_group(2),
        relative("avg_damage", "q_avg_damage", 0.9) + " * " + _by_group(3), relative("avg_damage_from", "q_avg_damage_from", 0.65) + " * " + _by_group(4), relative("avg_cc_time", "q_avg_cc_time", 0.7) + " * " + _by_group(5)]),
    "fallback": "case when k_games is null then 0.0 else (k_top3 * 30.0 + k_win * 34.0 + least(8.0, k_games * 1.0) - greatest(0.0, coalesce(k_placement, 4.5) - 4.5) * 4.0) * 0.18 end",
    "voted": f"case when {_VOTED} <= 0 then 0.0 else (coalesce(likes, 0) - coalesce(dislikes, 0)) / ({_VOTED} + 0.0) * least(1.0, log2({_VOTED} + 1.0) / 5) * 42.0 * 1.35 end",
}
RANKED: Layer = {"score": "case when games is null then 48.0 else 58.0 + raw * 46.0 * " + limit("log10(games + 1.0) / log10(261.0)", 0, 1) + " end + fallback + voted"}
RANK_LETTER = "case when score >= 76 then 'S' when score >= 66 then 'A' when score >= 55 then 'B' when score >= 44 then 'C' else 'D' end"
OFFICIAL_TEAM_SCORE = "(coalesce(win_rate, 0.0) * 240 + coalesce(top3_rate, 0.0) * 150 + (4.5 - coalesce(avg_placement, 4.5)) * 16) * " + limit("log10(games + 1.0) / log10(81.0)", 0, 1) + " + least(14.0, games * 0.35)"
RANKER_TEAM_SCORE = "(top3_rate * 4.0 + win_rate * 5.0 + least(1.5, games / 8.0) - avg_placement * 0.18) * 20.0"
VOTED_TEAM_SCORE = "(likes - dislikes) / greatest(1.0, likes + dislikes + 0.0) * least(1.0, log2(likes + dislikes + 1.0) / 5) * 42.0 + 12.0"

#: Keys that say why three members fit, by the union search and by the composition list.
TEAM_REASONS: Layer = {
    "union_reason": cases(
        ("g_backline = 3 and (g_t_cc > 0 or g_m_cc >= 9 or g_t_peel + g_t_shield + g_t_healing > 0 or g_m_utility >= 8) and g_m_damage >= 11", "'backlineCC'"),
        ("g_melee + g_tank = 3 and g_t_initiate > 0 and (g_t_cc > 0 or g_m_cc >= 9) and g_m_damage >= 11", "'meleeInitiate'"), ("g_tank > 0 and g_backline > 0", "'frontlineRanged'"), ("g_melee > 0 and g_t_focus > 0", "'bruiserFocus'"),
        ("g_t_initiate > 0 and (g_t_cc > 0 or g_m_cc >= 9)", "'initiateCC'"), (" or ".join(f"({c})" for c, _ in METRIC_TAGS), "'metricTags'"), otherwise="'default'"),
    "composition_reason": cases(
        ("g_tank > 0 and g_backline > 0", "'frontlineRanged'"), ("g_melee > 0 and g_t_focus > 0", "'bruiserFocus'"), ("g_t_initiate > 0 and g_t_cc > 0", "'initiateCC'"), ("g_t_peel > 0 and g_backline > 0", "'peelRanged'"),
        ("g_x_melee > 0 and g_x_ranged > 0", "'mixedRange'"), otherwise="'rankerFrequent'"),
}
