"""DuckDB SQL of the recommendation's queries: the rules' expressions over relations of its own."""

from __future__ import annotations

import re

from ..functions import rules as K
from ..operators.ranker import REFERENCES, REPEATED, SNAPSHOTS
from ..operators.recommend import _MEANS, SUPPORT, TIERS, TOP
from ..operators.stats import LISTED
from ..sources.dimension import KEYS, LAYERS, PAIR_SCORE, PAIR_WHERE, WEAPONS
from .oracle import _BASE, _CANDIDATE, _COMBAT, _COMPOSITION, _ROSTER, _VOTES, _clamp, _pairs, _q, _r, _results, _votes_score, _x


def _e(expression: str) -> str:
    return re.sub(r"\bcharacter\b", '"character"', K.doubles(expression))


def _layers(name: str, source: str, *layers: K.Layer) -> str:
    """CTEs that add the layers to a relation, the last one under the name given."""
    out = []
    for k, layer in enumerate(layers):
        here = name if k == len(layers) - 1 else f"{name}_{k}"
        out.append(f"{here} as (select *, " + ", ".join(f"{_e(e)} as {c}" for c, e in layer.items()) + f" from {source})")
        source = here
    return ",\n".join(out)


_BY_CODE = f"""coded as (select "character", core as code from player),
listed as (select "character", weapon from (select *, {_e(KEYS['b'])} as b, {_e(KEYS['t'])} as t from (select "character", unnest({WEAPONS}) as weapon from (select distinct "character" from coded))) where {LISTED}),
single as (select "character", min(weapon) as only_one from listed group by 1 having count(*) = 1),
means as (select code, first(only_one order by n desc, only_one) as weapon from (select code, only_one, count(*) as n from coded join single using ("character") group by all) group by 1),
by_code as (select c."character", c.code, c.n as rows, case when s.only_one is not null then c."character" || ':' || s.only_one when l.weapon is not null then c."character" || ':' || l.weapon else c."character" end as stat_id
 from (select "character", code, count(*) as n from coded group by all) c left join single s using ("character") left join means m using (code) left join listed l on l."character" = c."character" and l.weapon = m.weapon)"""
_DOUBLE = {"cc_power", "rt_sum", "rt_hoped", *[f"m_{m}" for m in K.METRICS]}
_MEMBER = ",\n".join([
    "variants as (select distinct p_brand as \"character\", p_type as weapon, p_brand || ':' || p_type as variant from part)", _layers("profile", "variants", *LAYERS),
    f"""rt as (select *, {_e(K.RT_TIER)} as rt_tier from (select stat_id as variant, avg_damage as rt_damage, games as rt_games, win_rate * 100 as rt_win, top3_rate * 100 as rt_top3, avg_placement as rt_rank, avg_kills as rt_kills
 from candidate join (select bucket, stat_id, avg_kills from combat) using (bucket, stat_id) where bucket = 'all')),
hit as (select *, coalesce(avg(rt_damage) filter (rt_damage <> 0) over (partition by rt_group), avg(rt_damage) filter (rt_damage <> 0) over ()) as rt_reference from profile left join rt using (variant))""",
    _layers("member", "hit", K.DAMAGE_LEVEL, K.PREDICATES, K.CONTRIBUTORS)])
_ASKED = f"""topped as (select row_number() over (order by games desc, stat_id) as k, stat_id as v, split_part(stat_id, ':', 1) as c from candidate where bucket = 'all' order by games desc, stat_id limit 6),
wanted as (select x.k || '-' || y.k as sel, (x.k + y.k) % 5 as i, [x.v, y.v] as picked from topped x join topped y on x.k < y.k and x.c <> y.c union all select k::varchar, k % 5, [v] from topped where k <= 2 union all select 'none', 0, [] from topped where k = 1),
named as (select sel, [{', '.join(f"'{t}'" for t in TIERS)}][i + 1] as tier, picked from wanted),
asked as (select sel, tier, picked, case when w in (select bucket from candidate) then w else 'all' end as bucket from (select *, {K.aliased('tier', K.TIER_ALIAS, "coalesce(tier, 'all')")} as w from named)),
picked as (select a.sel, a.tier, a.bucket, m.* from (select sel, tier, bucket, unnest(picked) as variant from asked) a join member m using (variant))"""
_GRID = ",\n".join([
    'sums as (select sel, count(*) as n, list(distinct "character") as taken, ' + ", ".join(f"sum({x})::{'double' if x in _DOUBLE else 'bigint'} as s_{x}" for x in K.SUMMED) + " from picked group by sel)",
    "each_sel as (select sel, tier, bucket, coalesce(n, 0) as n, coalesce(taken, []) as taken, " + ", ".join(f"coalesce(s_{x}, 0) as s_{x}" for x in K.SUMMED) + " from asked left join sums using (sel))",
    'grid_in as (select e.*, m.* from member m join each_sel e on not list_contains(e.taken, m."character"))', _layers("grid", "grid_in", K.TEAM, K.MEANS, K.SCORES, K.BUDGET)])
_MEAN = f"mean as (select bucket, {_x('games * win_rate')} / sum(games) as mean_rate from candidate group by bucket)"
_FELL = """fell_key as (select b.bucket, p.variant, unnest([1, 2, 3, 4]) as level, unnest([b.bucket, b.bucket, 'all', 'all']) as of, unnest([p.variant, p."character", p.variant, p."character"]) as id from (select distinct bucket from asked) b cross join profile p),
fell as (select bucket, variant as stat_id, games, """ + ", ".join(_MEANS) + """ from (select k.bucket, k.variant, c.* exclude (bucket, stat_id), row_number() over (partition by k.bucket, k.variant order by level) as nth from fell_key k join candidate c on c.bucket = k.of and c.stat_id = k.id) where nth = 1)"""
_RANKER = f"""squad_of as (select team_key, list("character" order by "character") as m, first("character" order by kills, variant) as cand from player join trio using (team_key) group by team_key),
view_all as (select o_custkey as user_id, game_id, team_key, rank, cand as candidate, array_to_string(list_concat(m[1:list_position(m, cand) - 1], m[list_position(m, cand) + 1:]), '+') as teammates from squad_of join team using (team_key) join orders on o_orderkey = team_key),
view_one as (select * from (select *, row_number() over (partition by user_id, game_id order by team_key) as k from view_all) where k = 1),
trick as (select user_id, greatest(0, max(c)) / sum(c) as trick from (select user_id, candidate, count(*) as c from view_one group by all) group by user_id),
tricked as (select * from view_one join trick using (user_id)),
ranked_one as (select candidate, count(*) as games, {_r('avg(rank)', 2)} as avg_placement, {_r('count(*) filter (rank = 1) / count(*)', 3)} as win_rate, {_r('count(*) filter (rank <= 3) / count(*)', 3)} as top3_rate, {_r(_x('trick') + ' / count(*)', 3)} as one_trick from tricked group by 1 having count(*) >= 2),
ranked_comp as (select teammates, candidate, count(*) as games, {_r('avg(rank)', 2)} as avg_placement, {_r('count(*) filter (rank = 1) / count(*)', 3)} as win_rate, {_r('count(*) filter (rank <= 3) / count(*)', 3)} as top3_rate, {_r(_x('trick') + ' / count(*)', 3)} as one_trick from tricked group by 1, 2)"""
_SNAP = f"""lettered as (select {K.aliased('bucket', SNAPSHOTS, 'null')} as b, split_part(stat_id, ':', 1) as "character", stat_id, games, avg_placement, win_rate, top3_rate, {_e(K.SNAPSHOT_TIER)} as letter from candidate),
snap_own as (select b, "character", sum(games)::bigint as games, {_r(_x('avg_placement * games') + ' / sum(games)', 2)} as avg_placement, {_r(_x('win_rate * games') + ' / sum(games)', 3)} as win_rate, {_r(_x('top3_rate * games') + ' / sum(games)', 3)} as top3_rate,
 first(letter order by games desc, stat_id) as tier_label from lettered where b is not null group by 1, 2),
snap as (select b as bucket, * exclude (b) from snap_own""" + "".join(f" union all select '{a}', * exclude (b) from snap_own where b = '{b}'" for a, b in REPEATED.items()) + ")"
_REFS = f"""refs as (select members, count(*) as appearances, {_r('avg(rank)', 2)} as rank, {_r('avg(kills)', 2)} as ks, {_r('avg(kills + 8 - rank)', 2)} as ts from
 (select team_key, any_value(rank) as rank, sum(kills) as kills, array_to_string(list_sort(list(distinct "character")), '+') as members from player join trio using (team_key) join team using (team_key) group by team_key)
 group by members having count(*) >= 2 order by appearances desc, members limit {REFERENCES})"""
_AVERAGES = ("with_group as (select c.*, p.rt_group from candidate c join profile p on p.variant = c.stat_id where games > 0),\n"
    + "averages as (select bucket, rt_group, " + ", ".join(f"case when n >= {SUPPORT} then o_{c} else w_{c} end as q_{c}" for c in _MEANS)
    + " from (select bucket, rt_group, count(*) as n, " + ", ".join(f"{_x(f'{c} * games')} / sum(games) as o_{c}" for c in _MEANS) + " from with_group group by all) join (select bucket, " + ", ".join(f"{_x(f'{c} * games')} / sum(games) as w_{c}" for c in _MEANS) + " from with_group group by all) using (bucket))")
_VALUES = ",\n".join([
    f"""asked_tier as (select distinct tier, bucket, {K.aliased('tier', K.SNAPSHOT_ALIAS, "'all'")} as shown from asked),
of_all as (select {', '.join(f"{_r(f'avg(rt_{c})', 6)} as v_{c}" for c in ('win', 'top3', 'rank', 'kills'))} from member where rt_damage is not null),
value_in as (select t.tier, t.bucket, m.variant, m.front, m.rt_damage, m.rt_games, m.rt_win, m.rt_top3, m.rt_rank, m.rt_kills, m.rt_tier, m.rt_reference, f.* exclude (bucket, stat_id), a.* exclude (bucket, rt_group), mean_rate,
 c.games as c_games, c.avg_damage as c_damage, c.avg_kills, c.avg_assists, c.avg_team_kills, k.games as k_games, k.avg_placement as k_placement, k.top3_rate as k_top3, k.win_rate as k_win, k.one_trick as k_trick,
 coalesce(s1.tier_label, s2.tier_label) as tier_label, coalesce(s1.games, s2.games) as p_games, coalesce(s1.avg_placement, s2.avg_placement) as p_placement, coalesce(s1.top3_rate, s2.top3_rate) as p_top3, coalesce(s1.win_rate, s2.win_rate) as p_win, o.*
 from asked_tier t cross join member m left join fell f on f.bucket = t.bucket and f.stat_id = m.variant left join averages a on a.bucket = t.bucket and a.rt_group = m.rt_group join mean on mean.bucket = t.bucket
 left join combat c on c.bucket = t.bucket and c.stat_id = m.variant left join ranked_one k on k.candidate = m."character" left join snap s1 on s1.bucket = t.shown and s1."character" = m."character" left join snap s2 on s2.bucket = 'all' and s2."character" = m."character" cross join of_all o)""",
    _layers("value", "value_in", K.OFFICIAL, K.META, K.COMBINED)])
_TEAMS = ",\n".join([
    f"""numbered_c as (select distinct "character", {_e(KEYS['b'])} as b from variants),
scored_pair as (select a, z, {_e(PAIR_SCORE)} as score from (select x."character" as a, y."character" as z, least(x.b, y.b) as lo, greatest(x.b, y.b) as hi from numbered_c x join numbered_c y on x.b <> y.b) where {PAIR_WHERE}),
syn as (select sel, z as "character", sum(score) as pair_sum, count(*) as pairs from picked join scored_pair on a = "character" group by all),
size_of as (select sel, tier, count(*) as k, count(distinct "character") as kd, list_sort(list("character")) as own from picked group by all),
rc_hit as (select sel, teammates, candidate, any_value(games) as games, any_value(avg_placement) as avg_placement, any_value(win_rate) as win_rate, any_value(top3_rate) as top3_rate, any_value(one_trick) as one_trick, count(*) as hits from
 (select *, unnest(string_split(teammates, '+')) as mate from ranked_comp) c join (select distinct sel, "character" from picked) p on p."character" = c.mate group by sel, teammates, candidate),
rc_w as (select sel, candidate, {_e(f"hits * case when hits = kd then 1.45 else 0.48 end * least(1.25, log2(games + 1.0) / 4.5) * {K.TRICK_WEIGHT}")} as w, {_e(K.RANKER_SCORE)} as s from rc_hit join size_of using (sel)),
rc as (select sel, candidate as "character", {_clamp('sum(s * w) / sum(w) * 1.7', -2.8, 2.8)} as ranker_composition from rc_w group by all),
ref_each as (select *, unnest(string_split(members, '+')) as m from refs),
tc_hit as (select sel, members, count(*) as hits from ref_each join picked on m = "character" group by all)""",
    _layers("tc_row", "(select e.*, h.sel, h.hits, s.k from ref_each e join tc_hit h using (members) join size_of s using (sel))", {"exact": "case when k >= 2 and hits = k then 1 else 0 end", "result": K.RESULT_SCORE}, {"mw": "case when exact = 1 then 1.2 when k = 1 then 0.45 else 0.5 end"}),
    f"""tc_sum as (select sel, m, {_e("sum(result * mw * least(1.1, log2(appearances + 1.0)))")} as score, sum(mw) as w, sum(exact) as exact, {_e("sum(exact * greatest(0.1, result))")} as es from tc_row group by all),
tc as (select sel, m as "character", {_e("greatest(-0.5, least(case when exact > 0 then 1.1 else 0.55 end + bonus, score / w + bonus))")} as tournament_composition from (select *, {_e("case when exact > 0 then least(1.5, exact * 0.6 + es * 0.4) else 0.0 end")} as bonus from tc_sum)),
first_of as (select * from (select *, row_number() over (partition by "character" order by variant) as k from member) where k = 1),
known as (select members, any_value(e.rank) as rank, any_value(ts) as ts, any_value(ks) as ks, {', '.join(f"{_r(f'sum(m_{x}) / count(*)', 2)} as f_{x}" for x in K.METRICS[1:])} from ref_each e join first_of f on f."character" = e.m group by members having count(*) >= 3),
ta_in as (select g.sel, g.variant, k.rank, k.ts, k.ks, len(list_intersect(list_append(taken, g."character"), string_split(members, '+'))) as overlap, greatest(0.0::double, 1 - ({' + '.join(f'abs(a_{x} - f_{x})' for x in K.METRICS[1:])}) / 7.5::double) as similarity
 from grid g, known k where g.n >= 2),
ta_w as (select *, {_e(K.RESULT_SCORE)} as result, {_e("similarity * case when overlap >= 2 then 1.0 when overlap = 1 then 0.45 else 0.22 end")} as w from ta_in where similarity >= 0.72::double or overlap > 0),
ta as (select sel, variant, case when sum(w) = 0 then 0 else {_clamp('sum(result * w) / sum(w) * least(1.0::double, max(similarity) + 0.08::double) * 0.9::double', -0.8, 1.15)} end as tournament_archetype from ta_w group by all),
rated_f as (select bucket, stat_id, (win_rate * games + 80 * mean_rate) / (games + 80.0::double) as rate from fell join mean using (bucket)),
sided as (select bucket, a as mate, b as other, games, win_rate from pair_stats union all select bucket, b, a, games, win_rate from pair_stats where a <> b),
ps as (select sel, other as variant, sum((games * win_rate + 80 * e) / (games + 80.0::double) - e) as pair_above from (select p.sel, s.other, s.games, s.win_rate, 0.5::double * (coalesce(r1.rate, mean_rate) + coalesce(r2.rate, mean_rate)) as e
 from sided s join picked p on p.bucket = s.bucket and p.variant = s.mate join mean on mean.bucket = s.bucket left join rated_f r1 on r1.bucket = s.bucket and r1.stat_id = s.mate left join rated_f r2 on r2.bucket = s.bucket and r2.stat_id = s.other) group by all),
cv as (select tier as heard, list_sort(['Brand#' || (split_part(team_key, '+', 1)[2:]::int + 9), 'Brand#' || (split_part(team_key, '+', 2)[2:]::int + 14)]) as tm, 'Brand#' || (candidate_id[2:]::int + 1) as candidate, likes, dislikes from summary),
re_in as (select s.sel, s.tier, s.kd, v.heard, v.fin, v.likes, v.dislikes, len(list_intersect(v.fin, s.own)) as hits from (select *, list_distinct(list_append(tm, candidate)) as fin from cv where likes + dislikes > 0) v join size_of s on s.tier = 'all' or v.heard = s.tier or v.heard = 'all'),
re_w as (select sel, unnest(fin) as "character", hits * case when hits = kd then 1.35::double else 0.58::double end * least(1.4::double, log2(likes + dislikes + 1.0::double) / 3) * case when heard = tier then 1.15::double else 0.75::double end * 1.05::double as w,
 (likes - dislikes) / (likes + dislikes + 6.0::double) * least(1.0::double, log2(likes + dislikes + 1.0::double) / 4) as s from re_in where hits > 0),
re as (select sel, "character", {_clamp('sum(s * w) / sum(w) * 3.4', -2.2, 2.2)} as relationship from re_w group by all),
fb_in as (select a.sel, a.tier, v.candidate, v.heard, v.likes, v.dislikes, coalesce(len(s.own) = 2 and s.own = v.tm, false) as same from asked a join cv v on a.tier = 'all' or v.heard = a.tier or v.heard = 'all' left join size_of s using (sel)),
fb_sum as (select sel, tier, candidate, {', '.join(f"coalesce(sum({c}) filter (same and heard = tier), 0) as {c}_o, coalesce(sum({c}) filter (same and heard = 'all'), 0) as {c}_a, sum({c} * case when heard = tier then 1.0::double else 0.65::double end) as {c}_g" for c in ('likes', 'dislikes'))} from fb_in group by all),
fb as (select sel, candidate as "character", case when tier = 'all' then {_votes_score('likes_o', 'dislikes_o')} else ({_votes_score('likes_o', 'dislikes_o')}) * 0.75::double + ({_votes_score('likes_a', 'dislikes_a')}) * 0.25::double end + ({_votes_score('likes_g', 'dislikes_g')}) * 0.35::double as feedback from fb_sum),
all_in as (select g.*, pair_sum, pairs, coalesce(ranker_composition, 0) as ranker_composition, coalesce(tournament_composition, 0) as tournament_composition, coalesce(tournament_archetype, 0) as tournament_archetype, coalesce(relationship, 0) as relationship, coalesce(feedback, 0) as feedback,
 v.* exclude (tier, bucket, variant, front, {', '.join(f'rt_{c}' for c in ('damage', 'games', 'win', 'top3', 'rank', 'kills', 'tier', 'reference'))}), case when n = 0 then 0 else (coalesce(pair_sum, 0) + (n - coalesce(pairs, 0)) * 6.2::double) / n - 6.2::double end as synergy,
 case when n = 0 then 0 else {_clamp('coalesce(pair_above, 0) / n * 5', -1.0, 1.2)} end as pair_synergy
 from grid g left join syn using (sel, "character") left join rc using (sel, "character") left join tc using (sel, "character") left join ta using (sel, variant) left join value v using (tier, bucket, variant) left join ps using (sel, variant) left join re using (sel, "character") left join fb using (sel, "character"))""",
    _layers("done", "all_in", K.V2, K.TOTAL, K.REASON_INPUTS)])

_SMALL = (_BASE, _CANDIDATE, _COMBAT, _MEMBER, _ASKED)
_ALL = (*_SMALL, _GRID, _MEAN, _FELL, _RANKER, _SNAP, _REFS, _AVERAGES, _VALUES, _pairs("1::decimal(38, 24)"), _VOTES, _TEAMS)


def _four(*columns: str) -> str:
    return ", ".join(f"{_r(c, 4)} as {c}" for c in columns)


_TAG_LIST = ", ".join(_e(f"case when {c} then '{k}' end") for c, k in K.METRIC_TAGS)
_SAID = f"list_filter([{', '.join(_e(x) for x in K.REASONS)}], lambda x: x is not null)[1:3]"
SCORES_SQL = {
    "ranker_candidate_stats": _q(_BASE, _RANKER, select="select * from ranked_one"),
    "ranker_composition_stats": _q(_BASE, _RANKER, select="select * from ranked_comp"),
    "tier_snapshot_argmax": _q(_BASE, _CANDIDATE, _SNAP, select="select * from snap"),
    "member_predicates": _q(_BASE, _CANDIDATE, _COMBAT, _MEMBER, select=f"select variant, role, weapon_range, style, {_four('cc_power')}, {', '.join(x for x in K.SHAPE if x not in ('tank', 'melee'))}, primary_engage, long_poke, {', '.join(f'm_{m}' for m in K.METRICS)} from member"),
    "team_shape": _q(*_SMALL, _GRID, _layers("labelled", "grid", K.LABEL), select=f"select sel, variant, {', '.join(f'g_{x}' for x in K.SHAPE)}, shape_label from labelled"),
    "team_metric_profile": _q(*_SMALL, _GRID, select=f"select sel, variant, {', '.join(f'g_m_{m}, a_{m}' for m in K.METRICS)}, coalesce(nullif(array_to_string(list_filter([{_TAG_LIST}], lambda x: x is not null)[1:3], ' '), ''), 'balanced') as reason from grid"),
    "score_rules": _q(*_SMALL, _GRID, select=f"select sel, variant, {_four(*K.SCORES, *K.BUDGET)} from grid"),
    "official_fallback_scores": _q(_BASE, _BY_CODE, f"""coded_row as (select r.*, i.stat_id from row_of r join by_code i on i."character" = r."character" and i.code = r.core),
coded_fan as (select *, unnest(['all', own]) as bucket from coded_row),
known as (select bucket, stat_id, {_results('bucket, stat_id', 5).replace('from fan', 'from coded_fan')}),
mean as (select bucket, {_x('games * win_rate')} / sum(games) as mean_rate from known group by bucket),
who as (select distinct p_brand as "character", p_brand || ':' || p_type as variant from part),
ask as (select b.bucket, w.variant, unnest([1, 2, 3, 4]) as level, unnest([b.bucket, b.bucket, 'all', 'all']) as of, unnest([w.variant, w."character", w.variant, w."character"]) as id from (select distinct bucket from known) b cross join who w),
hit as (select a.bucket, a.variant, a.level::int as level, k.games, k.win_rate from ask a join known k on k.bucket = a.of and k.stat_id = a.id qualify row_number() over (partition by a.bucket, a.variant order by a.level) = 1),
rated as (select bucket, variant, (win_rate * games + 80 * mean_rate) / (games + 80.0::double) as rate from hit join mean using (bucket)),
nth_of as (select *, row_number() over (partition by team_key, bucket order by stat_id) as k from coded_fan),
pair as (select a.bucket, least(a.stat_id, b.stat_id) as a, greatest(a.stat_id, b.stat_id) as b, count(*) as games, {_r('count(*) filter (a.rank = 1) / count(*)', 3)} as win_rate from nth_of a join nth_of b on a.team_key = b.team_key and a.bucket = b.bucket and a.k < b.k group by all),
best as (select bucket, case when stat_id in (select "character" from who) then (select min(variant) from who where "character" = stat_id) else stat_id end as mate from known qualify row_number() over (partition by bucket order by games desc, stat_id) <= 2),
cross_of as (select b.bucket, b.mate, w.variant, c.level, least(c.i, c.j) as a, greatest(c.i, c.j) as b from best b join who m on m.variant = b.mate cross join who w
 cross join lateral (select unnest([1, 2, 3, 4]) as level, unnest([w.variant, w.variant, w."character", w."character"]) as i, unnest([m.variant, m."character", m.variant, m."character"]) as j) c),
played as (select x.bucket, x.mate, x.variant, p.games, p.win_rate from cross_of x join pair p on p.bucket = x.bucket and p.a = x.a and p.b = x.b qualify row_number() over (partition by x.bucket, x.mate, x.variant order by x.level) = 1),
gain as (select bucket, variant, sum((games * win_rate + 80 * e) / (games + 80.0::double) - e) as above from (select p.*, 0.5::double * (coalesce(y.rate, mean_rate) + coalesce(z.rate, mean_rate)) as e from played p join mean using (bucket)
 left join rated y on y.bucket = p.bucket and y.variant = p.mate left join rated z on z.bucket = p.bucket and z.variant = p.variant) group by all)""",
        select=f"""select bucket, variant, level, games, {_r(_clamp("((win_rate * games + 100 * mean_rate) / (games + 100.0::double) - mean_rate) * 4 * least(1.0::double, log10(games + 1.0::double) / 2.5::double)", -1.0, 1.2), 4)} as power,
 {_r(_clamp('coalesce(above, 0) / 2 * 5', -1.0, 1.2), 4)} as synergy from hit join mean using (bucket) left join gain using (bucket, variant)"""),
    "group_average_fallback": _q(*_SMALL, _AVERAGES, select=f"select bucket, rt_group, {_four(*[f'q_{c}' for c in _MEANS])} from averages"),
    "tier_alias_fallback": _q(_BASE, _CANDIDATE, """names as (select unnest(range(11))::int as id, unnest(['all', 'iron_bronze', 'silver_gold', 'iron_gold', 'platinum_diamond', 'diamond', 'mithril_plus', 'meteor_mithril', 'demigod_eternity', 'elsewhere', null]) as tier)""",
        select=f"""select id, tier, case when w in (select bucket from candidate) then w else 'all' end as bucket, {K.aliased('tier', K.SNAPSHOT_ALIAS, "'all'")} as shown from (select *, {K.aliased('tier', K.TIER_ALIAS, "coalesce(tier, 'all')")} as w from names)"""),
    "official_meta_score": _q(*_SMALL, _MEAN, _FELL, _RANKER, _SNAP, _AVERAGES, _VALUES, select=f"select tier, bucket, variant, {_four(*K.OFFICIAL, 'legacy_meta', 'official_match', 'meta')} from value"),
    "score_references": _q(*_ALL, select=f"select sel, variant, {_four('synergy', 'ranker_composition', 'tournament_composition', 'tournament_archetype', 'pair_synergy', 'official_v2', 'relationship', 'feedback')} from done"),
    "recommend_topk": _q(*_ALL, f"placed as (select *, {_r('total', 1)} as score from done)", 'one_of as (select * from (select *, row_number() over (partition by sel, "character" order by score desc, variant) as k1 from placed) where k1 = 1)',
        f"best_of as (select *, row_number() over (partition by sel order by score desc, variant)::int as place from one_of)",
        select=f"select sel, tier, bucket, place, variant, score, {_r('total', 3)} as total, case when len(said) > 0 then array_to_string(said, ' ') else {_e(K.FALLBACK_REASON)} end as reasons from (select *, {_SAID} as said from best_of where place <= {TOP})"),
}

_RANK_MEANS = [*_MEANS, "avg_cc_time"]
_CV = "cv as (select list_sort(['Brand#' || (split_part(team_key, '+', 1)[2:]::int + 9), 'Brand#' || (split_part(team_key, '+', 2)[2:]::int + 14)]) as tm, 'Brand#' || (candidate_id[2:]::int + 1) as candidate, likes, dislikes from summary)"
_RANKING = ",\n".join([
    f"well as (select * from candidate where games >= 25), grouped as (select *, {K.RANK_GROUP} as rank_group from profile),\nwg as (select c.*, g.rank_group from well c join grouped g on g.variant = c.stat_id)",
    "avg6 as (select bucket, rank_group, " + ", ".join(f"case when n >= 6 then o_{c} else w_{c} end as q_{c}" for c in _RANK_MEANS) + " from (select bucket, rank_group, count(*) as n, " + ", ".join(f"{_x(f'{c} * games')} / sum(games) as o_{c}" for c in _RANK_MEANS)
    + " from wg group by all) join (select bucket, " + ", ".join(f"{_x(f'{c} * games')} / sum(games) as w_{c}" for c in _RANK_MEANS) + " from wg group by all) using (bucket))",
    """ids as (select bucket, stat_id from well union select b.bucket, k.candidate from (select distinct bucket from well) b cross join ranked_one k where not exists (select 1 from well w where w.bucket = b.bucket and split_part(w.stat_id, ':', 1) = k.candidate)),
voted_for as (select candidate, sum(likes) as likes, sum(dislikes) as dislikes from cv group by 1),
rank_in as (select i.bucket, i.stat_id, coalesce(g.rank_group, (select min_by(rank_group, variant) from grouped z where z."character" = i.stat_id)) as rank_group, w.* exclude (bucket, stat_id), a.* exclude (bucket, rank_group),
 k.games as k_games, k.avg_placement as k_placement, k.top3_rate as k_top3, k.win_rate as k_win, v.likes, v.dislikes
 from ids i left join grouped g on g.variant = i.stat_id left join well w on w.bucket = i.bucket and w.stat_id = i.stat_id left join avg6 a on a.bucket = i.bucket and a.rank_group = g.rank_group
 left join ranked_one k on k.candidate = split_part(i.stat_id, ':', 1) left join voted_for v on v.candidate = split_part(i.stat_id, ':', 1))""",
    _layers("rank_of", "rank_in", K.RANKING, K.RANKED)])
_COMBINED = f"""src as (select *, case bucket when 'all' then 1 else 0 end as src from composition where bucket in ('platinum_diamond', 'all')),
canon as (select *, array_to_string(list_sort(list_distinct(list_append(string_split(teammates, '|'), candidate))), '+') as team from src),
off as (select team, games, {_e(K.OFFICIAL_TEAM_SCORE)} as s from (select *, row_number() over (partition by team order by games desc, src, candidate, teammates) as k from canon) where k = 1 order by {_r('s', 6)} desc, team limit 16),
fbk as (select team, likes, dislikes, {_e(K.VOTED_TEAM_SCORE)} as s from (select array_to_string(list_sort(list_distinct(list_append(tm, candidate))), '+') as team, sum(likes)::bigint as likes, sum(dislikes)::bigint as dislikes from cv group by 1) where likes > 0 order by likes - dislikes desc, likes desc, likes + dislikes desc, team limit 14),
both_of as (select coalesce(o.team, f.team) as team, o.games, f.likes, f.dislikes, case when o.team is not null and f.team is not null then 'mixed' when o.team is not null then 'official' else 'feedback' end as source, coalesce(o.s, 0) + coalesce(f.s, 0) as s from off o full join fbk f on o.team = f.team)"""
SCORES_SQL |= {
    "character_ranking": _q(_BASE, _CANDIDATE, _VOTES, _CV, _RANKER, _MEMBER.split(",\nrt as")[0], _RANKING,
        select=f"select bucket, stat_id, coalesce(games, k_games, 0) as games, {_r('score', 4)} as score, {K.RANK_LETTER} as letter, row_number() over (partition by bucket order by {_r('score', 4)} desc, stat_id)::int as place from rank_of"),
    "character_rank_tiers": _q(_BASE, _CANDIDATE, _VOTES, _CV, _RANKER, _MEMBER.split(",\nrt as")[0], _RANKING, select=f"select bucket, {K.RANK_LETTER} as letter, count(*) as members from rank_of group by all"),
    "combined_composition_ranking": _q(_BASE, _COMPOSITION, _ROSTER, _VOTES, _CV, _COMBINED, select=f"select team, games, likes, dislikes, source, {_r('s', 4)} as score from both_of order by {_r('s', 4)} desc, team limit 14"),
    "ranker_composition_ranking": _q(_BASE, _RANKER, "canon as (select *, array_to_string(list_sort(list_distinct(list_append(string_split(teammates, '+'), candidate))), '+') as team from ranked_comp)",
        select=f"select team, games, {_r(_e(K.RANKER_TEAM_SCORE), 4)} as score from (select *, row_number() over (partition by team order by games desc, top3_rate desc, teammates, candidate) as k from canon) where k = 1 order by score desc, team limit 16"),
    "official_composition_score": _q(*_SMALL, _COMPOSITION, f"""size_of as (select sel, count(*) as k from picked group by sel),
rows_of as (select a.sel, c.teammates, c.candidate, c.games, c.avg_placement, c.win_rate, c.top3_rate, c.bucket from asked a join composition c on c.bucket = a.bucket or c.bucket = 'all'),
matched as (select sel, teammates, candidate, bucket, any_value(games) as games, any_value(avg_placement) as avg_placement, any_value(win_rate) as win_rate, any_value(top3_rate) as top3_rate, count(*) as hits from
 (select *, unnest(string_split(teammates, '|')) as mate from rows_of) r join (select distinct sel, "character" from picked) p using (sel) where p."character" = r.mate group by sel, teammates, candidate, bucket),
weighed_c as (select sel, candidate, {_e("hits * case when hits = k then 1.25 else 0.42 end * least(1.1, log2(games + 1.0) / 4)")} as w, {_e(K.RANKER_SCORE)} as s from matched join size_of using (sel))""",
        select=f"select sel, candidate, {_r(_clamp('sum(s * w) / sum(w) * 1.25::double', -1.4, 1.5), 4)} as score from weighed_c where (sel, candidate) not in (select sel, \"character\" from picked) group by all"),
}

_PICKED = "picked as (select a.sel, a.tier, a.bucket, m.* from (select sel, tier, bucket, unnest(picked) as variant from asked) a join member m using (variant))"
_AFTER = (_MEAN, _FELL, _RANKER, _SNAP, _REFS, _AVERAGES, _VALUES, _pairs("1::decimal(38, 24)"), _VOTES, _TEAMS)
_ANCHOR = "(select stat_id from candidate where bucket = 'all' order by games desc, stat_id limit 1)"
_MEMBERS = (_BASE, _CANDIDATE, _COMBAT, _MEMBER)
SCORES_SQL |= {
    "damage_reference": _q(*_MEMBERS, select=f"""select "group", count(*) as members, {_r('avg(rt_damage)', 3)} as mean_damage from (select unnest([rt_group, 'all']) as "group", rt_damage from member where rt_damage <> 0) group by 1"""),
    "union_combos_scored": _q(*_MEMBERS, _ROSTER.replace("member as (", "rostered as (").replace("from member)", "from rostered)").replace(" where nth <= 12", ""), "asked as (select x.id || '|' || y.id as sel, 'all' as tier, 'all' as bucket, [x.id, y.id] as picked, x.roster as ra, y.roster as rb, x.id as va, y.id as vb from best x join best y on x.roster < y.roster and x.who <> y.who)", _PICKED,
        _GRID.replace("list_contains(e.taken, m.\"character\"))", "list_contains(e.taken, m.\"character\") where m.variant in (select id from best))"), *_AFTER,
        "rounded_of as (select d.variant, a.ra, a.rb, a.va, a.vb, b.roster, floor(d.total * 10.0::double + 0.5) / 10.0::double as score from done d join asked a using (sel) join best b on b.id = d.variant where b.roster <> a.ra and b.roster <> a.rb)",
        select=f"""select id0, id1, id2, {_r('avg(score)', 1)} as score from (select score, {', '.join(f"case when roster = {k} then variant when ra = {k} then va else vb end as id{k}" for k in range(3))} from rounded_of) group by all order by score desc, id0, id1, id2 limit 24"""),
    "full_team_recommend": _q(*_MEMBERS, f"""asked as (select 'one' as sel, 'all' as tier, 'all' as bucket, [{_ANCHOR}] as picked union all select variant, 'all', 'all', [{_ANCHOR}, variant] from member where "character" <> split_part({_ANCHOR}, ':', 1))""", _PICKED, _GRID, *_AFTER,
        f"placed as (select sel, variant, \"character\", {_r('total', 1)} as score from done)", 'one_of as (select * from (select *, row_number() over (partition by sel, "character" order by score desc, variant) as k1 from placed) where k1 = 1)',
        "best_of as (select *, row_number() over (partition by sel order by score desc, variant) as place from one_of)",
        """chained as (select a.variant as pick1, b.variant as pick2, a.score + b.score as s, row_number() over (partition by least(a."character", b."character"), greatest(a."character", b."character") order by a.place, b.place) as k
 from best_of a join best_of b on b.sel = a.variant where a.sel = 'one' and a.place <= 8 and b.place <= 3)""",
        select=f"select {_ANCHOR} as anchor, pick1, pick2, {_r('s', 1)} as score from chained where k = 1"),
    "stat_id_by_code": _q(_BASE, _BY_CODE, select="select * from by_code"),
}
