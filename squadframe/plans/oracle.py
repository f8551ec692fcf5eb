"""DuckDB SQL of the queries, over the same tables."""

from __future__ import annotations

from ..sources.adapter import MORE_MEASURES

_TIER = """case when o_totalprice / 30 >= 14000 then 'eternity' when o_totalprice / 30 >= 11000 then 'demigod' when o_totalprice / 30 >= 9000 then 'mithril'
 when o_totalprice / 30 >= 7500 then 'meteor' when o_totalprice / 30 >= 6000 then 'diamond' when o_totalprice / 30 >= 4500 then 'platinum'
 when o_totalprice / 30 >= 3000 then 'gold' when o_totalprice / 30 >= 1500 then 'silver' else 'bronze' end"""


def _compact(x: str) -> str:
    return f"""case when {x} in ('bronze', 'silver', 'gold') then 'iron_gold' when {x} in ('platinum', 'diamond') then 'platinum_diamond'
 when {x} in ('meteor', 'mithril', 'mithril_plus') then 'meteor_mithril' when {x} in ('demigod', 'eternity') then 'demigod_eternity' else coalesce({x}, 'unknown') end"""


def _r(x: str, digits: int = 0) -> str:
    k = f"{10**digits}::double"
    return f"floor(({x}) * {k} + 0.5) / {k}"


def _x(x: str) -> str:
    """An exact sum: of decimals with six digits."""
    return f"sum(({x})::decimal(18, 6))::double"


_MORE = ", ".join(f"{e} as {c}" for c, e in MORE_MEASURES.items())
_BASE = f"""
tiers as (select *, {_TIER} as fine from orders),
team as (select o_orderkey // 8 as game_id, o_orderkey as team_key, (o_orderkey % 8 + 1)::int as rank, {_compact('fine')} as bucket, o_orderdate as collected_at from tiers),
every_player as (select l_orderkey as team_key, p_brand as "character", p_brand || ':' || p_type as variant, p_type as weapon, (p_size % 7)::varchar as core, l_linenumber as kills,
 l_extendedprice as damage, l_extendedprice * l_discount as basic, l_extendedprice * l_tax as skill, l_quantity as cc_time, l_returnflag as tactical,
 {_MORE}, p_size < 48 as mapped
 from lineitem join part on l_partkey = p_partkey),
player as (select * from every_player where mapped),
squad as (select team_key from player group by team_key having count(distinct variant) = 3),
trio as (select team_key from player group by team_key having count(distinct "character") = 3),
row_of as (select p.*, rank, bucket as own, collected_at from player p join squad using (team_key) join team using (team_key)),
fan as (select *, unnest(['all', own]) as bucket from row_of)"""


def _results(member: str, having: int) -> str:
    means = ", ".join(f"{_r(f'{_x(c)} / count(*)')} as avg_{c}" for c in ("damage", "basic", "skill", "item_skill", "direct", "unique_skill", "damage_from", "from_basic", "from_skill"))
    parts = ", ".join(f"{_r(f"{_x(c)} / nullif({_x('damage')}, 0)", 3)} as {c}_share" for c in ("basic", "skill", "item_skill"))
    return f"""count(*) as games, {_r('avg(rank)', 2)} as avg_placement, {_r('count(*) filter (rank = 1) / count(*)', 3)} as win_rate, {_r('count(*) filter (rank <= 3) / count(*)', 3)} as top3_rate,
 {means}, {parts}, {_r(f"{_x('cc_time')} / count(*)", 2)} as avg_cc_time, {_r('sum(cc_count) / count(*)', 2)} as avg_cc_count from fan group by {member} having count(*) >= {having}"""


_CANDIDATE = f"candidate as (select bucket, variant as stat_id, {_results('bucket, variant', 5)})"
_WEIGHT = "exp(-0.02 * greatest(0.0, (epoch_us(timestamp '1998-12-01') - epoch_us(collected_at)) / 86400000000.0))::decimal(38, 24)"


def _pairs(weight: str) -> str:
    return f"""numbered as (select *, row_number() over (partition by team_key, bucket order by variant) as n from fan),
pair as (select a.bucket, least(a.variant, b.variant) as a, greatest(a.variant, b.variant) as b, a.rank, {weight.replace('collected_at', 'a.collected_at')} as w
 from numbered a join numbered b on a.team_key = b.team_key and a.bucket = b.bucket and a.n < b.n),
pair_stats as (select bucket, a, b, {_r('sum(w)::double', 2)} as games, {_r('coalesce(sum(w) filter (rank = 1), 0)::double / sum(w)::double', 3)} as win_rate, {_r('coalesce(sum(w) filter (rank <= 3), 0)::double / sum(w)::double', 3)} as top3_rate from pair group by all)"""


_COMPOSITION = f"""trio_row as (select p.*, rank, unnest(['all', bucket]) as bucket from player p join trio using (team_key) join team using (team_key)),
member_of as (select team_key, bucket, any_value(rank) as rank, list("character" order by "character") as m from trio_row group by team_key, bucket),
view_of as (select bucket, rank, unnest(m) as candidate, m from member_of),
composition as (select bucket, array_to_string(list_filter(m, lambda x: x <> candidate), '|') as teammates, candidate, count(*) as games, {_r('avg(rank)', 2)} as avg_placement,
 {_r('count(*) filter (rank = 1) / count(*)', 3)} as win_rate, {_r('count(*) filter (rank <= 3) / count(*)', 3)} as top3_rate from view_of group by all having count(*) >= 2)"""
_COMBAT = f"""weighed as (select *, {_WEIGHT} as w from fan),
combat as (select bucket, variant as stat_id, {_r('sum(w)::double', 2)} as games, {', '.join(f"{_r(f'sum((w::double * {c})::decimal(38, 24))::double / sum(w)::double', 0 if c == 'damage' else 2)} as avg_{c}" for c in ('kills', 'assists', 'team_kills', 'damage', 'cc_time'))} from weighed group by all)"""
_VOTES = """vote as (select event_id as vote_id, user_id, case user_id % 3 when 0 then 'all' when 1 then 'diamond' else 'mithril_plus' end as tier,
 'c' || user_id % 5 || '+d' || user_id % 4 as team_key, 'x' || (props->>'$.k')::int % 8 as candidate_id, case when event_type = 'error' then -1 else 1 end as value, ts,
 strftime(ts, '%Y-%m-%dT%H') as bucket from events where event_type in ('click', 'purchase', 'error')),
upsert as (select user_id, tier, team_key, candidate_id, bucket, arg_max(value, ts)::int as value, max(ts) as ts from vote group by all),
summary as (select tier, team_key, candidate_id, count(*) filter (value = 1) as likes, count(*) filter (value = -1) as dislikes, count(*) as total, max(ts) as updated_at
 from (select tier, team_key, candidate_id, value, ts from upsert) group by all)"""
_ROSTER = f"""member as (select *, (length(stat_id) + ascii(reverse(stat_id)) + ascii(substr(stat_id, 7, 1))) % 3 as roster from candidate where bucket = 'all'),
ranked as (select *, row_number() over (partition by roster order by win_rate desc, games desc, stat_id) as nth from member),
best as (select roster, nth, stat_id as id, win_rate as rate, split_part(stat_id, ':', 1) as who from ranked where nth <= 12),
triple as (select a.id as id0, b.id as id1, c.id as id2, {_r('(a.rate + b.rate + c.rate) / 3', 4)} as score, a.nth as n0, b.nth as n1, c.nth as n2
 from best a, best b, best c where a.roster = 0 and b.roster = 1 and c.roster = 2 and a.who <> b.who and a.who <> c.who and b.who <> c.who)"""


def _clamp(x: str, low: float, high: float) -> str:
    return f"case when ({x}) is not null then greatest({low}::double, least({high}::double, {x})) end"


_PLACE = f"{_clamp('1.35 * (4.5 - avg_placement) / 3.5 + 1.15 * (top3_rate - 0.375) + 1.45 * (win_rate - 0.125)', -2.4, 2.8)}"
_CONF80 = _clamp("log10(games + 1) / log10(81.0::double)", 0, 1)


_MEAN = f"mean as (select bucket, {_x('games * win_rate')} / sum(games) as g from candidate group by bucket)"
_POWER = _clamp("((win_rate * games + 100 * g) / (games + 100) - g) * 4 * least(1.0::double, log10(games + 1) / 2.5)", -1.0, 1.2)
_SIGNAL = _clamp(f"({_clamp('(avg_kills + avg_assists * 0.5 + avg_team_kills * 0.3) / 6', -0.5, 0.7)} + {_clamp('(avg_damage - 15000) / 20000', -0.5, 0.6)} * 0.4) * least(1.0::double, log10(games + 1) / 2.5)", -0.8, 1.0)
_SYNERGY = """rated as (select bucket, stat_id, (win_rate * games + 80 * g) / (games + 80) as rate from candidate join mean using (bucket)),
hoped as (select p.*, 0.5::double * (coalesce(x.rate, g, 0.5) + coalesce(y.rate, g, 0.5)) as e from pair_stats p left join mean using (bucket)
 left join rated x on x.bucket = p.bucket and x.stat_id = p.a left join rated y on y.bucket = p.bucket and y.stat_id = p.b),
synergy as (select bucket, a, b, games, (games * win_rate + 80 * e) / (games + 80) - e as above from hoped)"""


def _votes_score(likes: str, dislikes: str) -> str:
    n = f"({likes} + {dislikes})"
    return f"case when {n} > 0 then ({likes} - {dislikes}) / {n} * least(1.0::double, {n} / 5.0::double) * 1.5::double else 0 end"


def _q(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


SQL = {
    "official_candidate_stats": _q(_BASE, _CANDIDATE, select="select * from candidate"),
    "official_trait_build": _q(_BASE, f"build as (select bucket, variant as stat_id, core, {_results('bucket, variant, core', 5)})", """used as (select bucket, variant as stat_id, core, tactical, count(*) as uses from fan group by all),
skill as (select bucket, stat_id, core, string_agg(tactical || '=' || uses, ',' order by tactical || '=' || uses) as tactical_skills from
 (select *, row_number() over (partition by bucket, stat_id, core order by uses desc, tactical) as k from used) where k <= 5 group by all)""", select="select * from build left join skill using (bucket, stat_id, core)"),
    "official_trait_top5": _q(_BASE, select="""select * from (select *, row_number() over (partition by bucket, stat_id order by uses desc, core)::int as nth from
 (select bucket, variant as stat_id, core, count(*) as uses from fan group by all)) where nth <= 5"""),
    "official_composition_stats": _q(_BASE, _COMPOSITION, select="select * from composition"),
    "official_pair_stats": _q(_BASE, _pairs("1::decimal(38, 24)"), select="select * from pair_stats"),
    "recency_weighted_pairs": _q(_BASE, _pairs(_WEIGHT), select="select * from pair_stats"),
    "official_combat_stats": _q(_BASE, _COMBAT, select="select * from combat"),
    "drop_reason_audit": _q(_BASE, select="""select count(*) as total, count(*) filter (d = 3) as valid, count(*) filter (d <> 3) as invalid_size, count(*) filter (u > 0) as unknown_member
 from (select team_key, count(*) filter (not mapped) as u, count(distinct variant) filter (mapped) as d from every_player group by team_key)"""),
    "unmapped_codes": "select l_partkey as code, count(*) as misses from lineitem join part on l_partkey = p_partkey where p_size >= 48 group by 1",
    "team_dedup_first_wins": """with t as (select o_orderkey // 8 as game_id, o_orderkey as team_key, (o_orderkey % 8 + 1)::int as rank from orders)
 select game_id, team_key, case when team_key % 3 <> 0 then rank else -rank end as rank, case when team_key % 3 <> 0 then 0 else 1 end as src from t""",
    "weapon_majority_map": _q(_BASE, select="""select code, weapon, n from (select *, row_number() over (partition by code order by n desc, weapon) as k from
 (select core as code, weapon, count(*) as n from player group by all)) where k = 1"""),
    "stat_id_resolution": """with v as (select distinct p_brand as "character", p_brand || ':' || p_type as variant from part)
 select "character", variant, case when count(*) over (partition by "character") = 1 then min(variant) over (partition by "character") else variant end as stat_id from v""",
    "tournament_compositions": _q(_BASE, select=f"""select *, {_r('wins / games', 3)} as win_rate from (select members, count(*) as games, sum((rank = 1)::int)::bigint as wins, sum((rank <= 3)::int)::bigint as top3, {_r('avg(rank)', 2)} as avg_placement from
 (select team_key, any_value(rank) as rank, array_to_string(list_sort(list(distinct "character")), '+') as members from player join trio using (team_key) join team using (team_key) group by team_key)
 group by members) where games >= 2 order by win_rate desc, games desc, members limit 20"""),
    "ml_team_features": _q(_BASE, select=f"""select team_key, own as bucket, rank, count(*)::int as n_players, count(distinct weapon)::int as n_weapons, count(distinct "character")::int as n_characters,
 {_r(_x('damage'), 2)} as damage, {_r(_x('cc_time'), 2)} as cc_time, sum(kills)::int as kills from row_of group by team_key, own, rank"""),
    "bayes_character_power": _q(_BASE, _CANDIDATE, _MEAN, select=f"select bucket, stat_id, {_r(_POWER, 4)} as power from candidate join mean using (bucket)"),
    "bayes_pair_synergy": _q(_BASE, _CANDIDATE, _MEAN, _pairs("1::decimal(38, 24)"), _SYNERGY, select=f"select bucket, a, b, games, {_r(_clamp('above * 5', -1.0, 1.2), 4)} as synergy from synergy"),
    "official_v2_score": _q(_BASE, _CANDIDATE, _MEAN, _pairs("1::decimal(38, 24)"), _SYNERGY, _COMBAT, f"""nth_of as (select bucket, stat_id, row_number() over (partition by bucket order by games desc, stat_id) as k from candidate),
team_of as (select bucket, max(stat_id) filter (k = 1) as first, max(stat_id) filter (k = 2) as second from nth_of group by bucket having max(k) > 1),
power as (select bucket, stat_id, {_POWER} as power from candidate join mean using (bucket)),
signal as (select bucket, stat_id, {_SIGNAL} as signal from combat),
with_one as (select bucket, a as stat_id, b as mate, above from synergy union all select bucket, b, a, above from synergy where a <> b),
gain as (select w.bucket, w.stat_id, sum(above) / 2 as above from with_one w join team_of t on w.bucket = t.bucket and w.mate in (t.first, t.second) where w.stat_id not in (t.first, t.second) group by all)""",
        select=f"""select p.bucket, p.stat_id, first, second, {_r(_clamp(f"power * 0.30::double + {_clamp('coalesce(above, 0) * 5', -1.0, 1.2)} * 0.35::double + coalesce(signal, 0) * 0.15::double", -1.5, 1.8), 4)} as score
 from power p join team_of t on p.bucket = t.bucket and p.stat_id not in (first, second) left join gain g on g.bucket = p.bucket and g.stat_id = p.stat_id left join signal s on s.bucket = p.bucket and s.stat_id = p.stat_id"""),
    "tournament_result_score": _q(_BASE, select=f"""select team_key, {_r(_clamp("0.78::double * (4.5 - rank) / 3.5 + 0.32::double * least(1.0::double, (kills + 8 - rank) / 22) + 0.28::double * least(1.0::double, kills / 14)", -1.15, 1.35), 4)} as score
 from (select team_key, any_value(rank) as rank, sum(kills)::double as kills from player join trio using (team_key) join team using (team_key) group by team_key)"""),
    "feedback_score": _q(_VOTES, f"""heard as (select * from summary where tier in ('diamond', 'all')),
by_team as (select team_key, candidate_id, coalesce(sum(likes) filter (tier = 'diamond'), 0) as l, coalesce(sum(dislikes) filter (tier = 'diamond'), 0) as d,
 coalesce(sum(likes) filter (tier = 'all'), 0) as la, coalesce(sum(dislikes) filter (tier = 'all'), 0) as da from heard group by all),
general as (select candidate_id, sum(likes * case tier when 'all' then 0.65::double else 1 end) as lg, sum(dislikes * case tier when 'all' then 0.65::double else 1 end) as dg from heard group by 1)""",
        select=f"""select team_key, candidate_id, {_r(f"({_votes_score('l', 'd')}) * 0.75::double + ({_votes_score('la', 'da')}) * 0.25::double + ({_votes_score('lg', 'dg')}) * 0.35::double", 4)} as score from by_team join general using (candidate_id)"""),
    "official_candidate_score": _q(_BASE, _CANDIDATE, select=f"""select bucket, stat_id, {_r(_clamp(f"(coalesce({_PLACE}, 0) * 0.75 + case when avg_damage <> 0 then {_clamp('(avg_damage - 18000) / 22000', -0.35, 0.45)} else 0 end * 0.35) * least(1.0::double, log10(games + 1) / 2.2)", -0.95, 1.05), 4)} as score from candidate"""),
    "combat_signal": _q(_BASE, _COMBAT, select=f"select bucket, stat_id, {_r(_SIGNAL, 4)} as signal from combat"),
    "composition_ranking": _q(_BASE, _COMPOSITION, select=f"""select bucket, canonical, games, {_r(f'(240 * win_rate + 150 * top3_rate + 16 * (4.5 - avg_placement)) * {_CONF80} + least(14.0::double, 0.35 * games)', 3)} as score from
 (select *, row_number() over (partition by bucket, canonical order by games desc, candidate, teammates) as k from
 (select *, array_to_string(list_sort(list_distinct(list_append(string_split(teammates, '|'), candidate))), '|') as canonical from composition)) where k = 1"""),
    "tier_buckets": _q(_BASE, select=f"""select o_orderkey as id, fine, {_compact('fine')} as compact,
 case when o_custkey % 1500 > 0 and o_totalprice / 30 >= 6000 and o_custkey % 1500 <= 300 then 'eternity' when o_custkey % 1500 > 0 and o_totalprice / 30 >= 6000 and o_custkey % 1500 <= 1000 then 'demigod' else fine end as titled from tiers"""),
    "tier_bucket_text": """select id, case when t like '%iron%' or t like '%bronze%' then 'bronze' when t like '%silver%' then 'silver' when t like '%gold%' then 'gold' when t like '%platinum%' then 'platinum'
 when t like '%diamond%' then 'diamond' when t like '%meteor%' then 'meteor' when t like '%mithril%' then 'mithril' when t like '%demi%' then 'demigod' when t like '%eternity%' then 'eternity'
 when t like '%titan%' or t like '%immortal%' then 'mithril_plus' end as fine from (select c_custkey as id,
 lower(['Iron IV', 'GOLD', 'Platinum-2', 'diamond', 'Meteorite', 'Mithril', 'Demigod', 'Titan', 'none', ''][(c_custkey % 10 + 1)::int] || '/' || c_mktsegment) as t from customer)""",
    "vote_upsert_hourly": _q(_VOTES, select="select * from upsert"),
    "vote_summary": _q(_VOTES, select="select * from summary"),
    "vote_duplicates": _q(_VOTES, select="select vote_id, bucket, row_number() over (partition by user_id, tier, team_key, candidate_id, bucket order by ts, vote_id) > 1 as was_duplicate from vote"),
    "streamed_first_teams": "select o_custkey, o_orderdate::date as day, min(o_orderkey) as o_orderkey, min_by(o_totalprice, o_orderkey) as o_totalprice from orders group by 1, 2",
    "streamed_recent_votes": _q(_VOTES, select="select vote_id, bucket, row_number() over (partition by user_id, tier, team_key, candidate_id, bucket order by ts, vote_id) > 1 as was_duplicate from vote"),
    "vote_ttl_purge": _q(_VOTES, select="select vote_id, user_id, value from vote where ts >= (select max(ts) from vote) - interval 10 days"),
    "vote_window_counts": _q(_VOTES, select="select bucket, tier, count(*) as votes, sum(value)::bigint as balance from vote group by bucket, tier"),
    "popular_feedback_overall": _q(_VOTES, select=f"""select *, {_r("case when likes + dislikes > 0 then (likes - dislikes) / (likes + dislikes) * least(1.0::double, (likes + dislikes) / 5.0::double) * 1.5 else 0 end", 4)} as score from
 (select array_to_string(list_sort(list_distinct(list_append(string_split(team_key, '+'), candidate_id))), '|') as team, sum(likes)::bigint as likes, sum(dislikes)::bigint as dislikes, sum(total)::bigint as total from summary group by 1)
 order by score desc, likes desc, total desc, team limit 14"""),
    "popular_feedback_recent": _q(_VOTES, select="select tier, team_key, candidate_id, likes, dislikes from summary order by updated_at desc, tier, team_key, candidate_id limit 14"),
    "character_feedback": _q(_VOTES, select=f"""select *, {_r("case when likes + dislikes > 0 then (likes - dislikes) / (likes + dislikes) * least(1.0::double, log2(likes + dislikes + 1.0::double) / 5) * 42 else 0 end", 4)} as bonus from
 (select candidate_id, sum(likes)::bigint as likes, sum(dislikes)::bigint as dislikes from summary group by 1)"""),
    "relationship_score": _q(_VOTES, select=f"""select candidate_id, {_r(_clamp('sum(w * s) / sum(w) * 3.4', -2.2, 2.2), 4)} as score from (select candidate_id,
 h * case when h = 2 then 1.35 else 0.58 end * least(1.4::double, log2(n + 1.0::double) / 3) * case when tier = 'diamond' then 1.15 else 0.75 end * 1.05::double as w, (likes - dislikes) / (n + 6.0::double) * least(1.0::double, log2(n + 1.0::double) / 4) as s
 from (select *, likes + dislikes as n, len(list_intersect(list_append(string_split(team_key, '+'), candidate_id), ['c1', 'd1'])) as h from summary where tier in ('diamond', 'all')) where h > 0 and n > 0) group by candidate_id"""),
    "json_schema_discovery": """with each as (select unnest(json_keys(props)) as path, props from events), v as (select path, try_cast(json_extract_string(props, '$.' || path) as double) as x from each)
 select path, count(*) as n, count(x) as n_numeric, min(x) as least, max(x) as most from v group by path""",
    "payload_coalesce_project": "select event_id, coalesce((props->>'$.count')::double, (props->>'$.games')::double, (props->>'$.k')::double, value, 0) as amount from events",
    "union_combos": _q(_BASE, _CANDIDATE, _ROSTER, select="select id0, id1, id2, score from triple order by score desc, n0, n1, n2 limit 24"),
    "union_combos_capped": _q(_BASE, _CANDIDATE, _ROSTER, select="select id0, id1, id2, score, truncated from (select *, row_number() over (order by n0, n1, n2) as k, count(*) over () > 500 as truncated from triple) where k <= 500 order by score desc, n0, n1, n2 limit 24"),
    "full_team_beam": _q(_BASE, _CANDIDATE, _pairs("1::decimal(38, 24)"), "p as (select a, b, games, win_rate from pair_stats where bucket = 'all' and a <> b)", "side as (select * from p union all select b, a, games, win_rate from p)",
        "anchor as (select stat_id as x from candidate where bucket = 'all' order by games desc, stat_id limit 1)",
        "step1 as (select a as anchor, b as pick1, win_rate as s1 from side where a = (select x from anchor) order by win_rate desc, games desc, b limit 8)",
        "step2 as (select step1.*, b as pick2, win_rate, row_number() over (partition by pick1 order by win_rate desc, games desc, b) as k from side join step1 on a = pick1 where b <> anchor)",
        select=f"select anchor, pick1, pick2, {_r('s1 + win_rate', 3)} as score from step2 where k <= 3"),
    "nearest_template": f"""with e as (select vec_id, embedding::double[] as v, label from embeddings),
 d as (select q.vec_id as slot, t.vec_id, t.label, {_r('list_sum(list_transform(list_zip(t.v, q.v), lambda z: abs(z[1] - z[2]))) / len(t.v)', 6)} as distance from e q join e t on q.vec_id % 20 = 0 and t.vec_id <> q.vec_id)
 select slot, vec_id, label, distance from (select *, row_number() over (partition by slot order by distance, vec_id) as k from d) where k = 1""",
    "graph_expand_depth2": """with e as (select distinct l_suppkey as u, l_orderkey as g from lineitem), s0 as (select distinct u from e where u < 3),
 s1 as (select distinct b.u from s0 join e a using (u) join e b on a.g = b.g where b.u not in (select u from s0)),
 s2 as (select distinct b.u from s1 join e a using (u) join e b on a.g = b.g where b.u not in (select u from s0 union select u from s1))
 select u, 0 as depth from s0 union all select u, 1 from s1 union all select u, 2 from s2""",
    "graph_expand_capped": """with e as (select distinct l_suppkey as u, l_orderkey as g from lineitem), own as (select u, g from (select *, row_number() over (partition by u order by g) as k from e) where k <= 12),
 u0 as (select distinct u from e where u < 3 order by u limit 40), g0 as (select distinct g from own where u in (select u from u0)),
 u1 as (select distinct u from e where g in (select g from g0) and u not in (select u from u0) order by u limit 40), g1 as (select distinct g from own where u in (select u from u1) and g not in (select g from g0)),
 u2 as (select distinct u from e where g in (select g from g1) and u not in (select u from u0 union select u from u1) order by u limit 40),
 g2 as (select distinct g from own where u in (select u from u2) and g not in (select g from g0 union select g from g1))
 select 'user' as kind, u as id, 0 as level from u0 union all select 'user', u, 1 from u1 union all select 'user', u, 2 from u2 union all select 'game', g, 0 from g0 union all select 'game', g, 1 from g1 union all select 'game', g, 2 from g2""",
    "pair_stat_fallback": _q(_BASE, _CANDIDATE, _pairs("1::decimal(38, 24)"), f"""flat as (select a, b, split_part(a, ':', 1) as ca, split_part(b, ':', 1) as cb, games, win_rate from pair_stats where bucket = 'all'),
leveled as (select a as x, b as y, games, win_rate from flat where games >= 3 union all select least(v, c), greatest(v, c), sum(games), {_x('games * win_rate')} / sum(games) from (select a as v, cb as c, games, win_rate from flat union all select b, ca, games, win_rate from flat where a <> b) group by v, c having sum(games) >= 20
 union all select least(ca, cb), greatest(ca, cb), sum(games), {_x('games * win_rate')} / sum(games) from flat group by 1, 2),
topped as (select stat_id as v, split_part(stat_id, ':', 1) as c from candidate where bucket = 'all' order by games desc, stat_id limit 40),
wanted as (select p.v as a, q.v as b, unnest([1, 2, 3, 4]) as priority, unnest([p.v, p.v, p.c, p.c]) as i, unnest([q.v, q.c, q.v, q.c]) as j from topped p join topped q on p.v < q.v),
met as (select w.a, w.b, w.priority, l.games, l.win_rate, row_number() over (partition by w.a, w.b order by w.priority) as k from wanted w join leveled l on l.x = least(w.i, w.j) and l.y = greatest(w.i, w.j))""",
        select=f"select a, b, priority::int as priority, {_r('games', 2)} as games, {_r('win_rate', 4)} as win_rate from met where k = 1"),
    "seed_pool_rotation": _q(f"o as (select o_custkey as user_id, max(o_totalprice) as o_totalprice, count(*) % 2 as prior from orders group by 1)", f"t as (select *, {_TIER} as fine from o)", f"c as (select user_id, {_compact('fine')} as tier, prior from t)",
        select="select * from (select *, row_number() over (partition by tier order by prior, user_id)::int as nth from c) where nth <= 50"),
    "random_seed_sample": "select c_custkey from customer order by md5('7:' || c_custkey), c_custkey limit 100",
    "html_strip": r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 replace(replace(replace(replace(replace(replace(coalesce(html, ''), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
 '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as plain from pages""",
    "name_normalize": "select p_partkey, regexp_replace(lower(p_name), '[&·.\\-_ ''’]', '', 'g') as name from part",
    "csv_escape": """select doc_id, case when regexp_matches(text, '[",\n]') then '"' || replace(text, '"', '""') || '"' else text end as field from documents""",
    "html_escape": """select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped from pages""",
    "initial_search": "select doc_id from documents where contains(lower(text), 'th')",
    "feedback_key_parse": _q(_VOTES, select="select vote_id, tier, team_key, candidate_id from vote"),
    "i18n_render": """select doc_id, replace(replace(case when doc_id % 5 = 0 then case lang when 'de' then 'nichts aus {s}' else 'nothing from {s}' end when doc_id % 7 = 0 then 'unknown.key'
 else case lang when 'de' then '{n} Zeichen aus {s}' when 'fr' then '{n} signes de {s}' else '{n} characters from {s}' end end, '{n}', coalesce(n_chars::varchar, '')), '{s}', coalesce(source, '')) as label from documents""",
}

from .oracle_scores import SCORES_SQL  # noqa: E402  its relations build on those above

from .oracle_cleaning import CLEANING_SQL  # noqa: E402

from .oracle_payload import PAYLOAD_SQL  # noqa: E402

SQL |= SCORES_SQL | CLEANING_SQL | PAYLOAD_SQL
