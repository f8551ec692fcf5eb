"""DuckDB SQL of the cleaning queries."""

from __future__ import annotations

from ..functions import rules as K
from ..functions.exprs import COMPOUNDS, LOW_DAMAGE, REASON_LABELS
from ..operators.cleaning import QUERIES_OF_NAMES
from .oracle import _BASE, _CANDIDATE, _COMBAT, _VOTES, _clamp, _q, _r
from .oracle_scores import _GRID, _MEMBER, _SMALL, _layers


def _values(rows: list[str]) -> str:
    return ", ".join(f"('{x}')" for x in rows)


def _form(x: str) -> str:
    x = f"lower({x})"
    for c, parts in COMPOUNDS.items():
        x = f"replace({x}, '{c}', '{parts}')"
    return x


def _initials(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: case when unicode(c) between 44032 and 55203 then substr('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ', ((unicode(c) - 44032) // 588 + 1)::int, 1) else c end), '')"


def _clean(x: str) -> str:
    y = f"trim(split_part(trim(coalesce({x}, '')), ':', 1))"
    return f"case when lower({y}) in ('', 'empty', 'null', 'undefined', 'none') then '' else {y} end"


_VERSION = "('v' || o_orderkey % 3 || '.' || o_orderkey % 11 || case when o_orderkey % 2 = 0 then '.0' else '.b' end)"
_METRIC_NAMES = ["difficulty", "damage", "defense", "control", "mobility", "utility"]
_LINE = " || ".join(
    f"(['<p>{n} : ' || v{k} || '</p>', '<td>{n}</td><td>' || v{k} || '</td>', '<p>{n}' || v{k} || '</p>', '<p>{n} <b>＝</b> 9 {n} = ' || v{k} || '</p>'])[(page_id + {k}) % 4 + 1]" for k, n in enumerate(_METRIC_NAMES))
_LABELS = ", ".join("case when regexp_matches(t, '" + p + "') then " + (f"case when regexp_matches(t, '{LOW_DAMAGE}') then 'damageLow' else '{k}' end" if k == "damageNeeded" else f"'{k}'") + " end" for p, k in REASON_LABELS)
_TAGS = ", ".join(f"case when t_{t} = 1 then '{t}' end" for t in K.TAGS)
_REQUIRED = ", ".join(f"'{t}'" for t in K.REQUIRED)
_GREY = "p[4 * i + 1] * 0.299 + p[4 * i + 2] * 0.587 + p[4 * i + 3] * 0.114"
_PROFILE = _MEMBER.split(",\nrt as")[0]

CLEANING_SQL = {
    "scalar_rules": f"""with o as (select *, (o_custkey % 100) / 100.0::double as share, o_orderpriority || o_orderkey as secret, {_VERSION} as version from orders),
v as (select *, list_transform([split_part(substr(version, 2), '.', 1), split_part(substr(version, 2), '.', 2), split_part(substr(version, 2), '.', 3)], lambda p: coalesce(try_cast(p as int), 0)) as ver from o)
 select o_orderkey, case when share >= 0.82 then 0.15 when share >= 0.68 then 0.35 when share >= 0.52 then 0.65 else 1.0 end::double as trick, [1.4, 1.1, 0.75, 0.3, -0.25, -0.65, 0][o_orderkey % 7 + 1]::double as tier_weight,
 case when o_totalprice / 30 >= 9000 then 'mithril_plus' when o_totalprice / 30 >= 7000 then 'diamond' when o_totalprice / 30 >= 5200 then 'platinum' when o_totalprice / 30 >= 3600 then 'gold' when o_totalprice / 30 >= 2000 then 'silver' else 'bronze' end as legacy_tier,
 {_r(_clamp('(o_totalprice - 250000) / 250000 * 0.9::double', -1.2, 1.2), 4)} as relative, {_r(_clamp('(4.4::double - (o_orderkey % 8 + 1)) / 1.35::double', -1.2, 1.2), 4)} as delta,
 {_r('(o_orderkey % 256) * 0.299::double + (o_custkey % 256) * 0.587::double + 7 * 0.114::double', 3)} as grey, translate(rtrim(base64(secret::blob), '='), '+/', '-_') as cache_key, regexp_replace(o_orderpriority, '[^a-zA-Z0-9._-]', '_', 'g') as file_part,
 case when length(secret) > 12 then left(secret, 6) || '...' || right(secret, 6) else '[redacted]' end as masked, case when ver[1] <> 1 then ver[1] - 1 when ver[2] <> 5 then ver[2] - 5 else ver[3] end as newer,
 floor(share * 1920 + 0.5) + floor(192 * 0.1::double + 0.5) as rect_x, floor(floor(share / 2 * 1080 + 0.5) * 0.5::double + 0.5) as rect_h from v""",
    "korean_search": f"""with n as (select p_partkey, chr((44032 + p_partkey * 588 % 11172)::int) || ' ' || p_name || ' ' || chr((44032 + p_partkey * 29 % 11172)::int) as name from part), q(query) as (values {_values(QUERIES_OF_NAMES)}),
f as (select *, {_form('name')} as text, {_form('trim(query)')} as wanted from n, q), i as (select *, {_initials('text')} as initials from f)
 select query, p_partkey, name, initials, name || case when unicode(right(name, 1)) between 44032 and 55203 and (unicode(right(name, 1)) - 44032) % 28 > 0 then '은' else '는' end as subject from i where wanted = '' or contains(text, wanted) or contains(initials, wanted)""",
    "member_filter": _q(_BASE, _CANDIDATE, _PROFILE, select="""select variant, role from profile where role = 'ranged' and contains(lower(variant), 'brand#1')"""),
    "feedback_validity": _q(_VOTES, f"""made as (select *, ['', ' null ', 'None', 'undefined', ' a:b ', candidate_id, 'empty:x'][vote_id % 7 + 1] as c from vote),
cleaned as (select vote_id, list_filter(list_transform(list_append(string_split(team_key, '+'), c), lambda x: {_clean('x')}), lambda x: x <> '') as team, {_clean('c')} as candidate from made)""",
        select="select vote_id, array_to_string(list_sort(team), '+') as team, candidate, len(team) = 2 and candidate <> '' as valid from cleaned"),
    "ml_manifest": _q(_BASE, select="""select 1 as schema_version, count(*) as raw_teams, count(*) filter (u = 0 and d = 3) as exported, count(*) filter (u > 0) as unknown_character, count(*) filter (u = 0 and d <> 3) as invalid_size from
 (select team_key, count(*) filter (not mapped) as u, count(distinct variant) as d from every_player group by team_key)"""),
    "roster_normalize": """with r as (select c_nationkey, (c_custkey % 4)::int as player, count(*) as size, max(c_custkey) % 3 = 0 as chosen from customer where c_acctbal > 0 group by 1, 2)
 select c_nationkey, player, size, chosen from (select *, row_number() over (partition by c_nationkey order by chosen desc, player) as k from r) where k <= 3""",
    "name_override_join": """with b as (select coalesce(k.p_partkey, f.p_partkey) as code, coalesce(upper(f.p_name), k.p_name) as name from (select * from part where p_partkey % 3 <> 0) k full join (select * from part where p_partkey % 2 = 0) f on k.p_partkey = f.p_partkey),
a as (select regexp_replace(lower(p_name), '[&·.\\-_ ''’]', '', 'g') as plain, min(p_partkey) as first_code from part group by 1)
 select code, name, first_code, lower(regexp_replace(name, '\\s', '', 'g')) as squeezed from b left join a on a.plain = regexp_replace(lower(name), '[&·.\\-_ ''’]', '', 'g')""",
    "trait_name_from_order": """with p as (select p_partkey, ['Havoc', 'Chaos', 'Support', 'Other'][p_partkey % 4 + 1] as g, p_partkey % 130 % 100 as l, p_partkey % 11 = 0 as core from part),
c as (select *, case when l % 10 = 0 then null when core or l between 1 and 4 then 'core' when l between 11 and 14 then 'sub1' when l between 21 and 24 then 'sub2' end as category, l % 10 - 1 as i from p)
 select p_partkey, category, case when g <> 'Other' and category is not null and i between 0 and 3 then g || '/' || category || '/' || i end as name from c""",
    "tournament_payload": _q(_BASE, select="""select game_id, team_key, rank as placement, (rank = 1)::int as win, (rank <= 3)::int as top3, members, case when team_key % 3 <> 0 then 10 - rank else 0 end as rank_score, case when team_key % 3 <> 0 then (team_key % 7)::int else 0 end as kill_score
 from (select team_key, array_to_string(list_sort(list("character")), '+') as members from player join trio using (team_key) group by team_key) join team using (team_key)"""),
    "tier_breakdown": _q(_BASE, select="select bucket, count(*) as teams from team group by bucket"),
    "vote_upsert_daily": _q(_VOTES, select="select user_id, tier, team_key, candidate_id, strftime(ts, '%Y-%m-%d') as day, arg_max(value, ts)::int as value, max(ts) as ts from vote group by all"),
    "recovered_votes": _q(_VOTES, select="select tier, team_key, candidate_id, case when likes > dislikes then 1 else -1 end as value from summary where likes <> dislikes"),
    "feedback_union": _q(_VOTES, select="select case vote_id % 2 when 0 then 'remote' else 'local' end as source, tier, team_key, candidate_id, count(*) filter (value = 1) as likes, count(*) filter (value = -1) as dislikes from vote group by all"),
    "tag_sets": _q(_BASE, _CANDIDATE, _PROFILE, f"""t as (select variant, "character", list_filter([{_TAGS}], lambda x: x is not null) as tags from profile), m as (select "character", arg_min(tags, variant) as more from t group by 1)""",
        select=f"""select variant, array_to_string(tags, ' ') as tags, array_to_string(list_filter([{_REQUIRED}], lambda x: not list_contains(tags, x)), ' ') as lacking, array_to_string(list_concat(tags, list_filter(more, lambda x: not list_contains(tags, x))), ' ') as together from t join m using ("character")"""),
    "unmapped_code_order": "select code from (select distinct p_partkey::varchar as code from part where p_size >= 48) order by code::int limit 5 offset 5",
    # formatting is exact but for halves, which it rounds to even: those are odd eighths (two digits) or sixteenths (three)
    "fixed_digits": """with v as (select l_orderkey, l_linenumber, l_extendedprice * l_discount as x from lineitem),
f as (select l_orderkey, l_linenumber, case when x * 8 = floor(x * 8) and (x * 8)::bigint % 2 = 1 then floor(x * 100 + 0.5::double) / 100 else format('{:.2f}', x)::double end as discount,
 case when x = floor(x) and x::bigint % 2 = 1 then floor(x / 8 * 100 + 0.5::double) / 100 else format('{:.2f}', x / 8)::double end as eighth,
 -case when x / 7 * 16 = floor(x / 7 * 16) and (x / 7 * 16)::bigint % 2 = 1 then floor(x / 7 * 1000 + 0.5::double) / 1000 else format('{:.3f}', x / 7)::double end as seventh from v)
 select l_orderkey, l_linenumber, max(discount) as discount, max(eighth) as eighth, max(seventh) as seventh from f group by all""",
    "id_range_scan": "select o_orderkey, o_custkey from orders where o_orderkey >= 100",
    "html_metrics": rf"""with v as (select *, {', '.join(f'(page_id * {k + 2} % 5 + 1)::varchar as v{k}' for k in range(6))} from pages),
h as (select page_id, replace(replace(replace(replace(replace(replace(coalesce(html, ''), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)) || case when page_id % 6 <> 0 then {_LINE} else '<p>damage 3</p>' end as t from v),
p as (select page_id, t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g') as plain from h),
m as (select page_id, {', '.join(rf"coalesce(try_cast(regexp_extract(t, '{n}\s*[=:：]?\s*([1-5])', 1) as int), try_cast(regexp_extract(plain, '{n}\s*[=:：]?\s*([1-5])', 1) as int)) as {n}" for n in _METRIC_NAMES)} from p) select * from m where {' and '.join(f'{n} is not null' for n in _METRIC_NAMES)}""",
    "reason_labels": f"select doc_id, array_to_string(list_filter([{_LABELS}], lambda x: x is not null)[1:3], ' ') as labels from (select doc_id, coalesce(text, '') as t from documents)",
    "preset_names": """select case when k = 1 then name else name || ' ' || k end as name, variants from (select p_name as name, p_type as variants, row_number() over (partition by p_name order by min(p_partkey)) as k from part group by p_name, p_type)""",
    "source_scan": """with t as (select p_partkey, 'x c("' || p_partkey || '",  "' || p_name || '", 1) c("z' || p_size || '", "n")' as line from part)
 select p_partkey, unnest(regexp_extract_all(line, 'c\\("([^"]+)",\\s*"([^"]+)"', 1)) as id, unnest(regexp_extract_all(line, 'c\\("([^"]+)",\\s*"([^"]+)"', 2)) as name from t""",
    "team_reasons": _q(*_SMALL, _GRID, _layers("why", "(select * from grid where n = 2)", K.TEAM_REASONS), select="select sel, variant, union_reason, composition_reason from why"),
    "detected_team": f"""with e as (select vec_id, list_transform(embedding::double[], lambda x: least(255.0::double, abs(x) * 100)) as v, label from embeddings),
s as (select (vec_id // 20 % 4)::int as layout, vec_id as slot, v as q from e where vec_id % 20 = 0),
m as (select layout, slot, label, vec_id, v, q from e, s where vec_id <> slot),
px as (select layout, slot, label, vec_id, unnest(range(16)) as i, v, q from m),
d as (select layout, slot, label, vec_id, sum(abs(v[4*i+1] * (v[4*i+4] / 255) - q[4*i+1] * (q[4*i+4] / 255)) + abs(v[4*i+2] * (v[4*i+4] / 255) - q[4*i+2] * (q[4*i+4] / 255)) + abs(v[4*i+3] * (v[4*i+4] / 255) - q[4*i+3] * (q[4*i+4] / 255))) / (48 * 255.0::double) * 0.55::double
 + sum(abs((v[4*i+1] * 0.299::double + v[4*i+2] * 0.587::double + v[4*i+3] * 0.114::double) * (v[4*i+4] / 255) - (q[4*i+1] * 0.299::double + q[4*i+2] * 0.587::double + q[4*i+3] * 0.114::double) * (q[4*i+4] / 255))) / (16 * 255.0::double) * 0.45::double as x from px group by all),
c as (select layout, slot, label, vec_id, {_r('greatest(0.0::double, 1 - x)', 6)} as confidence from d),
b as (select * from (select *, row_number() over (partition by layout, slot order by confidence desc, vec_id) as k from c) where k = 1),
l as (select layout from b group by layout order by {_r('avg(confidence)', 6)} desc, layout limit 1)
 select layout, slot, label, confidence from (select *, row_number() over (partition by label order by slot) as kk from b where layout = (select layout from l) and confidence >= 0.5::double) where kk = 1""",
}
