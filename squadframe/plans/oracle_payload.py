"""DuckDB SQL of the payload queries: what the payloads were made of, straight from the tables."""

from __future__ import annotations

from .oracle import _q, _r

_USERS = """users as (select l_orderkey // 8 as game_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, p_size, (l_orderkey % 8)::int + 1 as team, l_quantity, l_tax, l_returnflag, l_extendedprice,
 row_number() over (partition by l_orderkey // 8 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as spot, count(*) over (partition by l_orderkey // 8) as users_of
 from lineitem join part on l_partkey = p_partkey),
game as (select game_id, max(users_of) as n, case game_id % 5 when 1 then 'games' when 2 then 'gameDetails' when 3 then 'data' when 4 then 'games' else 'userGames' end as shape from users group by game_id)"""
_ROW_KEYS = """list_sort(list_filter([
 case when l_partkey % 97 <> 0 then ['teamNumber', 'team_id', 'team'][l_orderkey // 8 % 3 + 1] else 'team_number' end, case when l_partkey % 89 <> 0 then 'characterNum' end, case when l_linenumber % 2 = 0 then 'bestWeapon' else 'weaponType' end,
 'gameRank', 'victory', 'matchingMode', case when l_linenumber % 2 = 1 then 'playerKill' when l_quantity > 10 then 'kills' end, case when l_tax < 0.04::double then 'damageToPlayer' when l_tax < 0.07::double then 'totalDamageToPlayer' end,
 case when l_partkey % 10 = 0 then 'healAmount' end, case when l_partkey % 4 <> 1 then 'traitFirstSub' end, case when l_suppkey % 4 = 0 then 'profile' end, 'item'], lambda x: x is not null))"""

PAYLOAD_SQL = {
    # the array of users has an item for each; the servers' arrays have two items at most and come first only by name
    "payload_discovery": _q(_USERS, f"""firsts as (select game_id, array_to_string({_ROW_KEYS}, ',') as row_keys, l_partkey % 4 <> 1 as sub from users where spot = 0),
said as (select g.game_id, n, shape, row_keys, sub, case g.game_id % 5 when 4 then 'code,games,meta,userGames' when 0 then 'code,meta,userGames' when 3 then 'code,data,meta' when 2 then 'code,gameDetails,meta' else 'code,games,meta' end as payload_keys from game g join firsts using (game_id))""",
        select="""select game_id, payload_keys, case when n < 2 and sub and shape < 'meta' then shape || '.[].traitFirstSub' when n < 2 and game_id % 2 = 0 then 'meta.servers' when n < 2 and sub then shape || '.[].traitFirstSub' when n = 2 and game_id % 2 = 0 and shape > 'meta' then 'meta.servers' else shape end as path,
 case when n < 2 and (sub or game_id % 2 = 0) then 2 else n end::int as row_count,
 case when n < 2 and (sub or game_id % 2 = 0) or n = 2 and game_id % 2 = 0 and shape > 'meta' then '' else row_keys end as sample_keys from said"""),
    "payload_arrays": _q(_USERS, """listed as (select shape as path, game_id, n as items from game
 union all select shape || '.[].traitFirstSub', game_id, 2 from users join game using (game_id) where l_partkey % 4 <> 1
 union all select 'meta.servers', game_id, 2 from game where game_id % 2 = 0 union all select 'meta.servers.[]', game_id, unnest([2, 1]) from game where game_id % 2 = 0)""",
        select="select path, count(distinct game_id) as payloads, sum(items)::bigint as items, max(items)::int as longest from listed group by path"),
    "payload_objects": _q(_USERS, """inside as (select game_id, min_by(l_suppkey, spot) filter (l_suppkey % 4 = 0 and l_suppkey <> 0) as supp, count(*) as objects, min_by(l_partkey, spot) as first_code, max_by(p_name, spot) as last_name from users group by game_id)""",
        select="""select game_id, case when game_id % 2 = 0 and game_id <> 0 and (shape > 'meta' or supp is null) then game_id::varchar else supp::varchar end as user_id, objects, first_code::varchar as first_code, last_name from inside join game using (game_id)"""),
    "raw_game_teams": _q(_USERS, """kept as (select * from users where l_partkey % 97 <> 0 and l_partkey % 89 <> 0)""",
        select=f"""select game_id, team::varchar as team_key, min_by(team + l_linenumber - 1, spot)::int as placement, min_by(l_returnflag = 'A', spot) or min_by(team + l_linenumber - 1, spot) = 1 as win, min_by(team + l_linenumber - 1, spot) <= 3 as top3,
 min_by(l_linenumber * 10, spot)::int as matching_mode, count(*)::int as n_players, string_agg((l_partkey % 88 + 1)::varchar, ',' order by spot) as characters, string_agg((case when l_linenumber % 2 = 0 then p_size % 7 else p_size % 5 end)::varchar, ',' order by spot) as weapons,
 string_agg(case when l_partkey % 4 <> 1 then '[' || p_size % 3 || ',' || p_size % 4 || ']' else '-' end, ',' order by spot) as subs, sum(case when l_linenumber % 2 = 1 or l_quantity > 10 then l_linenumber else 0 end)::double as kills,
 {_r('sum(case when l_tax < 0.07::double then l_extendedprice else 0 end)', 2)} as damage, 0.0::double as heal from kept group by game_id, team having count(*) >= 2"""),
}
