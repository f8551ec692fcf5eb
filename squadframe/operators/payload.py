"""JSON payloads: discovery of what is in them, search for objects, and match teams out of raw rows of users."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import exprs as X
from ..sources.adapter import game_payloads, table
from ..sources.files import json_paths

# The names under which payloads give the same field, in the order in which they are tried.
SHAPES = ["userGames", "games", "gameDetails", "data"]
TEAM = ["teamNumber", "team_number", "teamId", "team_id", "team"]
CHARACTER = ["characterNum", "character_num", "characterCode", "character_code"]
WEAPON = ["bestWeapon", "best_weapon", "weapon", "weaponCode", "weapon_code", "weaponType", "weapon_type", "equipmentWeapon"]
USER = ["userId", "user_id", "uid"]
CODES = ["code", "characterCode", "characterNum", "id", "key"]
NAMES = ["name", "nameKr", "nameKo", "nameKor", "characterName", "korName"]
SCALARS = {
    "rank": (["gameRank", "game_rank"], "int"), "victory": (["victory"], "string"), "matching_mode": (["matchingMode", "matching_mode"], "int"),
    "matching_team_mode": (["matchingTeamMode", "matching_team_mode"], "int"), "season_id": (["seasonId", "season_id"], "int"),
}
TRAITS = {"core": ["traitFirstCore", "traitCore"], "first_sub": ["traitFirstSub", "traitSub1"], "second_sub": ["traitSecondSub", "traitSub2"], "tactical": ["tacticalSkillGroup", "tacticalSkill"], "tactical_level": ["tacticalSkillLevel"]}
STATS = {
    "kills": ["playerKill", "kills"], "assists": ["playerAssistant", "assists"], "team_kills": ["teamKill"], "damage": ["damageToPlayer", "totalDamageToPlayer"], "basic": ["damageToPlayer_basic"], "skill": ["damageToPlayer_skill"],
    "item_skill": ["damageToPlayer_itemSkill"], "direct": ["damageToPlayer_direct"], "unique_skill": ["damageToPlayer_uniqueSkill"], "damage_from": ["damageFromPlayer", "totalDamageFromPlayer"], "from_basic": ["damageFromPlayer_basic"],
    "from_skill": ["damageFromPlayer_skill"], "cc_count": ["ccCount", "crowdControlCount"], "cc_time": ["ccTimeToPlayer", "ccTime"], "heal": ["healAmount"], "absorb": ["protectAbsorb"], "vision": ["sightScore", "visionScore"],
}
#: Items of an array that the summary of a payload looks into.
LOOKED_AT = 3


def first_value(row: str, names: Iterable[str], kind: str = "string") -> Column:
    """The first field of a variant object among the names that is there and neither null nor an empty text; null where
    it can't be read as the kind asked for. Arrays and objects come as their JSON text."""
    found = F.coalesce(*[F.nullif(F.try_variant_get(row, f"$.{n}", "string"), F.lit("")) for n in names])
    return found.try_cast(kind)


class Number(str):
    """A number of a JSON text as it is written."""


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key is there twice")
    return out


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_READ = json.JSONDecoder(object_pairs_hook=_object, parse_int=Number, parse_float=Number, parse_constant=_no_number)


def read_json(text: str | None) -> Any:
    """A JSON text's value, None if it is none."""
    try:
        return _READ.raw_decode((text or "").lstrip(" \t\n\r"))[0]
    except (ValueError, RecursionError):
        return None


def json_text(value: Any) -> str:
    """The JSON of what read_json gives."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{json_text(x)}" for k, x in value.items()) + "}"
    return "[" + ",".join(map(json_text, value)) + "]" if isinstance(value, list) else json.dumps(value)


def names_in(value: dict[str, Any]) -> list[str]:
    """The names of an object's fields in the order of Spark's strings in variants (UTF-16)."""
    return sorted(value) if all(map(str.isascii, value)) else sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))


def said(value: Any, names: Iterable[str]) -> Any:
    """The first field among the names that is neither null nor an empty text, None if there is none."""
    if isinstance(value, dict):
        for n in names:
            x = value.get(n)
            if x is not None and (x != "" or not isinstance(x, str)):
                return x
    return None


def walk(value: Any, stop: Callable[[Any], bool] | None = None, items: int | None = None) -> Iterator[tuple[tuple[str, ...], tuple[int, ...], Any]]:
    """The arrays and objects of a value on the way down: parts (keys on the way, [] for an item), place (positions on
    the way) and the value itself. Fields come by name. Nodes where stop holds aren't looked into, nor are the items of an
    array after the first `items`."""
    nodes = [((), (), value)] if isinstance(value, (list, dict)) else []
    while nodes:
        parts, place, held = nodes.pop()
        yield parts, place, held
        if stop is not None and stop(held):
            continue
        inner = [("[]", x) for x in held[:items]] if isinstance(held, list) else [(k, held[k]) for k in names_in(held)]
        nodes += [((*parts, k), (*place, i), x) for i, (k, x) in reversed(list(enumerate(inner))) if isinstance(x, (list, dict))]


def looked_into(payloads: DataFrame, id_col: str, column: str, found: Callable[[Any], tuple], kinds: str) -> DataFrame:
    """id_col and what found gives for each payload's value (columns as in kinds), row by row where the payloads are."""
    payloads, out = payloads.select(id_col, column), StructType.fromDDL(kinds)
    names, types = out.names, to_arrow_schema(out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [found(read_json(x.as_py())) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x[k] for x in made], types.field(k).type) for k in range(len(names))]], [id_col, *names])

    return payloads.mapInArrow(each, StructType([payloads.schema[id_col], *out]))


def _arrays(value: Any, items: int | None = LOOKED_AT) -> list[dict[str, Any]]:
    """Every array with an item, on the way down, in the first `items` items of each (None: in all)."""
    return [
        {"path": plain(".".join(parts)) if parts else "$", "place": place, "row_count": len(x), "sample_keys": list(map(plain, names_in(x[0]))) if isinstance(x[0], dict) else []}
        for parts, place, x in walk(value, items=items) if isinstance(x, list) and x
    ]


def plain(text: str) -> str:
    """Text that UTF-8 can hold: half a pair of surrogates becomes a question mark."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def arrays_in(payloads: DataFrame, id_col: str, column: str, items: int | None = LOOKED_AT) -> DataFrame:
    """Every array with an item, in the first `items` items of each (None: in all): id_col, path (`$` for the payload
    itself), place, row_count, sample_keys (of the first item, if it is an object)."""
    found = looked_into(payloads, id_col, column, lambda value: (_arrays(value, items),), "found array<struct<path: string, place: array<int>, row_count: int, sample_keys: array<string>>>")
    return found.select(id_col, F.inline("found"))


def _paths(value: Any) -> list[dict[str, Any]]:
    """Per path the items of all its arrays and of the longest one, in every item of every array."""
    sizes: dict[tuple[str, ...], list[int]] = {}
    for parts, _, x in walk(value):
        if isinstance(x, list) and x:
            sizes.setdefault(parts, []).append(len(x))
    found: dict[str, tuple[int, int]] = {}
    for parts, some in sizes.items():
        path = plain(".".join(parts)) if parts else "$"
        items, longest = found.get(path, (0, 0))
        found[path] = items + sum(some), max(longest, *some)
    return [{"path": k, "items": items, "longest": longest} for k, (items, longest) in found.items()]


def _summary(value: Any) -> tuple:
    best = max(_arrays(value), key=lambda x: x["row_count"], default={"path": None, "row_count": 0, "sample_keys": []})
    return list(map(plain, names_in(value))) if isinstance(value, dict) else [], best["path"], best["row_count"], best["sample_keys"]


def payload_summary(payloads: DataFrame, id_col: str, column: str) -> DataFrame:
    """Per payload: its keys, and path, length and keys of its longest array (of equal ones the first on the way down)."""
    return looked_into(payloads, id_col, column, _summary, "payload_keys array<string>, path string, row_count int, sample_keys array<string>")


def _named(value: Any, codes: list[str], names: list[str]) -> list[tuple[tuple[int, ...], Any, Any, Any]]:
    """(place, code, name, object) of the outermost objects that have a code and a name, on the way down."""
    out, has = [], False
    for _, place, x in walk(value, lambda _: has):
        code = said(x, codes)
        name = None if code is None else said(x, names)
        if has := name is not None:
            out.append((place, code, name, x))
    return out


#: What _named gives, as JSON; how a value of it reads as text is the variant's own rule.
_NAMED = "array<struct<place: array<int>, code: string, name: string, value: string>>"


def as_text(value: str | Column) -> Column:
    return F.try_variant_get(F.try_parse_json(value), "$", "string")


def named_objects(payloads: DataFrame, id_col: str, column: str, codes: list[str] = CODES, names: list[str] = NAMES) -> DataFrame:
    """The outermost objects that have a code and a name: id_col, place, code, name, value."""
    def each(value: Any) -> tuple:
        return ([{"place": place, "code": json_text(code), "name": json_text(name), "value": json_text(x)} for place, code, name, x in _named(value, codes, names)],)

    found = looked_into(payloads, id_col, column, each, f"found {_NAMED}").select(id_col, F.inline("found"))
    return found.select(id_col, "place", as_text("code").alias("code"), as_text("name").alias("name"), F.try_parse_json("value").alias("value"))


def _user(value: Any) -> str | None:
    """The first user id as JSON; 0 and false are none."""
    for _, _, x in walk(value):
        own = said(x, USER)
        zero = isinstance(own, Number) and not own.strip("-0.")
        if own is not None and own is not False and not zero and own not in ("0", "false"):
            return json_text(own)
    return None


def user_ids(payloads: DataFrame, id_col: str, column: str) -> DataFrame:
    """Per payload the first user id (0 is none) on the way down: an object's own before those inside it, fields by name."""
    return looked_into(payloads, id_col, column, lambda value: (_user(value),), "user_id string").select(id_col, as_text("user_id").alias("user_id"))


def game_rows(payloads: DataFrame, game_col: str, column: str) -> DataFrame:
    """(game_col, at, row) of the payload's rows of users, under whichever of the names is there; at is the place."""
    spark = payloads.sparkSession
    # an explode of one value, so that it is parsed once: what is asked of it would be asked of the text, each time anew
    parsed = payloads.select(game_col, F.explode(F.array(F.try_parse_json(column))).alias("_payload"))
    # a null under one name leaves the next its turn, an empty array doesn't
    named = [F.try_variant_get("_payload", f"$.{n}", "variant") for n in SHAPES]
    held = F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in named])
    rows = parsed.select(game_col, F.explode(F.array(held)).alias("_rows"))
    each = rows.lateralJoin(spark.tvf.variant_explode(F.col("_rows").outer())).where("key is null and pos is not null")  # items of arrays
    return each.select(game_col, F.col("pos").alias("at"), F.col("value").alias("row"))


def assembled_teams(rows: DataFrame, game_col: str, least: int = 2) -> DataFrame:
    """Teams out of rows of users (game_col, at, row): game_col, team_key, the scalars of the team's first row, players.

    Rows without a team or a character are left out, as are teams of fewer than `least` players. Players stand in the
    order of their rows with weapon, traits (texts; JSON where they are arrays), own rank, and 17 numbers (0 where one is
    missing or no number). victory is true for anything but false, 0 and nothing.
    """
    truthy = F.coalesce(~F.lower(F.col("victory")).isin("false", "0", "0.0"), F.lit(False))
    player = F.struct(
        "at", "character", first_value("row", WEAPON).alias("weapon"), *[first_value("row", names).alias(c) for c, names in TRAITS.items()], "rank",
        *[F.coalesce(first_value("row", names, "double"), F.lit(0.0)).alias(c) for c, names in STATS.items()])
    known = rows.withColumns({"team_key": first_value("row", TEAM), "character": first_value("row", CHARACTER), **{c: first_value("row", names, kind) for c, (names, kind) in SCALARS.items()}})
    known = known.where("team_key is not null and character is not null").withColumn("victory", truthy).withColumn("player", player)
    teams = known.groupBy(game_col, "team_key").agg(F.min_by(F.struct(*SCALARS), "at").alias("first"), F.array_sort(F.collect_list("player")).alias("players"))  # a handful of players
    return teams.where(F.size("players") >= least).select(game_col, "team_key", "first.*", "players")


#: Marks texts that are JSON yet to be read; texts that begin with it are sent as JSON too.
_JSON = "\0"


def _whole(x: Any) -> bool:
    """Whether a value is a whole number that reads as it is written."""
    return isinstance(x, Number) and len(x) < 19 and (x.isdigit() or x[0] == "-" and x[1:].isdigit() and x != "-0")


def _sent(x: Any) -> str | None:
    """A value as its text where that is plain, else as marked JSON, whose text is the variant's own rule."""
    if x is None or _whole(x):
        return x
    if isinstance(x, list) and all(map(_whole, x)):
        return "[" + ",".join(x) + "]"
    if isinstance(x, str) and not isinstance(x, Number) and not x.startswith(_JSON):
        return plain(x)
    return _JSON + json_text(x)


def _users(value: Any) -> Iterator[tuple[int, dict[str, Any]]]:
    """(place, row) of a payload's rows of users that have a team and a character, as game_rows finds them."""
    held = next((value[n] for n in SHAPES if value.get(n) is not None), None) if isinstance(value, dict) else None
    for at, row in enumerate(held if isinstance(held, list) else ()):
        if isinstance(row, dict) and said(row, TEAM) is not None and said(row, CHARACTER) is not None:
            yield at, row


def teams_in(payloads: DataFrame, game_col: str, column: str, fields: Iterable[str] | None = None, least: int = 2) -> DataFrame:
    """What assembled_teams gives for game_rows, where a game has one payload: each payload is read once and grouped where
    it is, nothing is shuffled. fields are those of SCALARS, TRAITS and STATS that are read, all by default; rank and
    victory always are."""
    scalars, traits, stats = ([c for c in of if fields is None or c in fields or c in ("rank", "victory")] for of in (SCALARS, TRAITS, STATS))
    names = {"team_key": TEAM, "character": CHARACTER, "weapon": WEAPON} | {c: SCALARS[c][0] for c in scalars} | {c: TRAITS[c] for c in traits} | {c: STATS[c] for c in stats}
    out = StructType([payloads.schema[game_col], *StructType.fromDDL(f"users array<struct<at: int, {', '.join(f'{c}: string' for c in names)}>>")])
    wanted = list(names.values())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part, ends, places, found = batch.slice(start, 64), [0], [], []
                for x in part.column(1):
                    for at, row in _users(read_json(x.as_py())):
                        places.append(at)
                        found.append([_sent(said(row, n)) for n in wanted])
                    ends.append(len(places))
                columns = [pa.array([x[k] for x in found], pa.string()) for k in range(len(wanted))]
                users = pa.StructArray.from_arrays([pa.array(places, pa.int32()), *columns], ["at", *names])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), users)], [game_col, "users"])

    def read(u: Column) -> Column:
        text = {c: F.when(F.startswith(u[c], F.lit(_JSON)), as_text(F.substring(u[c], 2, 1 << 30))).otherwise(u[c]) for c in names}
        values = {**text, **{c: text[c].try_cast(SCALARS[c][1]) for c in scalars}, **{c: F.coalesce(text[c].try_cast("double"), F.lit(0.0)) for c in stats}}
        return F.struct(u["at"].alias("at"), *[x.alias(c) for c, x in values.items()])

    users = payloads.select(game_col, column).mapInArrow(each, out).select(game_col, F.transform("users", read).alias("users"))
    keyed = users.select(game_col, "users", F.explode(F.array_distinct(F.transform("users", lambda u: u["team_key"]))).alias("team_key"))
    own = keyed.select(game_col, "team_key", F.filter("users", lambda u: u["team_key"] == F.col("team_key")).alias("own")).where(F.size("own") >= least)
    first = lambda c: F.col("own")[0][c]
    truthy = F.coalesce(~F.lower(first("victory")).isin("false", "0", "0.0"), F.lit(False))
    players = F.transform("own", lambda u: F.struct(*[u[c].alias(c) for c in ("at", "character", "weapon", *traits, "rank", *stats)]))
    return own.select(game_col, "team_key", *[(truthy if c == "victory" else first(c)).alias(c) for c in scalars], players.alias("players"))


def team_results(teams: DataFrame) -> DataFrame:
    """Adds placement (null for ranks that are none), win (victory or first) and top3."""
    rank = F.col("rank")
    return teams.withColumns({"placement": F.when(rank > 0, rank), "win": F.col("victory") | F.coalesce(rank == 1, F.lit(False)), "top3": F.coalesce(rank.between(1, 3), F.lit(False))})


def json_schema_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_paths(table(spark, sf_dir, "events"), "props")


def payload_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in the payload of every game: its keys, its longest array, and that array's keys."""
    found = payload_summary(game_payloads(spark, sf_dir), "game_id", "payload")
    return found.select("game_id", F.array_join("payload_keys", ",").alias("payload_keys"), "path", "row_count", F.array_join("sample_keys", ",").alias("sample_keys"))


def payload_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arrays of the payloads by path: payloads that have it, items, and the longest one."""
    found = looked_into(game_payloads(spark, sf_dir), "game_id", "payload", lambda value: (_paths(value),), "found array<struct<path: string, items: long, longest: int>>").select("game_id", F.inline("found"))
    return found.groupBy("path").agg(F.count("game_id").alias("payloads"), F.sum("items").alias("items"), F.max("longest").alias("longest"))  # one payload a game


def payload_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a code and a name in every game's payload, and the first user id of the payload."""
    def both(value: Any) -> tuple:
        named = _named(value, CODES, NAMES)
        return _user(value), len(named), json_text(named[0][1]) if named else None, json_text(named[-1][2]) if named else None

    found = looked_into(game_payloads(spark, sf_dir), "game_id", "payload", both, "user_id string, objects long, first_code string, last_name string")
    return found.select("game_id", "objects", *[as_text(c).alias(c) for c in ("user_id", "first_code", "last_name")])


def raw_game_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams assembled from the raw rows of every game's payload, with their results and sums over the players."""
    teams = team_results(teams_in(game_payloads(spark, sf_dir), "game_id", "payload", ["matching_mode", "first_sub", "kills", "damage", "heal"]))
    listed = lambda c: F.array_join(F.transform("players", lambda p: F.coalesce(p[c].cast("string"), F.lit("-"))), ",")
    total = lambda c: X.round_half_up(F.aggregate("players", F.lit(0.0), lambda s, p: s + p[c]), 2)
    return teams.select(
        "game_id", "team_key", "placement", "win", "top3", "matching_mode", F.size("players").alias("n_players"), listed("character").alias("characters"), listed("weapon").alias("weapons"), listed("first_sub").alias("subs"),
        total("kills").alias("kills"), total("damage").alias("damage"), total("heal").alias("heal"))


def payload_coalesce_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count that goes by several names in the payload (empty ones are skipped), else the event's value; 0 without any."""
    aliases = [F.nullif(F.get_json_object("props", f"$.{x}"), F.lit("")).cast("double") for x in ("count", "games", "k")]
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(*aliases, F.col("value"), F.lit(0.0)).alias("amount"))
