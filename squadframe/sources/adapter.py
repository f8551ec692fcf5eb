"""The canonical model (teams, players, votes) over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X


#: Measures of a player beyond the first ones, over the columns of lineitem.
MORE_MEASURES = {
    "item_skill": "l_extendedprice * l_discount * l_tax", "direct": "l_quantity * l_tax", "unique_skill": "l_quantity * l_discount", "damage_from": "l_extendedprice * (1 - l_discount)",
    "from_basic": "l_quantity * 100 * l_discount", "from_skill": "l_quantity * 100 * l_tax", "cc_count": "l_linenumber * 2", "assists": "cast(l_quantity as int) % 5", "team_kills": "l_linenumber + cast(l_quantity as int) % 5",
}

#: First measures of a player, in the same way.
MEASURES = {"kills": "l_linenumber", "damage": "l_extendedprice", "basic": "l_extendedprice * l_discount", "skill": "l_extendedprice * l_tax", "cc_time": "l_quantity"}
#: Columns of lineitem that all measures are made of.
PLAYED = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per match team."""
    mmr = F.col("o_totalprice") / 30
    return table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 8").alias("game_id"), F.col("o_orderkey").alias("team_key"), (F.col("o_orderkey") % 8 + 1).cast("int").alias("rank"),
        mmr.alias("mmr"), X.compact_tier(X.tier_from_mmr(mmr)).alias("bucket"), F.col("o_orderdate").alias("collected_at"), F.col("o_custkey").alias("user_id"))


def players(spark: SparkSession, sf_dir: str, mapped_only: bool = True) -> DataFrame:
    """One row per player of a team; codes outside the dimension (p_size of 48 or more) are unmapped."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("character"), F.concat_ws(":", "p_brand", "p_type").alias("variant"), F.col("p_type").alias("weapon"),
        (F.col("p_size") % 7).cast("string").alias("core"), (F.col("p_size") < 48).alias("mapped"))
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("team_key"), "l_partkey", F.col("l_returnflag").alias("tactical"), *[F.expr(e).alias(c) for c, e in (MEASURES | MORE_MEASURES).items()])
    out = line.join(part, line["l_partkey"] == part["p_partkey"]).drop("p_partkey", "l_partkey")
    return out.where("mapped").drop("mapped") if mapped_only else out


def held_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams with exactly three distinct members, by variant or by character (by_variant, by_character), and their mapped
    players in one array: what squads and member_rows make all measures of, so that a query of many tables shuffles the
    line items once. Players are held as the few columns that the measures are computed from, not as the many measures.
    """
    part = table(spark, sf_dir, "part").where("p_size < 48").select("p_partkey", F.col("p_brand").alias("character"), F.col("p_type").alias("weapon"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("team_key"), "l_partkey", *PLAYED)
    some = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy("team_key").agg(F.collect_list(F.struct("character", "weapon", *PLAYED)).alias("players"))
    three = lambda of: F.size(F.array_distinct(F.transform("players", of))) == 3
    some = some.select("team_key", "players", three(_variant).alias("by_variant"), three(lambda p: p["character"]).alias("by_character")).where("by_variant or by_character")
    return some.join(teams(spark, sf_dir).drop("mmr"), "team_key")


def _variant(p: Column) -> Column:
    return F.concat_ws(":", p["character"], p["weapon"])


def squads(spark: SparkSession, sf_dir: str, member: str = "variant", held: DataFrame | None = None) -> DataFrame:
    """Valid teams (exactly three distinct members) with their players in one array: one shuffle on the team key.

    A team has a handful of players, so the array is small. Out of held teams players have variant, character and kills only.
    """
    if held is not None:
        return held.where(f"by_{member}").withColumn("players", F.transform("players", lambda p: F.struct(_variant(p).alias("variant"), p["character"].alias("character"), p["l_linenumber"].alias("kills"))))
    cols = ["variant", "character", "weapon", "core", "kills", "damage", "basic", "skill", "cc_time", "tactical"]
    packed = players(spark, sf_dir).groupBy("team_key").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("players"))
    valid = packed.where(F.size(F.array_distinct(F.transform("players", lambda p: p[member]))) == 3)
    return valid.join(teams(spark, sf_dir), "team_key")


def game_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, payload): every game as the JSON of an answer, with the rows of its users under one of several names,
    fields under several names, some of them missing, and objects inside."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    rows = line.selectExpr(
        "l_orderkey div 8 as game_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "cast(l_orderkey % 8 as int) + 1 as team", "l_quantity", "l_tax", "l_returnflag", "l_extendedprice", "p_size",
        "l_partkey % 97 <> 0 as in_team", "l_orderkey div 8 % 3 as way")
    when = lambda condition, value: F.when(F.expr(condition), F.expr(value))
    row = F.struct(
        when("way = 0 and in_team", "team").alias("teamNumber"), when("not in_team", "''").alias("team_number"), when("way = 1 and in_team", "cast(team as string)").alias("team_id"), when("way = 2 and in_team", "team").alias("team"),
        when("l_partkey % 89 <> 0", "l_partkey % 88 + 1").alias("characterNum"), when("l_linenumber % 2 = 0", "p_size % 7").alias("bestWeapon"), when("l_linenumber % 2 = 1", "p_size % 5").alias("weaponType"),
        F.expr("team + l_linenumber - 1").alias("gameRank"), F.expr("l_returnflag = 'A'").alias("victory"), F.expr("l_linenumber * 10").alias("matchingMode"),
        when("l_linenumber % 2 = 1", "l_linenumber").alias("playerKill"), when("l_linenumber % 2 = 0 and l_quantity > 10", "l_linenumber").alias("kills"),
        when("l_tax < 0.04", "l_extendedprice").alias("damageToPlayer"), when("l_tax >= 0.04 and l_tax < 0.07", "l_extendedprice").alias("totalDamageToPlayer"), when("l_partkey % 10 = 0", "'much'").alias("healAmount"),
        when("l_partkey % 4 <> 1", "array(p_size % 3, p_size % 4)").alias("traitFirstSub"), when("l_suppkey % 4 = 0", "named_struct('userId', l_suppkey)").alias("profile"), F.expr("named_struct('code', l_partkey, 'name', p_name)").alias("item"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    games = rows.select("game_id", *order, row.alias("row")).groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct(*order, "row"))).alias("all"))  # eight teams
    users = F.to_json(F.transform("all", lambda x: x["row"]))
    held = F.expr("case game_id % 5 when 0 then '\"userGames\":' when 1 then '\"games\":' when 2 then '\"gameDetails\":' when 3 then '\"data\":' else '\"userGames\":null,\"games\":' end")
    about = F.expr("case when game_id % 2 = 0 then concat('\"meta\":{\"owner\":{\"uid\":', game_id, '},\"servers\":[[1,2],[3]]}') else '\"meta\":{\"servers\":[]}' end")
    return games.select("game_id", F.concat(F.lit('{"code":200,'), held, users, F.lit(","), about, F.lit("}")).alias("payload"))


def fanned(df: DataFrame) -> DataFrame:
    """Every row in bucket `all` and in its own."""
    return df.withColumn("bucket", F.explode(F.array(F.lit("all"), "bucket")))


def votes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Votes: clicks and purchases for, errors against a candidate; one row per event (of the table, or of a stream of it)."""
    return (
        (table(spark, sf_dir, "events") if events is None else events).where(F.col("event_type").isin("click", "purchase", "error"))
        .select(
            F.col("event_id").alias("vote_id"), "user_id", F.when(F.col("user_id") % 3 == 0, "all").when(F.col("user_id") % 3 == 1, "diamond").otherwise("mithril_plus").alias("tier"),
            F.concat_ws("+", F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")), F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string"))).alias("team_key"),
            F.concat(F.lit("x"), (F.get_json_object("props", "$.k").cast("int") % 8).cast("string")).alias("candidate_id"),
            F.when(F.col("event_type") == "error", -1).otherwise(1).alias("value"), F.col("ts"))
    )
