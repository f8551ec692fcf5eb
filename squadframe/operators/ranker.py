"""Statistics of ranked users' games, tier snapshots, and the reference teams of tournaments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.rules import SNAPSHOT_TIER, doubles
from ..sources.adapter import squads
from .stats import exact, official_candidate_stats, weighted_mean

R = X.round_half_up
#: Reference teams of the tournament scores: the most frequent ones.
REFERENCES = 121
#: Snapshot bucket of a stored bucket, and the buckets that repeat another one.
SNAPSHOTS = {"platinum_diamond": "diamond_plus", "iron_gold": "platinum_plus", "meteor_mithril": "mithril_plus"}
REPEATED = {"all": "diamond_plus", "bronze": "platinum_plus", "gold": "platinum_plus"}


def perspectives(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """One row for each user and game (the first team where a user has two): the user's own member is the one with the
    fewest kills (then the lower variant), the others are its teammates."""
    s = squads(spark, sf_dir, "character", held)
    own = F.array_min(F.transform("players", lambda p: F.struct(p["kills"].alias("k"), p["variant"].alias("v"), p["character"].alias("c"))))["c"]
    rows = s.select("user_id", "game_id", "team_key", "rank", own.alias("candidate"), F.array_sort(F.transform("players", lambda p: p["character"])).alias("m"))
    at = F.array_position("m", F.col("candidate")).cast("int")
    rows = rows.withColumn("teammates", F.array_join(F.concat(F.slice("m", F.lit(1), at - 1), F.slice("m", at + 1, F.size("m"))), "+"))
    return rows.groupBy("user_id", "game_id").agg(F.min_by(F.struct("rank", "candidate", "teammates"), "team_key").alias("x")).select("user_id", "game_id", "x.*")


def one_trick_ratios(rows: DataFrame) -> DataFrame:
    """The share of a user's games on the member it plays most."""
    picks = rows.groupBy("user_id", "candidate").agg(F.count("*").alias("n"))
    return picks.groupBy("user_id").agg((F.greatest(F.lit(0), F.max("n")) / F.sum("n")).alias("trick"))


def _summary(rows: DataFrame, *keys: str) -> DataFrame:
    games = F.count("*")
    return rows.groupBy(*keys).agg(
        games.alias("games"), R(F.avg("rank"), 2).alias("avg_placement"), R(F.count_if(F.col("rank") == 1) / games, 3).alias("win_rate"), R(F.count_if(F.col("rank") <= 3) / games, 3).alias("top3_rate"), R(F.sum(F.expr(exact("trick"))).cast("double") / games, 3).alias("one_trick"))


def with_trick(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """perspectives with each user's one-trick ratio."""
    rows = perspectives(spark, sf_dir, held)
    return rows.join(one_trick_ratios(rows), "user_id")


def ranker_candidate_stats(spark: SparkSession, sf_dir: str, min_games: int = 2, seen: DataFrame | None = None) -> DataFrame:
    """seen is the outcome of with_trick, if there is one already; so below."""
    return _summary(with_trick(spark, sf_dir) if seen is None else seen, "candidate").where(F.col("games") >= min_games)


def ranker_composition_stats(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> DataFrame:
    """By teammates and candidate, most games first, then the higher top-3 rate."""
    return _summary(with_trick(spark, sf_dir) if seen is None else seen, "teammates", "candidate").orderBy(F.desc("games"), F.desc("top3_rate"), "teammates", "candidate")


def snapshot(stats: DataFrame) -> DataFrame:
    """Characters by snapshot bucket: sums over their variants, and the letter of the variant with most games (then the
    lower one); some buckets repeat another."""
    rows = stats.withColumn("character", F.split_part("stat_id", F.lit(":"), F.lit(1))).withColumn("letter", F.expr(doubles(SNAPSHOT_TIER)))
    names = F.create_map(*[F.lit(x) for kv in SNAPSHOTS.items() for x in kv])
    rows = rows.withColumn("bucket", names[F.col("bucket")]).where("bucket is not null")
    mean = lambda c, digits: R(weighted_mean(c), digits)
    known = rows.groupBy("bucket", "character").agg(
        F.sum("games").alias("games"), mean("avg_placement", 2).alias("avg_placement"), mean("win_rate", 3).alias("win_rate"), mean("top3_rate", 3).alias("top3_rate"), F.min_by("letter", F.struct(-F.col("games"), "stat_id")).alias("tier_label"))
    targets = F.create_map(*[x for b in SNAPSHOTS.values() for x in (F.lit(b), F.array(F.lit(b), *[F.lit(k) for k, v in REPEATED.items() if v == b]))])
    return known.withColumn("bucket", F.explode(targets[F.col("bucket")]))


def tier_snapshot_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(official_candidate_stats(spark, sf_dir))


def tournament_references(spark: SparkSession, sf_dir: str, n: int = REFERENCES, held: DataFrame | None = None) -> DataFrame:
    """The n most frequent teams of two games or more: members, appearances, mean rank, total score (ts) and kills (ks)."""
    s = squads(spark, sf_dir, "character", held).select(F.array_sort(F.array_distinct(F.transform("players", lambda p: p["character"]))).alias("m"), "rank", F.aggregate("players", F.lit(0), lambda t, x: t + x["kills"]).alias("kills"))
    stats = s.groupBy(F.array_join("m", "+").alias("members")).agg(F.count("*").alias("appearances"), R(F.avg("rank"), 2).alias("rank"), R(F.avg("kills"), 2).alias("ks"), R(F.avg(F.col("kills") + 8 - F.col("rank")), 2).alias("ts"))
    return stats.where("appearances >= 2").orderBy(F.desc("appearances"), "members").limit(n)


def first_variants(members: DataFrame) -> DataFrame:
    """The first variant of every character."""
    return members.withColumn("nth", F.row_number().over(Window.partitionBy("character").orderBy("variant"))).where("nth = 1").drop("nth")
