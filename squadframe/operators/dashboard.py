"""Ranking lists: members by bucket, compositions from statistics, ranked users and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import rules as K
from ..sources.dimension import layered, profiles
from ..sources.files import written
from .ranker import ranker_candidate_stats, ranker_composition_stats
from .recommend import _MEANS, _base, character_votes, group_averages, selected_members, selections
from .stats import official_candidate_stats, official_composition_stats
from .votes import vote_summary

R = X.round_half_up
#: Games from which a member's own statistics rank it; members in a group of fewer than RANK_SUPPORT by the whole bucket.
RANK_GAMES, RANK_SUPPORT = 25, 6


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with statistics in a bucket, and the characters that only ranked users' games show there."""
    stats = written(official_candidate_stats(spark, sf_dir, RANK_GAMES), "stats")
    groups = layered(profiles(spark, sf_dir).select("variant", "character", "role"), {"rank_group": K.RANK_GROUP})
    averages = group_averages(stats, groups.select(F.col("variant").alias("stat_id"), "rank_group"), "rank_group", [*_MEANS, "avg_cc_time"], RANK_SUPPORT)
    of = F.split_part("stat_id", F.lit(":"), F.lit(1))
    rankers = written(ranker_candidate_stats(spark, sf_dir), "rankers")
    shown = stats.select("bucket", of.alias("candidate")).distinct()
    others = rankers.select("candidate").join(F.broadcast(stats.select("bucket").distinct())).join(shown, ["bucket", "candidate"], "left_anti")  # a handful of buckets
    ids = stats.select("bucket", "stat_id").union(others.select("bucket", "candidate")).distinct()
    own = rankers.select(F.col("candidate").alias("who"), F.col("games").alias("k_games"), F.col("avg_placement").alias("k_placement"), F.col("top3_rate").alias("k_top3"), F.col("win_rate").alias("k_win"))
    votes = character_votes(vote_summary(spark, sf_dir)).groupBy(F.col("candidate").alias("who")).agg(F.sum("likes").alias("likes"), F.sum("dislikes").alias("dislikes"))
    first = groups.groupBy("character").agg(F.min_by("rank_group", "variant").alias("group_of_first"))
    rows = (
        ids.withColumn("who", of).join(groups.select(F.col("variant").alias("stat_id"), "rank_group"), "stat_id", "left").join(first.withColumnRenamed("character", "who"), "who", "left")
        .join(stats, ["bucket", "stat_id"], "left").join(averages, ["bucket", "rank_group"], "left").join(own, "who", "left").join(votes, "who", "left")
        .withColumn("rank_group", F.coalesce("rank_group", "group_of_first"))
    )
    return layered(rows, K.RANKING, K.RANKED).withColumn("letter", F.expr(K.RANK_LETTER))


def character_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member's score and place in its bucket: its statistics (48 without any), ranked users' games, and votes."""
    rows = _ranked(spark, sf_dir).select("bucket", "stat_id", F.coalesce("games", "k_games", F.lit(0)).alias("games"), R(F.col("score"), 4).alias("score"), "letter")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "stat_id")))


def character_rank_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).groupBy("bucket", "letter").agg(F.count("*").alias("members"))


def _canonical(teammates: str, sep: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(F.split(teammates, sep), F.array("candidate")))), "+")


def combined_composition_ranking(spark: SparkSession, sf_dir: str, bucket: str = "platinum_diamond", n: int = 14) -> DataFrame:
    """The best compositions by statistics (of the bucket, then of all) and by votes in one list; what both have adds up."""
    rows = official_composition_stats(spark, sf_dir).where(F.col("bucket").isin(bucket, "all")).withColumn("src", (F.col("bucket") == "all").cast("int")).withColumn("team", _canonical("teammates", r"\|"))
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("games"), "src", "candidate", "teammates"))).where("k = 1")
    official = best.select("team", "games", F.expr(K.doubles(K.OFFICIAL_TEAM_SCORE)).alias("s")).orderBy(R(F.col("s"), 6).desc(), "team").limit(16)
    voted = character_votes(vote_summary(spark, sf_dir)).withColumn("team", F.array_join(F.array_sort(F.array_distinct(F.concat("team", F.array("candidate")))), "+"))
    voted = voted.groupBy("team").agg(F.sum("likes").alias("likes"), F.sum("dislikes").alias("dislikes")).where("likes > 0")
    voted = voted.orderBy(F.expr("likes - dislikes").desc(), F.desc("likes"), F.expr("likes + dislikes").desc(), "team").limit(14).select("team", "likes", "dislikes", F.expr(K.doubles(K.VOTED_TEAM_SCORE)).alias("v"))
    both = official.join(voted, "team", "full")
    source = F.when(F.col("s").isNotNull() & F.col("v").isNotNull(), "mixed").when(F.col("s").isNotNull(), "official").otherwise("feedback")
    score = R(F.coalesce("s", F.lit(0.0)) + F.coalesce("v", F.lit(0.0)), 4)
    return both.select("team", "games", "likes", "dislikes", source.alias("source"), score.alias("score")).orderBy(F.desc("score"), "team").limit(n)


def ranker_composition_ranking(spark: SparkSession, sf_dir: str, n: int = 16) -> DataFrame:
    """Ranked users' compositions, each by its perspective of most games, the best by score."""
    rows = ranker_composition_stats(spark, sf_dir).withColumn("team", _canonical("teammates", r"\+"))
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("games"), F.desc("top3_rate"), "teammates", "candidate"))).where("k = 1")
    return best.select("team", "games", R(F.expr(K.doubles(K.RANKER_TEAM_SCORE)), 4).alias("score")).orderBy(F.desc("score"), "team").limit(n)


def official_composition_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the compositions that hold selected characters, in the selection's bucket and in all; a row whose
    matched teammates are all of the selected counts most."""
    stats, _, rows = _base(spark, sf_dir)
    asked = written(selections(stats), "asked")
    picked = selected_members(asked, rows.select("variant", "character")).select("sel", "bucket", "character")
    size = picked.groupBy("sel").agg(F.count("*").alias("k"))
    comps = official_composition_stats(spark, sf_dir).withColumn("mate", F.explode(F.split("teammates", r"\|"))).withColumnRenamed("bucket", "of")
    met = comps.join(picked.select("sel", "bucket", F.col("character").alias("mate")).distinct(), "mate").where("of = bucket or of = 'all'")
    met = met.groupBy("sel", "of", "teammates", "candidate", "games", "avg_placement", "win_rate", "top3_rate").agg(F.count("*").alias("hits")).join(F.broadcast(size), "sel")  # the selections
    met = met.join(picked.select("sel", F.col("character").alias("candidate")), ["sel", "candidate"], "left_anti")
    weight = F.expr(K.doubles("hits * case when hits = k then 1.25 else 0.42 end * least(1.1, log2(games + 1.0) / 4)"))
    rows = met.select("sel", "candidate", weight.alias("w"), F.expr(K.doubles(K.RANKER_SCORE)).alias("s"))
    return rows.groupBy("sel", "candidate").agg(R(X.clamp(F.sum(F.col("s") * F.col("w")) / F.sum("w") * 1.25, -1.4, 1.5), 4).alias("score"))
