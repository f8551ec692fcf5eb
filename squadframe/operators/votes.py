"""Votes: hourly upserts, summaries, audits and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.adapter import votes

KEY = ["user_id", "tier", "team_key", "candidate_id"]


def vote_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def upserted(rows: DataFrame) -> DataFrame:
    """One vote per user, tier, team, candidate and hour: the latest, at equal times the one with the higher id."""
    latest = F.max_by(F.struct("value", "ts"), F.struct("ts", "vote_id"))
    return rows.withColumn("bucket", vote_bucket(F.col("ts"))).groupBy(*KEY, "bucket").agg(latest.alias("v")).select(*KEY, "bucket", "v.value", "v.ts")


def summarised(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tier", "team_key", "candidate_id").agg(
        F.count_if(F.col("value") == 1).alias("likes"), F.count_if(F.col("value") == -1).alias("dislikes"), F.count("*").alias("total"), F.max("ts").alias("updated_at"))


def vote_upsert_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(votes(spark, sf_dir))


def vote_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(vote_upsert_hourly(spark, sf_dir))


def vote_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt, flagged if the hour already had one."""
    w = Window.partitionBy(*KEY, "bucket").orderBy("ts", "vote_id")
    return votes(spark, sf_dir).withColumn("bucket", vote_bucket(F.col("ts"))).select("vote_id", "bucket", (F.row_number().over(w) > 1).alias("was_duplicate"))


def vote_ttl_purge(spark: SparkSession, sf_dir: str, days: int = 10) -> DataFrame:
    """What is left `days` before the newest vote."""
    v = votes(spark, sf_dir)
    newest = v.agg(F.max("ts").alias("newest"))
    return v.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr(f"interval {days} days")).select("vote_id", "user_id", "value")


def vote_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return votes(spark, sf_dir).groupBy(w.alias("w"), "tier").agg(F.count("*").alias("votes"), F.sum("value").alias("balance")).select(F.date_format("w.start", "yyyy-MM-dd'T'HH").alias("bucket"), "tier", "votes", "balance")


def popular_feedback_overall(spark: SparkSession, sf_dir: str, n: int = 14) -> DataFrame:
    """Summaries on the canonical team, the best by score, likes and total."""
    s = vote_summary(spark, sf_dir)
    team = F.array_join(F.array_sort(F.array_distinct(F.concat(F.split("team_key", r"\+"), F.array("candidate_id")))), "|")
    g = s.groupBy(team.alias("team")).agg(F.sum("likes").alias("likes"), F.sum("dislikes").alias("dislikes"), F.sum("total").alias("total"))
    score = X.round_half_up(X.vote_score(F.col("likes"), F.col("dislikes")), 4)
    return g.withColumn("score", score).orderBy(F.desc("score"), F.desc("likes"), F.desc("total"), "team").limit(n)


def popular_feedback_recent(spark: SparkSession, sf_dir: str, n: int = 14) -> DataFrame:
    return vote_summary(spark, sf_dir).orderBy(F.desc("updated_at"), "tier", "team_key", "candidate_id").limit(n).select("tier", "team_key", "candidate_id", "likes", "dislikes")


def character_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = vote_summary(spark, sf_dir).groupBy("candidate_id").agg(F.sum("likes").alias("likes"), F.sum("dislikes").alias("dislikes"))
    return g.withColumn("bonus", X.round_half_up(X.vote_bonus(F.col("likes"), F.col("dislikes")), 4))


def relationship_score(spark: SparkSession, sf_dir: str, tier: str = "diamond") -> DataFrame:
    """Weighted sentiment of the votes whose team holds the candidate and a selected member (c1, d1)."""
    s = vote_summary(spark, sf_dir).where(F.col("tier").isin(tier, "all"))
    team = F.array_distinct(F.concat(F.split("team_key", r"\+"), F.array("candidate_id")))
    hits = F.size(F.array_intersect(team, F.array(F.lit("c1"), F.lit("d1"))))
    n = F.col("likes") + F.col("dislikes")
    weight = hits * F.when(hits == 2, 1.35).otherwise(0.58) * F.least(F.lit(1.4), F.log2(n + 1.0) / 3) * F.when(F.col("tier") == tier, 1.15).otherwise(0.75) * 1.05
    rows = s.where((hits > 0) & (n > 0)).select("candidate_id", weight.alias("w"), X.vote_sentiment(F.col("likes"), F.col("dislikes")).alias("s"))
    return rows.groupBy("candidate_id").agg(X.round_half_up(X.clamp(F.sum(F.col("w") * F.col("s")) / F.sum("w") * 3.4, -2.2, 2.2), 4).alias("score"))


def feedback_score(spark: SparkSession, sf_dir: str, tier: str = "diamond") -> DataFrame:
    """Score of each candidate for each team in a tier: the tier's own votes, those of `all`, and the candidate's in general.

    One pass over the summaries, by team; the candidate's totals weigh votes of `all` less.
    """
    s = vote_summary(spark, sf_dir).where(F.col("tier").isin(tier, "all"))
    own = lambda c, at: F.sum(F.when(F.col("tier") == at, F.col(c)).otherwise(0))
    by_team = s.groupBy("team_key", "candidate_id").agg(*[own(c, at).alias(f"{c}_{k}") for c in ("likes", "dislikes") for k, at in (("tier", tier), ("all", "all"))])
    weight = F.when(F.col("tier") == tier, 1.0).otherwise(0.65)
    general = s.groupBy("candidate_id").agg(*[F.sum(F.col(c) * weight).alias(c) for c in ("likes", "dislikes")])
    score = lambda k: X.vote_score(F.col(f"likes{k}"), F.col(f"dislikes{k}"))
    total = score("_tier") + score("") * 0.35 if tier == "all" else score("_tier") * 0.75 + score("_all") * 0.25 + score("") * 0.35
    return by_team.join(general, "candidate_id").select("team_key", "candidate_id", X.round_half_up(total, 4).alias("score"))
