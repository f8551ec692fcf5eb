"""Statistics tables by tier bucket: members, traits, compositions, pairs, combat, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.adapter import MEASURES, MORE_MEASURES, fanned, players, squads, table, teams
from ..sources.dimension import KEYS, WEAPONS, layered

R = X.round_half_up


#: Weights fall to 1e-21 in seven years, so they and what they weigh keep many digits.
WEIGHT = "decimal(38, 24)"


def exact(e: str) -> str:
    """The value with six digits as a decimal: sums of it don't depend on the order of the rows, those of doubles do."""
    return f"cast({e} as decimal(18, 6))"


def weighted_mean(c: str, weight: str = "games") -> Column:
    """Mean of c by weight, over exact sums."""
    return F.sum(F.expr(exact(f"{c} * {weight}"))).cast("double") / F.sum(weight)


#: Sums behind the statistics of a member, over the columns of member_rows.
SUMS = {
    "games": "1", "placement": "case when rank > 0 then rank end", "placed": "case when rank > 0 then 1 else 0 end", "wins": "case when rank = 1 then 1 else 0 end", "top3": "case when rank between 1 and 3 then 1 else 0 end",
    **{c: exact(c) for c in ("damage", "basic", "skill", "item_skill", "direct", "unique_skill", "damage_from", "from_basic", "from_skill", "cc_time", "cc_count")},
}


def rolled_up(rows: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Sums by bucket and keys, and by keys in the bucket `all`: the rows are summed once, the few sums a second time."""
    own = rows.groupBy("bucket", *keys).agg(*[F.sum(F.expr(e)).alias(c) for c, e in sums.items()])
    return fanned(own).groupBy("bucket", *keys).agg(*[F.sum(c).alias(c) for c in sums])


def finalized(sums: DataFrame, keys: list[str], min_games: int) -> DataFrame:
    """Averages, rates and shares of the sums, from min_games on."""
    games = F.col("games")
    total = lambda c: F.col(c).cast("double")
    mean = lambda c, digits=0: R(total(c) / games, digits)
    return sums.where(games >= min_games).select(
        "bucket", *keys, "games", R(X.ratio(F.col("placement"), F.col("placed")), 2).alias("avg_placement"), mean("wins", 3).alias("win_rate"), mean("top3", 3).alias("top3_rate"),
        *[mean(c).alias(f"avg_{c}") for c in ("damage", "basic", "skill", "item_skill", "direct", "unique_skill", "damage_from", "from_basic", "from_skill")],
        *[R(X.ratio(total(c), total("damage")), 3).alias(f"{c}_share") for c in ("basic", "skill", "item_skill")], mean("cc_time", 2).alias("avg_cc_time"), mean("cc_count", 2).alias("avg_cc_count"))


def member_rows(spark: SparkSession, sf_dir: str, member: str = "variant", held: DataFrame | None = None) -> DataFrame:
    """The players of valid teams (exactly three distinct members): one shuffle on the team key, only the columns asked for.
    Out of held teams (held_teams) they need none, but have no core and no tactical skill."""
    if held is not None:
        each = held.where(f"by_{member}").select("team_key", "rank", "bucket", "collected_at", F.inline("players"))
        return each.select("team_key", "rank", "bucket", "collected_at", "character", "weapon", F.concat_ws(":", "character", "weapon").alias("variant"), *[F.expr(e).alias(c) for c, e in (MEASURES | MORE_MEASURES).items()])
    here = Window.partitionBy("team_key")
    some = players(spark, sf_dir).withColumn("distinct_members", F.size(F.collect_set(member).over(here))).where("distinct_members = 3").drop("distinct_members")
    return some.join(teams(spark, sf_dir).select("team_key", "rank", "bucket", "collected_at"), "team_key")


def official_candidate_stats(spark: SparkSession, sf_dir: str, min_games: int = 5, held: DataFrame | None = None) -> DataFrame:
    rows = member_rows(spark, sf_dir, held=held).withColumnRenamed("variant", "stat_id")
    return finalized(rolled_up(rows, ["stat_id"], SUMS), ["stat_id"], min_games)


def official_trait_build(spark: SparkSession, sf_dir: str, min_games: int = 5, n: int = 5) -> DataFrame:
    """Statistics by member and core, with the n most frequent tactical skills (equal counts: lower code) in code order."""
    rows = member_rows(spark, sf_dir).withColumnRenamed("variant", "stat_id")
    keys = ["stat_id", "core"]
    counts = rolled_up(rows, [*keys, "tactical"], {"uses": "1"})
    w = Window.partitionBy("bucket", *keys).orderBy(F.desc("uses"), "tactical")
    best = counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).groupBy("bucket", *keys).agg(F.array_sort(F.collect_list(F.concat_ws("=", "tactical", F.col("uses").cast("string")))).alias("t"))
    return finalized(rolled_up(rows, keys, SUMS), keys, min_games).join(best.select("bucket", *keys, F.array_join("t", ",").alias("tactical_skills")), ["bucket", *keys], "left")


def official_trait_top5(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """The n most frequent cores of a member: by count, then code."""
    counts = rolled_up(member_rows(spark, sf_dir).withColumnRenamed("variant", "stat_id"), ["stat_id", "core"], {"uses": "1"})
    w = Window.partitionBy("bucket", "stat_id").orderBy(F.desc("uses"), "core")
    return counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def official_composition_stats(spark: SparkSession, sf_dir: str, min_games: int = 2) -> DataFrame:
    """From each member's perspective: its sorted teammates, without itself."""
    squad = squads(spark, sf_dir, "character").withColumn("members", F.transform("players", lambda p: p["character"]))
    rows = squad.select("bucket", "rank", "members", F.explode("members").alias("candidate"))
    rows = rows.withColumn("teammates", F.array_join(F.array_sort(F.filter("members", lambda m: m != F.col("candidate"))), "|"))
    sums = rolled_up(rows, ["teammates", "candidate"], {"games": "1", "placement": "rank", "wins": "case when rank = 1 then 1 else 0 end", "top3": "case when rank <= 3 then 1 else 0 end"})
    mean = lambda c, digits: R(F.col(c) / F.col("games"), digits)
    return sums.where(F.col("games") >= min_games).select("bucket", "teammates", "candidate", "games", mean("placement", 2).alias("avg_placement"), mean("wins", 3).alias("win_rate"), mean("top3", 3).alias("top3_rate"))


def _weighted(df: DataFrame) -> DataFrame:
    """Weight by age against a fixed date, not the clock; a decimal, so that sums are exact."""
    return df.withColumn("w", X.recency_weight(F.col("collected_at"), F.lit("1998-12-01").cast("timestamp_ntz")).cast(WEIGHT))


def pair_statistics(teams_of: DataFrame, min_games: float = 0.0) -> DataFrame:
    """(bucket, a, b) with games and rates out of (bucket, rank, w, m): unordered pairs of a team's members by position,
    so a repeated member makes a pair with itself; no self-join."""
    pairs = teams_of.select("bucket", "rank", "w", F.explode(F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))).alias("p"))
    out = rolled_up(pairs.select("bucket", "rank", "w", "p.a", "p.b"), ["a", "b"], {"g": "w", "wins": "case when rank = 1 then w else 0 end", "t3": "case when rank <= 3 then w else 0 end"})
    g, wins, t3 = [F.col(c).cast("double") for c in ("g", "wins", "t3")]
    return out.where(g > min_games).select("bucket", "a", "b", R(g, 2).alias("games"), R(wins / g, 3).alias("win_rate"), R(t3 / g, 3).alias("top3_rate"))


def official_pair_stats(spark: SparkSession, sf_dir: str, min_games: float = 0.0, weighted: bool = False, held: DataFrame | None = None) -> DataFrame:
    squad = squads(spark, sf_dir, held=held)
    squad = _weighted(squad) if weighted else squad.withColumn("w", F.lit(1).cast(WEIGHT))
    return pair_statistics(squad.select("bucket", "rank", "w", F.transform("players", lambda p: p["variant"]).alias("m")), min_games)


def recency_weighted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return official_pair_stats(spark, sf_dir, 0.0, weighted=True)


def official_combat_stats(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    rows = _weighted(member_rows(spark, sf_dir, held=held)).withColumnRenamed("variant", "stat_id")
    measures = ("kills", "assists", "team_kills", "damage", "cc_time")
    sums = rolled_up(rows, ["stat_id"], {"w": "w", **{c: f"cast(cast(w as double) * {c} as {WEIGHT})" for c in measures}})
    digits, w = {"damage": 0}, F.col("w").cast("double")
    return sums.select("bucket", "stat_id", R(w, 2).alias("games"), *[R(F.col(c).cast("double") / w, digits.get(c, 2)).alias(f"avg_{c}") for c in measures])


def drop_reason_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: teams, how many are valid, and the overlapping reasons for the others."""
    per = players(spark, sf_dir, mapped_only=False).groupBy("team_key").agg(
        F.count_if(~F.col("mapped")).alias("unknown"), F.count_distinct(F.when(F.col("mapped"), F.col("variant"))).alias("distinct_members"))
    return per.agg(
        F.count("*").alias("total"), F.count_if(F.col("distinct_members") == 3).alias("valid"), F.count_if(F.col("distinct_members") != 3).alias("invalid_size"), F.count_if(F.col("unknown") > 0).alias("unknown_member"))


def unmapped_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").where("p_size >= 48"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_partkey").alias("code")).agg(F.count("*").alias("misses"))


def team_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping inputs; of a team in both the first input's row stays."""
    base = teams(spark, sf_dir).select("game_id", "team_key", "rank")
    both = base.where("team_key % 3 <> 0").withColumn("src", F.lit(0)).unionByName(base.where("team_key % 3 <> 1").withColumn("rank", -F.col("rank")).withColumn("src", F.lit(1)))
    return both.groupBy("game_id", "team_key").agg(F.min_by("rank", "src").alias("rank"), F.min("src").alias("src"))


def weapon_majority_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weapon seen most with a code; equal counts go to the lower name."""
    counts = players(spark, sf_dir).groupBy(F.col("core").alias("code"), "weapon").agg(F.count("*").alias("n"))
    w = Window.partitionBy("code").orderBy(F.desc("n"), "weapon")
    return counts.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def stat_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character with one variant resolves to it, else the variant by weapon."""
    part = table(spark, sf_dir, "part")
    variants = part.select(F.col("p_brand").alias("character"), F.concat_ws(":", "p_brand", "p_type").alias("variant")).distinct()
    single = variants.groupBy("character").agg(F.count("*").alias("n"), F.min("variant").alias("only"))
    return variants.join(single, "character").select("character", "variant", F.when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("variant", "character")).alias("stat_id"))


def tournament_compositions(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """Sorted squads with two games or more; the best twenty by win rate, games and name."""
    squad = squads(spark, sf_dir, "character").withColumn("members", F.array_join(F.array_sort(F.array_distinct(F.transform("players", lambda p: p["character"]))), "+"))
    stats = squad.groupBy("members").agg(F.count("*").alias("games"), F.sum((F.col("rank") == 1).cast("long")).alias("wins"), F.sum((F.col("rank") <= 3).cast("long")).alias("top3"), R(F.avg("rank"), 2).alias("avg_placement"))
    return stats.where("games >= 2").withColumn("win_rate", R(F.col("wins") / F.col("games"), 3)).orderBy(F.desc("win_rate"), F.desc("games"), "members").limit(n)


def ml_team_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature row per valid team."""
    p = "players"
    total = lambda c: F.aggregate(p, F.lit(0).cast("decimal(38, 6)"), lambda s, x: (s + x[c].cast("decimal(18, 6)")).cast("decimal(38, 6)")).cast("double")
    return squads(spark, sf_dir).select(
        "team_key", "bucket", "rank", F.size(p).alias("n_players"), F.size(F.array_distinct(F.transform(p, lambda x: x["weapon"]))).alias("n_weapons"), F.size(F.array_distinct(F.transform(p, lambda x: x["character"]))).alias("n_characters"),
        R(total("damage"), 2).alias("damage"), R(total("cc_time"), 2).alias("cc_time"), F.aggregate(p, F.lit(0), lambda s, x: s + x["kills"]).alias("kills"))


def global_win_rate(stats: DataFrame) -> DataFrame:
    """Games-weighted mean win rate of each bucket."""
    return stats.groupBy("bucket").agg(weighted_mean("win_rate").alias("mean_rate"))


def character_power(stats: DataFrame, alpha: float = 100.0) -> DataFrame:
    """Adjusted win rate of every member against the bucket's mean."""
    both = stats.join(F.broadcast(global_win_rate(stats)), "bucket")  # five buckets
    adjusted = X.bayesian_rate(F.col("win_rate") * F.col("games"), F.col("games"), alpha, F.col("mean_rate"))
    sure = F.least(F.lit(1.0), F.log10(F.col("games") + 1) / 2.5)
    return both.select("bucket", "stat_id", X.clamp((adjusted - F.col("mean_rate")) * 4 * sure, -1.0, 1.2).alias("power"))


def bayes_character_power(spark: SparkSession, sf_dir: str, alpha: float = 100.0) -> DataFrame:
    return character_power(official_candidate_stats(spark, sf_dir), alpha).select("bucket", "stat_id", R(F.col("power"), 4).alias("power"))


def pair_synergy(pairs: DataFrame, stats: DataFrame, alpha: float = 80.0) -> DataFrame:
    """By how much a pair's adjusted win rate is above the mean of its members'; members without statistics count as the bucket's mean."""
    means = F.broadcast(global_win_rate(stats))  # five buckets
    rated = stats.join(means, "bucket").select("bucket", "stat_id", X.bayesian_rate(F.col("win_rate") * F.col("games"), F.col("games"), alpha, F.col("mean_rate")).alias("rate"))
    both = pairs.join(means, "bucket", "left").withColumn("mean_rate", F.coalesce("mean_rate", F.lit(0.5)))
    for side in ("a", "b"):
        both = both.join(rated.select("bucket", F.col("stat_id").alias(side), F.col("rate").alias(f"rate_{side}")), ["bucket", side], "left")
    expected = (F.coalesce("rate_a", "mean_rate") + F.coalesce("rate_b", "mean_rate")) * 0.5
    return both.select("bucket", "a", "b", "games", (X.bayesian_rate(F.col("games") * F.col("win_rate"), F.col("games"), alpha, expected) - expected).alias("above"))


def bayes_pair_synergy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synergy of every pair, as the score of one member for a team of the other."""
    found = pair_synergy(official_pair_stats(spark, sf_dir), official_candidate_stats(spark, sf_dir))
    return found.select("bucket", "a", "b", "games", R(X.clamp(F.col("above") * 5, -1.0, 1.2), 4).alias("synergy"))


def official_v2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power, pair synergy and combat signal in one score, for every bucket's two most played members as the team.

    A candidate's synergy is the mean over both teammates, 0 where a pair was never played; so is a missing signal.
    """
    stats = official_candidate_stats(spark, sf_dir)
    best = stats.groupBy("bucket").agg(F.min(F.struct(-F.col("games"), F.col("stat_id"))).alias("one"))
    second = stats.join(best, "bucket").where(F.col("stat_id") != F.col("one.stat_id")).groupBy("bucket").agg(F.min(F.struct(-F.col("games"), F.col("stat_id"))).alias("two"))
    team = F.broadcast(best.join(second, "bucket").select("bucket", F.col("one.stat_id").alias("first"), F.col("two.stat_id").alias("second")))  # five buckets
    pairs = pair_synergy(official_pair_stats(spark, sf_dir), stats).join(team, "bucket")
    held = lambda c: F.col(c).isin(F.col("first"), F.col("second"))
    synergy = (
        pairs.select("bucket", "above", F.when(held("a") & ~held("b"), F.col("b")).when(held("b") & ~held("a"), F.col("a")).alias("stat_id"))
        .where("stat_id is not null").groupBy("bucket", "stat_id").agg((F.sum("above") / 2).alias("above"))
    )
    signal = combat_signals(official_combat_stats(spark, sf_dir))
    rows = character_power(stats).join(team, "bucket").where(~held("stat_id")).join(synergy, ["bucket", "stat_id"], "left").join(signal, ["bucket", "stat_id"], "left")
    synergy_score = X.clamp(F.coalesce("above", F.lit(0.0)) * 5, -1.0, 1.2)
    raw = F.col("power") * 0.30 + synergy_score * 0.35 + F.coalesce("signal", F.lit(0.0)) * 0.15
    return rows.select("bucket", "stat_id", "first", "second", R(X.clamp(raw, -1.5, 1.8), 4).alias("score"))


def tournament_result_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result score of every team: its rank, its kills, and kills with a point for each team behind it as the total."""
    s = squads(spark, sf_dir, "character").select("team_key", "rank", F.aggregate("players", F.lit(0), lambda t, x: t + x["kills"]).alias("kills"))
    return s.select("team_key", R(X.tournament_result(F.col("rank"), F.col("kills") + 8 - F.col("rank"), F.col("kills")), 4).alias("score"))


def official_candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = official_candidate_stats(spark, sf_dir)
    sure = F.least(F.lit(1.0), F.log10(F.col("games") + 1) / 2.2)
    signal = F.when(F.col("avg_damage") != 0, X.clamp((F.col("avg_damage") - 18000) / 22000, -0.35, 0.45)).otherwise(F.lit(0.0))
    raw = (X.placement_score(F.col("avg_placement"), F.col("top3_rate"), F.col("win_rate")) * 0.75 + signal * 0.35) * sure
    return s.select("bucket", "stat_id", R(X.clamp(raw, -0.95, 1.05), 4).alias("score"))


def combat_signals(c: DataFrame) -> DataFrame:
    damage = X.clamp((F.col("avg_damage") - 15000) / 20000, -0.5, 0.6)
    taken = F.col("avg_kills") + F.col("avg_assists") * 0.5 + F.col("avg_team_kills") * 0.3
    raw = X.clamp(taken / 6, -0.5, 0.7) + damage * 0.4
    return c.select("bucket", "stat_id", X.clamp(raw * F.least(F.lit(1.0), F.log10(F.col("games") + 1) / 2.5), -0.8, 1.0).alias("signal"))


def combat_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combat_signals(official_combat_stats(spark, sf_dir)).select("bucket", "stat_id", R(F.col("signal"), 4).alias("signal"))


def composition_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a composition's perspectives the one with most games (then the lower candidate), scored and ranked by bucket."""
    c = official_composition_stats(spark, sf_dir)
    key = F.array_join(F.array_sort(F.array_distinct(F.concat(F.split("teammates", r"\|"), F.array("candidate")))), "|")
    best = c.withColumn("canonical", key).groupBy("bucket", "canonical").agg(F.min_by(F.struct("games", "avg_placement", "win_rate", "top3_rate"), F.struct(-F.col("games"), "candidate", "teammates")).alias("s")).select("bucket", "canonical", "s.*")
    score = X.placement_ranking(F.col("avg_placement"), F.col("top3_rate"), F.col("win_rate")) * X.log_confidence(F.col("games"), 80.0) + F.least(F.lit(14.0), 0.35 * F.col("games"))
    return best.select("bucket", "canonical", "games", R(score, 3).alias("score"))


#: Variants that the dimension of codes lists: some characters have one, some two, the others all.
LISTED = "case b % 5 when 0 then t = cast(b / 5 as int) % 6 when 1 then t <= 1 else true end"


def stat_id_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id under which a player counts, by character and weapon code: the only variant of its character, else the
    variant of the weapon that the code stands for, else the character. What a code stands for is learnt from the
    characters with one variant: the weapon seen most with it (then the lower name)."""
    p = players(spark, sf_dir).select("character", F.col("core").alias("code"))
    listed = layered(p.select("character").distinct().withColumn("weapon", F.explode(F.array(*map(F.lit, WEAPONS)))), KEYS).where(LISTED).select("character", "weapon")
    single = listed.groupBy("character").agg(F.count("*").alias("n"), F.min("weapon").alias("only")).where("n = 1")
    seen = p.join(F.broadcast(single), "character").groupBy("code", "only").agg(F.count("*").alias("uses"))
    means = seen.groupBy("code").agg(F.min_by("only", F.struct(-F.col("uses"), "only")).alias("weapon"))
    rows = p.groupBy("character", "code").agg(F.count("*").alias("rows")).join(single, "character", "left").join(means, "code", "left").join(listed.withColumn("there", F.lit(True)), ["character", "weapon"], "left")
    variant = lambda w: F.concat_ws(":", "character", w)
    return rows.select("character", "code", "rows", F.when(F.col("only").isNotNull(), variant("only")).when(F.col("there"), variant("weapon")).otherwise(F.col("character")).alias("stat_id"))


def resolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member_rows with the id under which each player counts: a variant, or the character where none is known."""
    ids = stat_id_by_code(spark, sf_dir).select("character", F.col("code").alias("core"), "stat_id")
    return member_rows(spark, sf_dir).join(ids, ["character", "core"])


def tier_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine tier by MMR, compact tier, and the title override by rank."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 30).alias("mmr"), (F.col("o_custkey") % 1500).alias("rank"))
    fine = X.tier_from_mmr(F.col("mmr"))
    titled = X.ranked_tier(F.lit(None).cast("string"), F.col("mmr"), F.col("rank"))
    return t.select("id", fine.alias("fine"), X.compact_tier(fine).alias("compact"), titled.alias("titled"))


def tier_bucket_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier by name, on the segment and status names with tier words mixed in."""
    words = F.array(*[F.lit(w) for w in ("Iron IV", "GOLD", "Platinum-2", "diamond", "Meteorite", "Mithril", "Demigod", "Titan", "none", "")])
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.element_at(words, (F.col("c_custkey") % 10 + 1).cast("int")), F.lit("/"), F.col("c_mktsegment")).alias("text"))
    return t.select("id", X.tier_from_text(F.col("text")).alias("fine"))
