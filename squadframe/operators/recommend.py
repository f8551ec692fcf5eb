"""Recommendation: every candidate scored for the selected members, and the best eighteen.

One row for each candidate and selection carries the candidate's columns and the sums over the selected; each layer of
rules is one select over it, so the sub-scores stay in generated code. The selections asked for are few and broadcast.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import rules as K
from ..sources.adapter import held_teams
from ..sources.files import written
from ..sources.dimension import layered, profiles, synergy_pairs
from .ranker import first_variants, ranker_candidate_stats, ranker_composition_stats, snapshot, tournament_references, with_trick
from .stats import SUMS, WEIGHT, finalized, official_candidate_stats, official_combat_stats, official_pair_stats, pair_statistics, resolved_rows, rolled_up, weighted_mean
from .votes import vote_summary

#: Tiers that the selections ask for in turn; the last one is no tier and means `all`.
TIERS = ["all", "diamond", "mithril_plus", "iron_bronze", "elsewhere"]
#: Results of a recommendation.
TOP = 18
#: Selections of a piece of the tables that have many rows for each.
SELECTIONS_IN_PIECE = 256
#: A group of fewer members than this is measured by its whole bucket.
SUPPORT = 8
_MEANS = ["win_rate", "top3_rate", "avg_placement", "avg_damage", "avg_damage_from"]


def measured(stats: DataFrame, combat: DataFrame) -> DataFrame:
    """The measured row of every member, from the bucket `all`, with rates in percent."""
    rows = stats.where("bucket = 'all'").join(combat.where("bucket = 'all'").select("stat_id", "avg_kills"), "stat_id")
    rows = rows.selectExpr("stat_id as variant", "avg_damage as rt_damage", "games as rt_games", "win_rate * 100 as rt_win", "top3_rate * 100 as rt_top3", "avg_placement as rt_rank", "avg_kills as rt_kills")
    return rows.selectExpr("*", f"{K.RT_TIER} as rt_tier")


def members(profile: DataFrame, rt: DataFrame) -> DataFrame:
    """Members with measured rows, the mean damage of their group as reference, and all predicates."""
    rows = profile.join(rt, "variant", "left")
    by_group = rows.where("rt_damage <> 0").groupBy("rt_group").agg(F.avg("rt_damage").alias("of_group"))
    every = rows.where("rt_damage <> 0").agg(F.avg("rt_damage").alias("of_all"))
    rows = rows.join(F.broadcast(by_group), "rt_group", "left").join(F.broadcast(every))  # four groups, one row
    return layered(rows.withColumn("rt_reference", F.coalesce("of_group", "of_all")).drop("of_group", "of_all"), K.DAMAGE_LEVEL, K.PREDICATES, K.CONTRIBUTORS)


def damage_references(rows: DataFrame) -> DataFrame:
    """Mean measured damage by group, and of all."""
    both = rows.where("rt_damage <> 0").select(F.explode(F.array("rt_group", F.lit("all"))).alias("group"), "rt_damage")
    return both.groupBy("group").agg(F.count("*").alias("members"), X.round_half_up(F.avg("rt_damage"), 3).alias("mean_damage"))


def stored_buckets(asked: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds bucket to rows with a tier: its alias's bucket if the statistics have it, else `all`."""
    there = F.broadcast(stats.select(F.col("bucket").alias("there")).distinct())  # a handful of buckets
    want = F.expr(K.aliased("tier", K.TIER_ALIAS, "coalesce(tier, 'all')"))
    return asked.withColumn("want", want).join(there, F.col("want") == F.col("there"), "left").withColumn("bucket", F.coalesce("there", F.lit("all"))).drop("want", "there")


def selections(stats: DataFrame, most: int = 6) -> DataFrame:
    """(sel, tier, bucket, picked): pairs of different characters among the most played members, singles, and none."""
    top = stats.where("bucket = 'all'").orderBy(F.desc("games"), "stat_id").limit(most)
    top = top.select(F.row_number().over(Window.orderBy(F.desc("games"), "stat_id")).alias("k"), F.col("stat_id").alias("v"), F.split_part("stat_id", F.lit(":"), F.lit(1)).alias("c"))  # six rows
    a, b = top.select(F.col("k").alias("k1"), F.col("v").alias("v1"), F.col("c").alias("c1")), top.select(F.col("k").alias("k2"), F.col("v").alias("v2"), F.col("c").alias("c2"))
    two = a.join(F.broadcast(b), (F.col("k1") < F.col("k2")) & (F.col("c1") != F.col("c2"))).select(F.format_string("%d-%d", "k1", "k2").alias("sel"), ((F.col("k1") + F.col("k2")) % 5).alias("i"), F.array("v1", "v2").alias("picked"))
    one = top.where("k <= 2").select(F.col("k").cast("string").alias("sel"), (F.col("k") % 5).alias("i"), F.array("v").alias("picked"))
    none = top.where("k = 1").select(F.lit("none").alias("sel"), F.lit(0).alias("i"), F.array().cast("array<string>").alias("picked"))
    rows = two.unionByName(one).unionByName(none)
    return stored_buckets(rows.select("sel", F.element_at(F.array(*map(F.lit, TIERS)), (F.col("i") + 1).cast("int")).alias("tier"), "picked"), stats)


def selected_members(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(sel, tier, bucket) with the columns of each selected member."""
    return asked.select("sel", "tier", "bucket", F.explode("picked").alias("variant")).join(rows, "variant")


def grid(asked: DataFrame, rows: DataFrame, pool: list[str] | DataFrame | None = None) -> DataFrame:
    """Every candidate for every selection, without the selected characters, with all sums and sub-scores.

    pool keeps some candidates: a list by variant if any entry has a colon, else by character; a table by selection and
    variant.
    """
    picked = selected_members(asked, rows)
    if isinstance(pool, list) and pool:
        rows = rows.where(F.col("variant" if any(":" in x for x in pool) else "character").isin(pool))
    sums = picked.groupBy("sel").agg(F.count("*").alias("n"), F.collect_set("character").alias("taken"), *[F.sum(x).alias(f"s_{x}") for x in K.SUMMED])
    each = asked.select("sel", "tier", "bucket").join(sums, "sel", "left").na.fill(0)
    each = each.withColumn("taken", F.coalesce("taken", F.array().cast("array<string>")))
    if isinstance(pool, DataFrame):
        asked_for = pool.select("sel", "variant").join(F.broadcast(rows), "variant")  # a row for each member
        every = asked_for.join(F.broadcast(each), "sel").where(~F.array_contains("taken", F.col("character")))
    else:
        every = rows.join(F.broadcast(each), ~F.array_contains("taken", F.col("character")))  # the selections asked for
    return layered(every, K.TEAM, K.MEANS, K.SCORES, K.BUDGET)


def synergy_scores(picked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sel, character, pair_sum, pairs): scores of a character with the selected ones."""
    return picked.select("sel", F.col("character").alias("a")).join(pairs, "a").groupBy("sel", F.col("b").alias("character")).agg(F.sum("score").alias("pair_sum"), F.count("*").alias("pairs"))


def known_stats(stats: DataFrame, members: DataFrame, buckets: DataFrame) -> DataFrame:
    """(bucket, variant, level) with the whole row of the first statistics that there are: the variant's in the bucket,
    the character's there, the variant's in `all`, the character's there (levels 1 to 4).

    members has variant and character, buckets are a handful. Each member asks for four keys, so the statistics are read
    by one join on (bucket, id), whatever ids they hold.
    """
    ways = [("bucket", "variant"), ("bucket", "character"), (F.lit("all"), "variant"), (F.lit("all"), "character")]
    keys = F.array(*[F.struct(F.lit(k + 1).alias("level"), (F.col(b) if isinstance(b, str) else b).alias("of"), F.col(i).alias("stat_id")) for k, (b, i) in enumerate(ways)])
    asked = members.select("variant", "character").distinct().join(F.broadcast(buckets.select("bucket").distinct())).select("bucket", "variant", F.inline(keys))
    values = [c for c in stats.columns if c not in ("bucket", "stat_id")]
    met = asked.join(stats.withColumnRenamed("bucket", "of"), ["of", "stat_id"])
    return met.groupBy("bucket", "variant").agg(F.min_by(F.struct("level", *values), "level").alias("x")).select("bucket", "variant", "x.*")


def known_in(stats: DataFrame, members: DataFrame) -> DataFrame:
    """(bucket, variant) with the variant's row in each bucket that has one, else the character's there."""
    own = stats.withColumnRenamed("stat_id", "variant").withColumn("level", F.lit(1))
    general = stats.withColumnRenamed("stat_id", "character").join(members.select("variant", "character").distinct(), "character").drop("character").withColumn("level", F.lit(2))
    values = [c for c in stats.columns if c not in ("bucket", "stat_id")]
    return own.unionByName(general).groupBy("bucket", "variant").agg(F.min_by(F.struct(*values), "level").alias("x")).select("bucket", "variant", "x.*")


def group_averages(stats: DataFrame, groups: DataFrame, group: str, means: list[str], support: int) -> DataFrame:
    """Games-weighted means (q_...) by bucket and group of members; the whole bucket's for groups under the support."""
    rows = stats.where("games > 0").join(groups, "stat_id")
    mean = [weighted_mean(f"coalesce({c}, {'4.5D' if c == 'avg_placement' else '0D'})").alias(f"q_{c}") for c in means]
    own = rows.groupBy("bucket", group).agg(F.count("*").alias("n"), F.struct(*mean).alias("own"))
    whole = rows.groupBy("bucket").agg(F.struct(*mean).alias("whole"))
    return own.join(F.broadcast(whole), "bucket").select("bucket", group, F.when(F.col("n") >= support, F.col("own")).otherwise(F.col("whole")).alias("x")).select("bucket", group, "x.*")


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(b).alias(a) for a, b in names.items()])


def member_values(rows: DataFrame, stats: DataFrame, combat: DataFrame, ranked: DataFrame, tiers: DataFrame) -> DataFrame:
    """(tier, bucket, variant) with the scores that need no team: official, snapshot, measured and combined ones."""
    buckets = tiers.select("bucket").distinct()
    base = tiers.join(known_stats(stats, rows, buckets).drop("level"), "bucket")
    base = tiers.join(F.broadcast(rows.select("variant", "character", "front", "rt_group", "rt_damage", "rt_games", "rt_win", "rt_top3", "rt_rank", "rt_kills", "rt_tier", "rt_reference"))).join(base.drop("tier").distinct(), ["bucket", "variant"], "left")
    averages = group_averages(stats, rows.select(F.col("variant").alias("stat_id"), "rt_group"), "rt_group", _MEANS, SUPPORT)
    mean = stats.groupBy("bucket").agg(weighted_mean("win_rate").alias("mean_rate"))
    fought = _renamed(known_in(combat, rows), bucket="bucket", variant="variant", c_games="games", c_damage="avg_damage", avg_kills="avg_kills", avg_assists="avg_assists", avg_team_kills="avg_team_kills")
    rank = _renamed(ranked, character="candidate", k_games="games", k_placement="avg_placement", k_top3="top3_rate", k_win="win_rate", k_trick="one_trick")
    snap = written(snapshot(stats), "snapshot")
    labels, played = snap.select("bucket", "character", "tier_label"), _renamed(snap, bucket="bucket", character="character", p_games="games", p_placement="avg_placement", p_top3="top3_rate", p_win="win_rate")
    shown = F.expr(K.aliased("tier", K.SNAPSHOT_ALIAS, "'all'"))
    both = base.withColumn("shown", shown)
    for part in (labels, played):
        cols = part.columns[2:]
        own, general = part.select(F.col("bucket").alias("shown"), "character", F.struct(*cols).alias("own")), part.where("bucket = 'all'").select("character", F.struct(*cols).alias("general"))
        both = both.join(own, ["shown", "character"], "left").join(general, "character", "left").withColumn("x", F.coalesce("own", "general")).select("*", "x.*").drop("own", "general", "x")
    of_all = rows.where("rt_damage is not null").agg(*[X.round_half_up(F.avg(f"rt_{c}"), 6).alias(f"v_{c}") for c in ("win", "top3", "rank", "kills")])
    both = both.join(averages, ["bucket", "rt_group"], "left").join(F.broadcast(mean), "bucket").join(fought, ["bucket", "variant"], "left").join(rank, "character", "left").join(F.broadcast(of_all))
    return layered(both, K.OFFICIAL, K.META, K.COMBINED)


def pair_synergies(picked: DataFrame, members: DataFrame, stats: DataFrame, pairs: DataFrame, alpha: float = 80.0) -> DataFrame:
    """(sel, variant, pair_above): by how much the pairs with the selected are above what both members let expect.

    Of a candidate and a selected member the first pair counts that has statistics: both variants, the candidate's
    variant and the other's character, the other way round, both characters. Pairs that were never played add nothing.
    """
    mean = F.broadcast(stats.groupBy("bucket").agg(weighted_mean("win_rate").alias("mean_rate")))  # a handful of buckets
    members = members.select("variant", "character").distinct()
    rated = known_stats(stats, members, picked).join(mean, "bucket").select("bucket", "variant", ((F.col("win_rate") * F.col("games") + alpha * F.col("mean_rate")) / (F.col("games") + alpha)).alias("rate"))
    ids = lambda level: F.inline(F.array(F.struct(F.lit(0).alias(level), F.col("variant").alias("id")), F.struct(F.lit(1).alias(level), F.col("character").alias("id"))))
    mates = picked.select("sel", "bucket", F.col("variant").alias("mate"), ids("of_mate")).withColumnRenamed("id", "x")
    others = members.select("variant", ids("of_other")).withColumnRenamed("id", "y")
    sides = pairs.select("bucket", F.col("a").alias("x"), F.col("b").alias("y"), "games", "win_rate").unionByName(pairs.where("a <> b").select("bucket", F.col("b").alias("x"), F.col("a").alias("y"), "games", "win_rate"))
    met = sides.join(mates, ["bucket", "x"]).join(others, "y")
    met = met.groupBy("sel", "bucket", "mate", "variant").agg(F.min_by(F.struct("games", "win_rate"), F.col("of_other") * 2 + F.col("of_mate")).alias("p")).select("sel", "bucket", "mate", "variant", "p.*")
    for side in ("mate", "variant"):
        met = met.join(rated.select("bucket", F.col("variant").alias(side), F.col("rate").alias(f"rate_{side}")), ["bucket", side], "left")
    met = met.join(mean, "bucket")
    expected = (F.coalesce("rate_mate", "mean_rate") + F.coalesce("rate_variant", "mean_rate")) * 0.5
    above = (F.col("games") * F.col("win_rate") + alpha * expected) / (F.col("games") + alpha) - expected
    return met.groupBy("sel", "variant").agg(F.sum(above).alias("pair_above"))


def ranker_compositions(picked: DataFrame, comps: DataFrame) -> DataFrame:
    """(sel, character, ranker_composition) from the ranked users' teams that hold selected characters."""
    size = picked.groupBy("sel").agg(F.count_distinct("character").alias("k"))
    met = comps.withColumn("mate", F.explode(F.split("teammates", r"\+"))).join(picked.select("sel", F.col("character").alias("mate")).distinct(), "mate")
    met = met.groupBy("sel", "teammates", "candidate", "games", "avg_placement", "win_rate", "top3_rate", "one_trick").agg(F.count("*").alias("hits")).join(F.broadcast(size), "sel")
    weight = F.expr(K.doubles(f"hits * case when hits = k then 1.45 else 0.48 end * least(1.25, log2(games + 1.0) / 4.5) * {K.TRICK_WEIGHT}"))
    rows = met.select("sel", "candidate", weight.alias("w"), F.expr(K.doubles(K.RANKER_SCORE)).alias("s"))
    return rows.groupBy("sel", F.col("candidate").alias("character")).agg(X.clamp(F.sum(F.col("s") * F.col("w")) / F.sum("w") * 1.7, -2.8, 2.8).alias("ranker_composition"))


def tournament_compositions_score(picked: DataFrame, refs: DataFrame) -> DataFrame:
    """(sel, character, tournament_composition) from the reference teams that hold selected characters."""
    size = picked.groupBy("sel").agg(F.count("*").alias("k"))
    each = refs.withColumn("member", F.explode(F.split("members", r"\+")))
    met = each.join(picked.select("sel", F.col("character").alias("member")), "member").groupBy("sel", "members").agg(F.count("*").alias("hits")).join(F.broadcast(size), "sel")
    rows = each.select("members", F.col("member").alias("character"), "appearances", "rank", "ts", "ks").join(met, "members")
    rows = layered(rows, {"exact": "case when k >= 2 and hits = k then 1 else 0 end", "result": K.RESULT_SCORE}, {"mw": "case when exact = 1 then 1.2 when k = 1 then 0.45 else 0.5 end"})
    g = rows.groupBy("sel", "character").agg(
        F.sum(F.expr(K.doubles("result * mw * least(1.1, log2(appearances + 1.0))"))).alias("score"), F.sum("mw").alias("w"), F.sum("exact").alias("exact"), F.sum(F.expr(K.doubles("exact * greatest(0.1, result)"))).alias("exact_score"))
    return layered(g, {"bonus": "case when exact > 0 then least(1.5, exact * 0.6 + exact_score * 0.4) else 0.0 end"}).select("sel", "character", F.expr(K.doubles("greatest(-0.5, least(case when exact > 0 then 1.1 else 0.55 end + bonus, score / w + bonus))")).alias("tournament_composition"))


def tournament_archetypes(every: DataFrame, rows: DataFrame, refs: DataFrame) -> DataFrame:
    """(sel, variant, tournament_archetype): full teams against the reference teams of like metrics or with a common
    member. The references are bounded, so they are broadcast."""
    five = [m for m in K.METRICS if m != "difficulty"]
    first = first_variants(rows).select(F.col("character").alias("member"), *[f"m_{m}" for m in five])
    means = [X.round_half_up(F.sum(f"m_{m}") / F.count("*"), 2).alias(f"f_{m}") for m in five]
    known = refs.withColumn("member", F.explode(F.split("members", r"\+"))).join(first, "member").groupBy("members", "rank", "ts", "ks").agg(F.count("*").alias("size"), *means).where("size >= 3")
    met = every.where("n >= 2").select("sel", "variant", F.concat("taken", F.array("character")).alias("team"), *[f"a_{m}" for m in five]).join(F.broadcast(known))
    met = met.withColumn("overlap", F.size(F.array_intersect("team", F.split("members", r"\+"))))
    met = layered(met, {"similarity": "greatest(0.0, 1 - (" + " + ".join(f"abs(a_{m} - f_{m})" for m in five) + ") / 7.5)", "result": K.RESULT_SCORE}).where("similarity >= 0.72 or overlap > 0")
    met = layered(met, {"w": "similarity * case when overlap >= 2 then 1.0 when overlap = 1 then 0.45 else 0.22 end"})
    g = met.groupBy("sel", "variant").agg(F.sum(F.col("result") * F.col("w")).alias("score"), F.sum("w").alias("w"), F.max("similarity").alias("best"))
    return layered(g, {"tournament_archetype": "case when w = 0 then 0.0 else " + K.limit("score / w * least(1.0, best + 0.08) * 0.9", -0.8, 1.15) + " end"}).select("sel", "variant", "tournament_archetype")


def character_votes(summary: DataFrame) -> DataFrame:
    """Vote summaries with their numbered names as characters: x0 is the first, c0 the ninth, d0 the fourteenth."""
    name = lambda c, low: F.concat(F.lit("Brand#"), (F.substring(c, 2, 9).cast("int") + low).cast("string"))
    team = F.array_sort(F.array(name(F.split_part("team_key", F.lit("+"), F.lit(1)), 9), name(F.split_part("team_key", F.lit("+"), F.lit(2)), 14)))
    return summary.select("tier", team.alias("team"), name(F.col("candidate_id"), 1).alias("candidate"), "likes", "dislikes")


def relationships(picked: DataFrame, votes: DataFrame, pieces: int = 0) -> DataFrame:
    """(sel, character, relationship): weighted sentiment of the votes whose final team holds the character and a selected
    one. Many selections are few rows that meet many votes, so they are dealt to pieces."""
    size = picked.groupBy("sel", "tier").agg(F.count_distinct("character").alias("k"))
    final = votes.where("likes + dislikes > 0").withColumn("final", F.array_distinct(F.concat("team", F.array("candidate")))).withColumnRenamed("tier", "of")
    held = picked.select("sel", "tier", F.col("character").alias("member")).distinct()
    held = held.repartition(pieces, "sel") if pieces > 1 else held
    met = final.withColumn("member", F.explode("final")).join(held, "member").where("tier = 'all' or of = tier or of = 'all'")
    met = met.groupBy("sel", "tier", "of", "final", "candidate", "likes", "dislikes").agg(F.count("*").alias("hits")).join(F.broadcast(size), ["sel", "tier"])
    rows = layered(met, {
        "w": "hits * case when hits = k then 1.35 else 0.58 end * least(1.4, log2(likes + dislikes + 1.0) / 3) * case when of = tier then 1.15 else 0.75 end * 1.05",
        "s": "(likes - dislikes) / (likes + dislikes + 6.0) * least(1.0, log2(likes + dislikes + 1.0) / 4)"})
    rows = rows.select("sel", F.explode("final").alias("character"), "w", "s")
    return rows.groupBy("sel", "character").agg(X.clamp(F.sum(F.col("s") * F.col("w")) / F.sum("w") * 3.4, -2.2, 2.2).alias("relationship"))


def feedbacks(asked: DataFrame, picked: DataFrame, votes: DataFrame) -> DataFrame:
    """(sel, character, feedback): votes for exactly this team and candidate, and for the candidate in general.

    A selection hears its own tier and `all`, the tier `all` hears every vote. Votes are added up by tier, team and
    candidate first, and then also for the tier `all`, so each joins the selections of its tier only.
    """
    sums = votes.groupBy("tier", "team", "candidate").agg(F.sum("likes").alias("likes"), F.sum("dislikes").alias("dislikes")).withColumnRenamed("tier", "of")
    # votes of a tier are heard in it and in `all`, those of `all` in every tier
    tiers = asked.select("tier").distinct()
    own = sums.where("of <> 'all'").withColumn("tier", F.explode(F.array("of", F.lit("all"))))
    general = sums.where("of = 'all'").join(F.broadcast(tiers))  # a handful of tiers
    heard = asked.select("sel", "tier").join(own.unionByName(general), "tier")
    teams = picked.groupBy("sel").agg(F.array_sort(F.collect_list("character")).alias("own")).where("size(own) = 2")
    same = heard.join(F.broadcast(teams), "sel", "left").withColumn("exact", F.coalesce(F.col("own") == F.col("team"), F.lit(False)))
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0.0))
    sums = []
    for c in ("likes", "dislikes"):
        sums += [total(c, F.col("exact") & (F.col("of") == F.col("tier"))).alias(f"{c}_own"), total(c, F.col("exact") & (F.col("of") == "all")).alias(f"{c}_all"), F.sum(F.col(c) * F.when(F.col("of") == F.col("tier"), 1.0).otherwise(0.65)).alias(c)]
    g = same.groupBy("sel", "tier", F.col("candidate").alias("character")).agg(*sums)
    score = lambda k: X.vote_score(F.col(f"likes{k}"), F.col(f"dislikes{k}"))
    exact = F.when(F.col("tier") == "all", score("_own")).otherwise(score("_own") * 0.75 + score("_all") * 0.25)
    return g.select("sel", "character", (exact + score("") * 0.35).alias("feedback"))


class Base:
    """The tables that scores read, each made when it is first asked for and written once. All come from the held teams,
    so the line items are read and shuffled once, however many tables and evaluations there are."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.of = spark, sf_dir

    @cached_property
    def held(self) -> DataFrame:
        return written(held_teams(*self.of), "held")

    @cached_property
    def stats(self) -> DataFrame:
        return written(official_candidate_stats(*self.of, held=self.held), "stats")

    @cached_property
    def combat(self) -> DataFrame:
        return written(official_combat_stats(*self.of, held=self.held), "combat")

    @cached_property
    def rows(self) -> DataFrame:
        """A row for each member."""
        return written(members(profiles(*self.of), measured(self.stats, self.combat)), "members")

    @cached_property
    def pairs(self) -> DataFrame:
        return written(official_pair_stats(*self.of, held=self.held), "pairs")

    @cached_property
    def seen(self) -> DataFrame:
        return written(with_trick(*self.of, self.held), "seen")

    @cached_property
    def ranked(self) -> DataFrame:
        return written(ranker_candidate_stats(*self.of, seen=self.seen), "ranked")

    @cached_property
    def compositions(self) -> DataFrame:
        return written(ranker_composition_stats(*self.of, seen=self.seen), "compositions")

    @cached_property
    def references(self) -> DataFrame:
        return written(tournament_references(*self.of, held=self.held), "references")

    @cached_property
    def votes(self) -> DataFrame:
        return written(character_votes(vote_summary(*self.of)), "votes")

    @cached_property
    def synergies(self) -> DataFrame:
        return written(synergy_pairs(*self.of), "synergies")


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statistics, combat, members): a row for each member and bucket at most."""
    base = Base(spark, sf_dir)
    return base.stats, base.combat, base.rows


def evaluated(base: Base, asked: DataFrame | None = None, pool: list[str] | DataFrame | None = None) -> DataFrame:
    """Every candidate for every selection (sel, tier, picked variants) with all sub-scores and their total."""
    stats, rows, refs, votes = base.stats, base.rows, base.references, base.votes
    asked = written(selections(stats) if asked is None else stored_buckets(asked, stats), "asked")
    picked = written(selected_members(asked, rows.select("variant", "character")), "picked")
    every = written(grid(asked, rows, pool), "grid")
    values = written(member_values(rows, stats, base.combat, base.ranked, asked.select("tier", "bucket").distinct()), "values")
    own = ["official_meta", "official_candidate", "power", "combat", "tier_score", "statistics_score", "realtime_score", "legacy_meta", "official_match", "meta"]
    all_of = (
        every.join(synergy_scores(picked, base.synergies), ["sel", "character"], "left").join(ranker_compositions(picked, base.compositions), ["sel", "character"], "left")
        .join(tournament_compositions_score(picked, refs), ["sel", "character"], "left").join(tournament_archetypes(every, rows, refs), ["sel", "variant"], "left")
        .join(values.select("tier", "bucket", "variant", *own), ["tier", "bucket", "variant"], "left").join(pair_synergies(picked, rows, stats, base.pairs), ["sel", "variant"], "left")
        .join(relationships(picked, votes, asked.count() // SELECTIONS_IN_PIECE), ["sel", "character"], "left").join(feedbacks(asked, picked, votes), ["sel", "character"], "left")
    ).na.fill(0.0, ["pair_sum", "pairs", "ranker_composition", "tournament_composition", "tournament_archetype", "pair_above", "relationship", "feedback"])
    return layered(all_of, {
        "synergy": "case when n = 0 then 0.0 else (pair_sum + (n - pairs) * 6.2) / n - 6.2 end", "pair_synergy": "case when n = 0 then 0.0 else " + K.limit("pair_above / n * 5", -1.0, 1.2) + " end"}, K.V2, K.TOTAL)


def recommended(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The best variant of every character (equal scores: the first variant), and of these the best ones of a selection."""
    scored = rows.withColumn("score", X.round_half_up(F.col("total"), 1))
    best = scored.withColumn("of_character", F.row_number().over(Window.partitionBy("sel", "character").orderBy(F.desc("score"), "variant"))).where("of_character = 1")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("sel").orderBy(F.desc("score"), "variant"))).where(F.col("place") <= top)


def _rounded(rows: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    return rows.select(*keys, *[X.round_half_up(F.col(c), 4).alias(c) for c in scores])


def _small_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _, rows = _base(spark, sf_dir)
    return grid(selections(stats), rows)


def member_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles, styles and derived predicates of every member, and its metrics."""
    rows = _base(spark, sf_dir)[2]
    return rows.select("variant", "role", "weapon_range", "style", X.round_half_up(F.col("cc_power"), 4).alias("cc_power"), *[x for x in K.SHAPE if x not in ("tank", "melee")], "primary_engage", "long_poke", *[f"m_{m}" for m in K.METRICS])


def team_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a candidate's team by predicate, and the team's label."""
    return layered(_small_grid(spark, sf_dir), K.LABEL).select("sel", "variant", *[f"g_{x}" for x in K.SHAPE], "shape_label")


def team_metric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means of a team's metrics, and the first three of its metric tags."""
    tags = F.array_join(F.slice(F.array_compact(F.array(*[F.expr(K.doubles(f"case when {c} then '{k}' end")) for c, k in K.METRIC_TAGS])), 1, 3), " ")
    return _small_grid(spark, sf_dir).select("sel", "variant", *[f"g_m_{m}" for m in K.METRICS], *[f"a_{m}" for m in K.METRICS], F.when(tags == "", "balanced").otherwise(tags).alias("reason"))


def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-scores that follow from members and shape alone."""
    return _rounded(_small_grid(spark, sf_dir), ["sel", "variant"], [*K.SCORES, *K.BUDGET])


def score_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-scores from tables: pairs, ranked users, tournaments, votes."""
    return _rounded(evaluated(Base(spark, sf_dir)), ["sel", "variant"], ["synergy", "ranker_composition", "tournament_composition", "tournament_archetype", "pair_synergy", "official_v2", "relationship", "feedback"])


def official_meta_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-scores of a member in a tier: official, snapshot, measured, and combined."""
    base = Base(spark, sf_dir)
    tiers = written(selections(base.stats).select("tier", "bucket").distinct(), "tiers")
    return _rounded(member_values(base.rows, base.stats, base.combat, base.ranked, tiers), ["tier", "bucket", "variant"], [*K.OFFICIAL, "legacy_meta", "official_match", "meta"])


def official_fallback_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member's power in every bucket, and its synergy with the bucket's two most played ids as a team, out of
    statistics that count some players by variant and some by character only. level says which row was the first that
    there is; members without any are missing."""
    found = written(resolved_rows(spark, sf_dir), "resolved")
    stats = written(finalized(rolled_up(found, ["stat_id"], SUMS), ["stat_id"], 5), "stats")
    teams_of = found.groupBy("team_key", "bucket", "rank").agg(F.collect_list("stat_id").alias("m")).withColumn("w", F.lit(1).cast(WEIGHT))
    pairs = pair_statistics(teams_of.select("bucket", "rank", "w", "m"))
    members = profiles(spark, sf_dir).select("variant", "character")
    top = Window.partitionBy("bucket").orderBy(F.desc("games"), "stat_id")
    best = stats.select("bucket", "stat_id", F.row_number().over(top).alias("k")).where("k <= 2")
    # an id that is a character stands for its first variant
    first = members.groupBy("character").agg(F.min("variant").alias("first"))
    chosen = best.join(first, best["stat_id"] == first["character"], "left").select("bucket", F.coalesce("first", "stat_id").alias("variant"))
    picked = chosen.join(members, "variant").select(F.col("bucket").alias("sel"), "bucket", "variant", "character")
    mean = F.broadcast(stats.groupBy("bucket").agg(weighted_mean("win_rate").alias("mean_rate")))  # a handful of buckets
    rows = known_stats(stats, members, stats).join(mean, "bucket").join(pair_synergies(picked, members, stats, pairs).withColumnRenamed("sel", "bucket"), ["bucket", "variant"], "left")
    power = F.expr(K.doubles(K.OFFICIAL["power"]))
    synergy = X.clamp(F.coalesce("pair_above", F.lit(0.0)) / 2 * 5, -1.0, 1.2)
    return rows.select("bucket", "variant", "level", "games", X.round_half_up(power, 4).alias("power"), X.round_half_up(synergy, 4).alias("synergy"))


def group_average_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(official_candidate_stats(spark, sf_dir), "stats")
    groups = profiles(spark, sf_dir).select(F.col("variant").alias("stat_id"), "rt_group")
    return _rounded(group_averages(stats, groups, "rt_group", _MEANS, SUPPORT), ["bucket", "rt_group"], [f"q_{c}" for c in _MEANS])


def tier_alias_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket that stands for each tier name."""
    names = ["all", "iron_bronze", "silver_gold", "iron_gold", "platinum_diamond", "diamond", "mithril_plus", "meteor_mithril", "demigod_eternity", "elsewhere", None]
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "id int, tier string")
    return stored_buckets(asked, official_candidate_stats(spark, sf_dir)).select("id", "tier", "bucket", F.expr(K.aliased("tier", K.SNAPSHOT_ALIAS, "'all'")).alias("shown"))


def damage_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_references(_base(spark, sf_dir)[2])


def recommend_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighteen best candidates of every selection with their scores and the keys of up to three reasons."""
    best = layered(recommended(evaluated(Base(spark, sf_dir))), K.REASON_INPUTS)
    said = F.slice(F.array_compact(F.array(*[F.expr(K.doubles(x)) for x in K.REASONS])), 1, 3)
    reasons = F.when(F.size(said) > 0, F.array_join(said, " ")).otherwise(F.expr(K.FALLBACK_REASON))
    return best.select("sel", "tier", "bucket", "place", "variant", "score", X.round_half_up(F.col("total"), 3).alias("total"), reasons.alias("reasons"))
