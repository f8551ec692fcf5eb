"""Ids, names, payloads and files' rows made clean, and the small rules as queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import rules as K
from ..sources.adapter import players, squads, table, teams, votes
from ..sources.dimension import layered, profiles
from ..sources.files import written
from .recommend import _small_grid
from .search import as_matrix, closest, summed_differences
from .votes import KEY, summarised, vote_summary

R = X.round_half_up


def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small rules on numbers and texts of the orders."""
    o = table(spark, sf_dir, "orders")
    share, price = (F.col("o_custkey") % 100) / 100.0, F.col("o_totalprice")
    letter = F.element_at(F.array(*[F.lit(x) for x in ("OP", "S", "A", "B", "C", "D", "-")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    secret = F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))
    version = F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string"), F.lit("."), (F.col("o_orderkey") % 11).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise(".b"))
    ratio = lambda x, y, w, h: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    slot = F.struct(share.alias("x"), F.lit(0.25).alias("y"), F.lit(0.1).alias("w"), (share / 2).alias("h"))
    rect = X.slot_to_rect(slot, ratio(0.1, 0.2, 0.5, 0.5), F.lit(1920.0), F.lit(1080.0))
    return o.select(
        "o_orderkey", X.one_trick_weight(share).alias("trick"), X.tier_weight(letter).alias("tier_weight"), X.legacy_tier_from_mmr(price / 30).alias("legacy_tier"), R(X.relative_score(price, F.lit(250000.0), 0.9), 4).alias("relative"),
        R(X.placement_delta((F.col("o_orderkey") % 8 + 1) * 1.0, F.lit(4.4)), 4).alias("delta"), R(X.luminance(F.col("o_orderkey") % 256, F.col("o_custkey") % 256, F.lit(7)), 3).alias("grey"), X.base64url(secret).alias("cache_key"),
        X.safe_file_part(F.col("o_orderpriority")).alias("file_part"), X.mask_secret(secret).alias("masked"), X.compare_versions(version, F.lit("1.5")).alias("newer"), rect["x"].alias("rect_x"), rect["h"].alias("rect_h"))


#: Queries in Hangul.
QUERIES_OF_NAMES = ["ㄱㄴ", "나", "ㄷ ㄱ", "ITEM", "ㅎㅇ", "ㅇㅇ ㄳ", " ", "섬", "zz"]


def hangul_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the parts with two Hangul syllables in front, which the tables lack: by a rule over the number of the part."""
    syllable = lambda n: F.decode(F.unhex(F.hex(F.expr(f"44032 + p_partkey * {n} % 11172"))), "UTF-16BE")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(syllable(588), F.lit(" "), F.col("p_name"), F.lit(" "), syllable(29)).alias("name"))


def korean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that each query finds, by text or by initials, and the names with the particle that their sound asks for."""
    q = spark.createDataFrame([(x,) for x in QUERIES_OF_NAMES], "query string")
    met = hangul_names(spark, sf_dir).join(F.broadcast(q), X.matches_search(F.col("name"), F.col("query")))  # nine queries
    return met.select("query", "p_partkey", "name", X.initials(X.search_form(F.col("name"))).alias("initials"), X.with_particle(F.col("name"), "은", "는").alias("subject"))


def member_filter(spark: SparkSession, sf_dir: str, role: str = "ranged", query: str = "brand#1") -> DataFrame:
    """Members of a role whose name, initials or id hold the query."""
    m = profiles(spark, sf_dir).where(F.col("role") == role)
    return m.where(X.matches_search(F.col("character"), F.lit(query)) | F.lower("variant").contains(query)).select("variant", "role")


def feedback_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which votes name two teammates and a candidate, after ids that mean none are emptied."""
    v = votes(spark, sf_dir)
    made = F.element_at(F.array(F.lit(""), F.lit(" null "), F.lit("None"), F.lit("undefined"), F.lit(" a:b "), F.col("candidate_id"), F.lit("empty:x")), (F.col("vote_id") % 7 + 1).cast("int"))
    ids = v.select("vote_id", F.filter(F.transform(F.array_append(F.split("team_key", r"\+"), made), X.clean_id), lambda x: x != "").alias("team"), X.clean_id(made).alias("candidate"))
    return ids.select("vote_id", F.array_join(F.array_sort("team"), "+").alias("team"), "candidate", ((F.size("team") == 2) & (F.col("candidate") != "")).alias("valid"))


def ml_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an export of valid teams: any unmapped member drops a team, then anything but three distinct members."""
    per = players(spark, sf_dir, mapped_only=False).groupBy("team_key").agg(F.count_if(~F.col("mapped")).alias("unknown"), F.count_distinct("variant").alias("members"))
    return per.agg(
        F.lit(1).alias("schema_version"), F.count("*").alias("raw_teams"), F.count_if((F.col("unknown") == 0) & (F.col("members") == 3)).alias("exported"),
        F.count_if(F.col("unknown") > 0).alias("unknown_character"), F.count_if((F.col("unknown") == 0) & (F.col("members") != 3)).alias("invalid_size"))


def roster_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three players of each nation: all with a roster if three or fewer have one, else the chosen ones, filled up
    and cut from the lowest number on."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_nationkey", (F.col("c_custkey") % 4).cast("int").alias("player"), "c_custkey")
    r = c.groupBy("c_nationkey", "player").agg(F.count("*").alias("size"), (F.max("c_custkey") % 3 == 0).alias("chosen"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("chosen"), "player")
    return r.withColumn("nth", F.row_number().over(w)).where("nth <= 3").select("c_nationkey", "player", "size", "chosen")


def name_override_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code to name: a fallback map overlaid by a fetched one, and a join on names made plain on both sides."""
    p = table(spark, sf_dir, "part")
    known = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("kept"))
    fetched = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("code"), F.upper("p_name").alias("new"))
    both = known.join(fetched, "code", "full").select("code", F.coalesce("new", "kept").alias("name"))
    alias = p.groupBy(X.plain_name(F.col("p_name")).alias("plain")).agg(F.min("p_partkey").alias("first_code"))
    return both.withColumn("plain", X.plain_name(F.col("name"))).join(alias, "plain", "left").select("code", "name", "first_code", X.squeezed_name(F.col("name")).alias("squeezed"))


def trait_name_from_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traits named by group, category and index, null where the table of names has none."""
    group = F.element_at(F.array(*[F.lit(x) for x in ("Havoc", "Chaos", "Support", "Other")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", group.alias("trait_group"), (F.col("p_partkey") % 130).cast("int").alias("sort_order"), F.when(F.col("p_partkey") % 11 == 0, "CoreTrait").alias("trait_type"))
    category, index = X.trait_place(F.col("trait_type"), F.col("sort_order"))
    names = spark.range(3).select(F.element_at(F.array(*[F.lit(x) for x in ("Havoc", "Chaos", "Support")]), (F.col("id") + 1).cast("int")).alias("trait_group"))
    names = names.select("trait_group", F.explode(F.array(*map(F.lit, ("core", "sub1", "sub2")))).alias("category")).select("trait_group", "category", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("index"))
    names = F.broadcast(names.withColumn("name", F.concat_ws("/", "trait_group", "category", F.col("index").cast("string"))))  # 36 rows
    return p.withColumn("category", category).withColumn("index", index).join(names, ["trait_group", "category", "index"], "left").select("p_partkey", "category", "name")


def tournament_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams of a tournament: sorted members, flags, and the scores of the teams that have some (else 0), by placement."""
    s = squads(spark, sf_dir, "character").select("game_id", "team_key", F.col("rank").alias("placement"), F.array_join(F.array_sort(F.transform("players", lambda p: p["character"])), "+").alias("members"))
    scores = teams(spark, sf_dir).where("team_key % 3 <> 0").select("team_key", (F.lit(10) - F.col("rank")).alias("rank_score"), (F.col("team_key") % 7).cast("int").alias("kill_score"))
    rows = s.join(scores, "team_key", "left")
    return rows.select("game_id", "team_key", "placement", (F.col("placement") == 1).cast("int").alias("win"), (F.col("placement") <= 3).cast("int").alias("top3"), "members", F.coalesce("rank_score", F.lit(0)).alias("rank_score"), F.coalesce("kill_score", F.lit(0)).alias("kill_score")).orderBy("placement", "team_key")


def tier_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teams(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("teams"))


def vote_upsert_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest vote of a day, where votes have no hour."""
    v = votes(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return v.groupBy(*KEY, "day").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "vote_id")).alias("v")).select(*KEY, "day", "v.value", "v.ts")


def recovered_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes put back from summaries: for or against, where one side has more."""
    return vote_summary(spark, sf_dir).where("likes <> dislikes").select("tier", "team_key", "candidate_id", F.when(F.col("likes") > F.col("dislikes"), 1).otherwise(-1).alias("value"))


def feedback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote and local summaries, one after the other, rows without a team or candidate left out."""
    v = votes(spark, sf_dir)
    remote, local = summarised(v.where("vote_id % 2 = 0")).withColumn("source", F.lit("remote")), summarised(v.where("vote_id % 2 = 1")).withColumn("source", F.lit("local"))
    return remote.unionByName(local).where("team_key <> '' and candidate_id <> ''").select("source", "tier", "team_key", "candidate_id", "likes", "dislikes")


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member's tags, the required ones it lacks, and its tags with those of the first variant, in order."""
    tags = F.array_compact(F.array(*[F.when(F.col(f"t_{t}") == 1, F.lit(t)) for t in K.TAGS]))
    m = profiles(spark, sf_dir).select("variant", "character", tags.alias("tags"))
    first = m.groupBy("character").agg(F.min_by("tags", "variant").alias("more"))
    join = lambda c: F.array_join(c, " ")
    return m.join(first, "character").select("variant", join("tags").alias("tags"), join(F.array_except(F.array(*map(F.lit, K.REQUIRED)), "tags")).alias("lacking"), join(F.array_distinct(F.concat("tags", "more"))).alias("together"))


def unmapped_code_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmapped codes, kept as texts, in the order of their numbers: the second page of five."""
    codes = table(spark, sf_dir, "part").where("p_size >= 48").select(F.col("p_partkey").cast("string").alias("code")).distinct()
    return codes.orderBy(F.col("code").cast("int")).offset(5).limit(5)


def fixed_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts and shares of the line items with two and three digits, by the exact value of the product."""
    share = F.col("l_extendedprice") * F.col("l_discount")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.fixed(share, 2).alias("discount"), X.fixed(share / 8, 2).alias("eighth"), X.fixed(-share / 7, 3).alias("seventh"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("discount", "eighth", "seventh")])


def rows_of_ids(df: DataFrame, column: str, low: int | None = None, high: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Rows whose id lies in a range (either end may be open) and in a list, if there is one. Both reach the scan; a list
    is sent with the plan, so it is one that a user wrote down."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    if high is not None:
        df = df.where(F.col(column) <= high)
    return df.where(F.col(column).isin(ids)) if ids is not None else df


def id_range_scan(spark: SparkSession, sf_dir: str, low: int = 100, high: int | None = None) -> DataFrame:
    """Rows of the ids of a range; ids that do not exist give none."""
    return rows_of_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", low, high)


def html_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six metrics (1 to 5) named in a page, with a sign of equality, a colon or nothing before the number; the decoded
    page is tried first, then its plain text. Pages that lack one give no row. The fixtures' pages name none, so five of
    six pages get a line for each, some with markup between the name and the number."""
    names = ["difficulty", "damage", "defense", "control", "mobility", "utility"]
    value = lambda k: (F.col("page_id") * (k + 2) % 5 + 1).cast("string")
    shapes = lambda n, k: [F.concat(F.lit(f"<p>{n} &#58; "), value(k), F.lit("</p>")), F.concat(F.lit(f"<td>{n}</td><td>"), value(k), F.lit("</td>")), F.concat(F.lit(f"<p>{n}"), value(k), F.lit("</p>")), F.concat(F.lit(f"<p>{n} <b>＝</b> 9 {n} = "), value(k), F.lit("</p>"))]
    line = F.concat(*[F.element_at(F.array(*shapes(n, k)), ((F.col("page_id") + k) % 4 + 1).cast("int")) for k, n in enumerate(names)])
    pages = table(spark, sf_dir, "pages").select("page_id", X.decoded_html(F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 6 != 0, line).otherwise(F.lit("<p>damage 3</p>")))).alias("decoded"))
    bare = F.regexp_replace(F.regexp_replace("decoded", r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    pages = pages.withColumn("plain", F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))
    first = lambda c, n: F.nullif(F.regexp_extract(c, rf"(?:{n})\s*[=:：]?\s*([1-5])", 1), F.lit(""))
    return pages.select("page_id", *[F.coalesce(first("decoded", n), first("plain", n)).cast("int").alias(n) for n in names]).dropna()


def reason_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three labels of each document's text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.reason_labels(F.coalesce("text", F.lit(""))), " ").alias("labels"))


def preset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets by name and variants: the same one counts once, others of a name get a number behind it."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_type", "p_partkey")
    one = p.groupBy("name", "p_type").agg(F.min("p_partkey").alias("first"))
    k = F.row_number().over(Window.partitionBy("name").orderBy("first"))
    return one.withColumn("k", k).select(F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat_ws(" ", "name", F.col("k").cast("string"))).alias("name"), F.col("p_type").alias("variants"))


def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and names in lines of source text of the form c("id", "name"."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.format_string('x c("%s",  "%s", 1) c("z%s", "n")', F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string")).alias("line"))
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(r'c\("([^"]+)",\s*"([^"]+)"'), F.lit(1)).alias("id"), F.regexp_extract_all("line", F.lit(r'c\("([^"]+)",\s*"([^"]+)"'), F.lit(2)).alias("name"))
    return t.select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", F.col("x.id").alias("id"), F.col("x.name").alias("name"))


def team_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the members of a full team fit, for every candidate and pair selected."""
    return layered(_small_grid(spark, sf_dir).where("n = 2"), K.TEAM_REASONS).select("sel", "variant", "union_reason", "composition_reason")


def _pixels(vectors: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """Images (red, green, blue, alpha of each pixel, 0 to 255) as colours and greys under their alpha, each with what is
    missing, and the number of pixels."""
    raw, missing = as_matrix(vectors)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    # an entry that is null is full, one beyond the end is missing
    ended = np.arange(raw.shape[1]) >= sizes[:, None]
    v = np.where(missing | np.isnan(raw), 255.0, np.minimum(255.0, np.abs(raw) * 100))
    n = raw.shape[1] // 4
    r, g, b, a = (v[:, k : 4 * n : 4] for k in range(4))
    gone = ended[:, 3 : 4 * n : 4]
    colours = np.stack([c * (a / 255) for c in (r, g, b)], axis=2).reshape(len(v), 3 * n)
    greys = (r * 0.299 + g * 0.587 + b * 0.114) * (a / 255)
    return colours, greys, np.repeat(gone, 3, axis=1), gone, sizes / 4


def _unlike(q: tuple, t: tuple) -> tuple[np.ndarray, None]:
    """One less the confidence (to six digits): 0 for the same image."""
    (colour, none), (grey, _) = summed_differences(q[0], t[0], q[2], t[2], 3), summed_differences(q[1], t[1], q[3], t[3])
    n = q[4][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = colour / (n * 3 * 255) * 0.55 + grey / (n * 255) * 0.45
    x = np.where(np.isnan(x), 1.0, x) if none is None else np.where(none | np.isnan(x), 1.0, x)
    return -np.floor(np.maximum(0.0, 1 - x) * 1e6 + 0.5) / 1e6, None


def detected_team(spark: SparkSession, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Members in the slots of the layout that fits best: per slot the template of the highest confidence (of equal ones
    the lowest id), the layout by mean confidence, then confident and different members."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null").select("vec_id", F.col("embedding").alias("v"), "label")
    met = closest(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("slot"), "v"), _pixels, _unlike)
    best = met.groupBy("slot").agg(F.min(F.struct("distance", "vec_id", "label")).alias("b"))
    best = best.select(F.expr("cast(slot div 20 % 4 as int)").alias("layout"), "slot", "b.label", F.abs("b.distance").alias("confidence"))
    best = written(best, "best")
    layout = best.groupBy("layout").agg(R(F.avg("confidence"), 6).alias("mean")).orderBy(F.desc("mean"), "layout").limit(1)
    rows = best.join(F.broadcast(layout), "layout").where(F.col("confidence") >= least)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("slot"))).where("k = 1").select("layout", "slot", "label", "confidence")
