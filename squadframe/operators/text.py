"""Text helpers as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.adapter import table, votes


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities first, then scripts, styles and tags out, white space to one space."""
    h = F.coalesce("html", F.lit(""))
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        h = F.replace(h, F.lit(a), F.lit(b))
    h = F.regexp_replace(h, r"(?is)<script.*?</script>", " ")
    h = F.regexp_replace(h, r"(?is)<style.*?</style>", " ")
    h = F.regexp_replace(F.regexp_replace(h, r"<[^>]*>", " "), r"[ \t\r\n]+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(h).alias("plain"))


def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.plain_name(F.col("p_name")).alias("name"))


def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.csv_escape(F.col("text")).alias("field"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


def initial_search(spark: SparkSession, sf_dir: str, needle: str = "th") -> DataFrame:
    return table(spark, sf_dir, "documents").where(X.matches_search(F.col("text"), F.lit(needle))).select("doc_id")


def feedback_key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes(spark, sf_dir).select("vote_id", F.concat("tier", F.lit(":"), "team_key", F.lit("->"), "candidate_id").alias("key"))
    part = lambda k: F.regexp_extract("key", "^([^:]+):(.+)->(.+)$", k)
    return v.select("vote_id", part(1).alias("tier"), part(2).alias("team_key"), part(3).alias("candidate_id"))


#: Messages by language; French lacks one, and the third key has none at all.
MESSAGES = {
    "en": {"size": "{n} characters from {s}", "empty": "nothing from {s}"}, "de": {"size": "{n} Zeichen aus {s}", "empty": "nichts aus {s}"}, "fr": {"size": "{n} signes de {s}"},
}


def i18n_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each document in its language, else in English, else the message's key."""
    key = F.when(F.col("doc_id") % 5 == 0, "empty").when(F.col("doc_id") % 7 == 0, "unknown.key").otherwise("size")
    return table(spark, sf_dir, "documents").select("doc_id", X.message(MESSAGES, F.col("lang"), key, {"n": F.col("n_chars"), "s": F.col("source")}).alias("label"))
