"""URL filters: block and allow rules on hosts and paths, matched by hashed expressions.

Every URL is expanded into host-suffix and path-prefix expressions, which meet the rules in an equi-join on a short
prefix of their SHA-256; the full digests confirm a hit, and the longest rule wins. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Hex digits of a digest that the join compares; the rest is confirmed afterwards.
SHORT = 8
#: Rules up to this number are broadcast (about 200 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 100_000

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if null or without `://`."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty if null or without `://`."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _marked(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("/"), path)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(host, path, action) to (rule, marked, action, labels, path_length, short, digest).

    Hosts are lower-cased; rules with a null or empty host, a null path or another action than allow or block are
    left out, so are hosts with `/`, `?` or `#`, which no URL has, and repeated rules count once (block before allow if
    both are given). marked is host, `/` and path: what is hashed shows where the host ends.
    """
    digest = F.sha2("marked", 256)
    return (
        rules.select(lower_ascii(F.col("host")).alias("host"), F.col("path"), F.col("action"))
        .where("host <> '' and path is not null and action in ('allow', 'block')").where(~F.col("host").rlike("[/?#]"))
        .groupBy("host", "path").agg(F.max("action").alias("action"))
        .select(
            F.concat("host", "path").alias("rule"), _marked(F.col("host"), F.col("path")).alias("marked"), "action",
            F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"))
        .withColumn("digest", digest).withColumn("short", F.substring("digest", 1, SHORT))
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to pages, one row out per row in.

    rules: host, path, action (`allow` or `block`). A rule fits its host and all subdomains where the URL's path
    starts with the rule's path; the longest rule wins, at equal length the one with the longer host, then block.
    Without a fitting rule the verdict is `default` and the rule null. Null URLs and URLs without `://` fit no rule.
    Columns of pages named host, path, rule or verdict are replaced; all others stay. Distinct URLs are matched once
    and joined back, so repeated rows stay repeated. Suffixes and prefixes are made only in the lengths that rules
    have, so very long URLs cost no more than their rules.
    """
    ready = prepare_rules(rules)
    shape = ready.agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    ready = ready.select("short", "digest", "marked", "rule", "action", "labels")
    kept = pages.select(*[pages[c] for c in pages.columns if c not in ("host", "path", "rule", "verdict")])

    urls = kept.select(F.col(url).alias("_url")).where(F.col("_url").contains("://")).distinct()
    urls = urls.select("_url", F.split(host_of(F.col("_url")), r"\.").alias("parts"), path_of(F.col("_url")).alias("p"))
    hosts = [F.when(F.size("parts") >= k, F.array_join(F.slice("parts", -k, k), ".")) for k in sorted(shape["labels"])]
    paths = [F.when(F.length("p") >= n, F.substring(F.col("p"), 1, n)) for n in sorted(shape["lengths"])]
    both = [_marked(h, p) for h in hosts for p in paths] or [F.lit(None).cast("string")]
    tried = (
        urls.select("_url", F.explode(F.array_compact(F.array(*both))).alias("expression"))
        .withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, SHORT))
    )
    found = (
        tried.join(F.broadcast(ready) if shape["n"] <= BROADCAST_RULES else ready, "short")
        .where("full = digest and expression = marked")
        .groupBy("_url").agg(F.max(F.struct(F.length("rule"), "labels", F.col("action") == "block", "rule", "action")).alias("best"))
        .select("_url", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    )
    return (
        kept.join(found, kept[url] == found["_url"], "left").drop("_url")
        .withColumn("verdict", F.coalesce("verdict", F.lit(default)))
        .withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    )
