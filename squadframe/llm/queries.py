"""The registered queries of the operators, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, exact_dedup, html_text, lm_score, merkle, mixing, sharding, simhash, token_files, toxicity, url_filter, whitening
from .common import crc_remainder

#: The rules of op1: host, path, action.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the four rules; null URLs and those without `://` are allowed."""
    rules = spark.sql("select * from values " + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES) + " as t(host, path, action)")
    return url_filter.judge(_table(spark, sf_dir, "pages", "page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored whole; labels of three folds in four are learnt. Null and empty texts are scored like a text without windows."""
    return toxicity.classify(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % takes of every document; documents without words take part with none."""
    return mixing.taken_words(_table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts have fingerprint zero and link like any other."""
    return simhash.near_groups(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document, learnt on six folds in seven; null and empty texts have the end only."""
    return lm_score.score(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its length; null or empty html gives an empty text."""
    return html_text.main_text(_table(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again; null counts as empty."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe.decode(coded, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; null texts weigh 8 bytes."""
    placed = sharding.shard(_table(spark, sf_dir, "documents", "doc_id", "text"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays; null counts as empty."""
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; unusable vectors link with nothing."""
    return embed_dedup.near_groups(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened coordinates of every usable vector; a deviation beyond a long is null."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), 4)
    fits = F.col("deviation") <= F.lit((1 << 63) - 1)
    return found.withColumn("deviation", F.when(fits, F.col("deviation").cast("long")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back from the files: where it starts, its number of ids and their checksum; null and empty texts have the end id."""
    to = token_files.new_folder(spark)
    token_files.write_files(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), to)
    return token_files.documents(token_files.read_files(spark, to))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; one in seven (by checksum of the id) is tampered with before it is verified. Null ids never are."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    chosen = F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), 7) == 0)
    other = {"n_chars": F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", other)
    return merkle.verified(found).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_mixing, op4_simhash, op5_lm_score, op6_html_text, op7_bpe, op8_sharding, op9_exact_dedup, op10_embed_dedup, op11_whitening, op12_token_files, op13_merkle)}

SQL = {
    "op1_url_filter": """
        with parts as (
            select page_id,
                   coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
            from pages),
        rules(h, p, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        hits as (
            select parts.*, h || p as rule, action,
                   row_number() over (partition by page_id, host, path order by length(h || p) desc nulls last) as nth
            from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
        select page_id, host, path, rule, coalesce(action, 'allow') as verdict from hits where nth = 1""",
    "op9_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
        from n window w as (partition by t)""",
    "op10_embed_dedup": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
        links as (
            select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
            where list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a)
        select vec_id, (select count(*) from links where a = vec_id) as n_links,
               (select min(b) from reach where a = vec_id) as component_id,
               vec_id = (select min(b) from reach where a = vec_id) as kept
        from v""",
    "op13_merkle": """
        with recursive d as (
         select row_number() over () as rid, doc_id, source, lang, n_chars, text, coalesce('+' || lang, '') as name,
          list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda e, k: case when e % 2 = 1 then xor(e // 2, 3988292384::bigint) else e // 2 end)) as rest from documents),
        leaves as (
         select rid, doc_id, name, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
          sha256(head || coalesce(strlen(other::varchar) || ':' || other, '-') || tail) as seen
         from (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head, coalesce(strlen(text) || ':' || text, '-') as tail,
          case when doc_id is not null and xor(rest, 4294967295::bigint) % 7 = 0 then n_chars + 1 else n_chars end as other from d)),
        placed as (select *, row_number() over (partition by name order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by name) as size from leaves),
        up(name, level, pos, size, h) as (
         select name, 0, pos, size, leaf from placed
         union all
         select name, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' order by pos)) from up where size > 1 group by name, level, pos // 2, size),
        subroots as (select name, h as subroot, row_number() over (order by name) - 1 as pos, count(*) over () as size from up where size = 1),
        top(level, pos, size, h) as (
         select 0, pos, size, subroot from subroots
         union all
         select level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' order by pos)) from top where size > 1 group by level, pos // 2, size),
        steps as (
         select p.rid, u.level, p.pos >> u.level as place, b.h as beside from placed p join up u on u.name = p.name and u.pos = p.pos >> u.level and u.size > 1 left join up b on b.name = u.name and b.level = u.level and b.pos = xor(u.pos, 1)
         union all
         select p.rid, 1000 + t.level, s.pos >> t.level, b.h from placed p join subroots s using (name) join top t on t.pos = s.pos >> t.level and t.size > 1 left join top b on b.level = t.level and b.pos = xor(t.pos, 1)),
        ways as (select rid, list({place: place, h: coalesce(beside, '')} order by level) as way from steps group by rid),
        folded as (
         select p.*, subroot, coalesce(way, []) as way, list_reduce(list_prepend({place: 0::bigint, h: seen}, coalesce(way, [])), lambda a, b: {place: 0::bigint, h: sha256(case when b.place % 2 = 1 then b.h || a.h else a.h || b.h end)}).h as folded_root
         from placed p join subroots using (name) left join ways using (rid))
        select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda x: x.h), '')) as proof_sha256, folded_root, folded_root = root as verified
        from folded, (select h as root from top where size = 1)""",
}
