"""Mixing sources to target weights.

Every source's words are packed, document after document, into blocks of a fixed length. Each output shard draws
multinomial source counts out of what the sources still have to give, its slots go through a pseudorandom permutation
of the source's block numbers, pass after pass, and the blocks so chosen meet the packed documents in an equi-join on
(source, block). No document is taken more often than its source is passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, BROADCAST_KEYS, WORD, running_offsets, work_table

#: Words of a block, output shards, slots of a task's piece, and the seed of draws and permutations.
BLOCK, SHARDS, PIECE, SEED = 64, 240, 1 << 16, 17
#: Sources at most: their totals (one number each) are handled on the driver.
SOURCES = 100_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sizes: list[int], weights: list[float], factor: float, most: float) -> list[float]:
    """factor times the sum of sizes, dealt by weight; none gets over most times its size, the rest shares the excess."""
    left, out, free = factor * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / total > most * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        free -= full
        left -= sum(out[i] for i in full)
    return out


def draw(quota: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Counts (shard, source): multinomial over what is left of each quota, so that the quotas come out exactly."""
    rng, left = np.random.default_rng(seed), np.array(quota, dtype=np.int64)
    out = np.zeros((shards, len(quota)), np.int64)
    for k in range(shards):
        open_ = int(left.sum()) // (shards - k)
        while open_ > 0:
            got = np.minimum(rng.multinomial(open_, left / left.sum()), left)
            out[k] += got
            left -= got
            open_ -= int(got.sum())
    return out


def permuted(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each (n, seed): four Feistel rounds on the next even number of bits,
    walked on while the number is n or more."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64) + np.uint64(2)) // np.uint64(2))
    half = np.where((np.uint64(1) << (half * np.uint64(2))) < n.astype(np.uint64), half + np.uint64(1), half).astype(np.uint64)
    mask, x, todo = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64), np.arange(len(index))
    key = seed.astype(np.uint64)
    while len(todo):
        m, h = mask[todo], half[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(4):
            f = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ key[todo] * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (f >> np.uint64(31)) & m
        x[todo] = left << h | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, list[dict]]:
    """Documents with size, number of their source and offset in it; and the sources' names and sizes, in order.

    Sources are ordered by code point, null last. Rows without words get offset 0 like the source's first.
    """
    rows = work_table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("sum")), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    sources = [r.asDict() for r in sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))]
    names = docs.sparkSession.createDataFrame([(k, s["source"], s["size"]) for k, s in enumerate(sources)], "k int, name string, source_size long")
    named = rows.join(names, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    return running_offsets(named, "k", ["doc_id", "size", "sum"], F.col("size"), "offset", buckets=128), sources


def slots(spark, blocks: list[int], quota: list[int], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, k, slot, pass, block): what each output shard takes; slot counts within the source."""
    counts = draw(quota, shards, seed)
    starts = np.cumsum(counts, axis=0) - counts
    plan = [(k, s, int(starts[k, s]), int(counts[k, s]), blocks[s]) for k, s in zip(*map(np.ndarray.tolist, np.nonzero(counts)), strict=True)]
    pieces = (
        spark.createDataFrame(plan, "shard int, k int, start long, n long, blocks long")
        .select("shard", "k", "blocks", "start", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("at"))
        .select("shard", "k", "blocks", (F.col("start") + F.col("at")).alias("low"), F.least(F.lit(PIECE), F.col("n") - F.col("at")).cast("long").alias("n"))
        .repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(quota) // (16 * PIECE)), "shard", "k", "low")
    )

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                slot = np.arange(r.low, r.low + r.n)
                turn, at = slot // r.blocks, slot % r.blocks
                block = permuted(at, np.full(len(at), r.blocks), turn * 1_000_003 + r.k * 7_919 + seed)
                yield pd.DataFrame({"shard": np.int32(r.shard), "k": np.int32(r.k), "slot": slot, "pass": turn.astype(np.int32), "block": block})

    return pieces.mapInPandas(each, "shard int, k int, slot long, pass int, block long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), factor: float = 1.5, most: float = 2.0, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, list[dict]]:
    """The mix: (segments, slots, sources).

    segments: each document's part of each block (doc_id, source, size, sum, k, source_size, offset, block, low, high),
    low and high being word numbers in the document; rows without words have a null block. slots: see slots(). The two
    meet on (k, block). sources: name, size, weight, target in words, blocks and quota in blocks. most is met in whole
    passes over a source, so no word is taken more than ceil(most) times; a quota rounds a target to whole blocks.
    """
    spark = docs.sparkSession
    rows, sources = packed(docs, id_col, text_col, source_col)
    sizes = [s["size"] for s in sources]
    dealt = [w for w, _ in zip(cycle(weights), sources, strict=False)]
    for s, w, target in zip(sources, dealt, shares(sizes, dealt, factor, most), strict=True):
        full = -(-s["size"] // block)
        part = target / s["size"] if s["size"] else 0.0
        turns = int(part)
        quota = min(int(most * full), turns * full + round((target - turns * s["size"]) / block))
        s |= {"weight": w, "target": float(target), "blocks": full, "quota": quota}
    at = F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))))
    segments = (
        rows.withColumn("block", at)
        .withColumn("low", F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("offset")))
        .withColumn("high", F.least("size", (F.col("block") + 1) * block - F.col("offset")))
    )
    return segments, slots(spark, [s["blocks"] for s in sources], [s["quota"] for s in sources], shards, seed), sources


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken. Options as for mix().

    Rows without words (null and empty texts too) take nothing; repeated rows are packed one after the other and
    taken each for itself. Other columns are ignored.
    """
    segments, chosen, sources = mix(docs, **options)
    spark = docs.sparkSession
    targets = spark.createDataFrame([(i, s["target"]) for i, s in enumerate(sources)], "k int, target double")
    times = chosen.groupBy("k", "block").agg(F.count("*").alias("times")).hint("merge")  # as large as the corpus: no broadcast
    own = ["k", "doc_id", "source", "size", "source_size", "offset"]
    some = (
        segments.where("size > 0").join(times, ["k", "block"], "left")
        .groupBy(*own).agg(F.sum(F.coalesce("times", F.lit(0)) * (F.col("high") - F.col("low"))).cast("long").alias("taken"))
    )
    none = segments.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).join(targets, "k", "left").select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents (doc_id, text, lang, source, n_chars): one row for each pass that takes words of a row.

    Where a pass takes all blocks of a document, its text is unchanged; else it is the words taken, in order, each with
    the white space that follows it in the document (none at the end). n_chars is the new text's. Documents whose words are not drawn, or without words, have no row.
    Options as for mix(); docs needs the columns named.
    """
    segments, chosen, _ = mix(docs, **options)
    drawn = segments.where("size > 0").join(chosen.select("k", "block", F.col("pass").alias("turn")).hint("merge"), ["k", "block"])
    spans = (
        drawn.groupBy("k", "offset", "turn", "doc_id", "source", "sum", "size")
        .agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"), F.sum(F.col("high") - F.col("low")).alias("words"))
        .select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("sum").alias("_of"), "spans", (F.col("words") == F.col("size")).alias("whole"))
    )
    # rows that repeat an id, a source and a text differ only in their place: one text serves them all
    texts = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("_sum", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_sum") == F.col("_of"))
    repeated = work_table(
        texts.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_sum").alias("_of"))
        .agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    if many := repeated.count():
        hint = F.broadcast if many <= BROADCAST_KEYS else (lambda x: x)
        again = texts.join(hint(repeated), same, "left_semi").dropDuplicates(["doc_id", "source", "_sum"])
        texts = texts.join(hint(repeated), same, "left_anti").unionByName(again)
    # each word with the white space behind it; the list is bound to w, so that it is made once and not for each span
    words = F.array(F.regexp_extract_all("text", F.lit(f"{WORD}(?:{BLANKS})?"), F.lit(0)))
    cut = lambda w: F.flatten(F.transform("spans", lambda s: F.slice(w, (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int"))))
    part = F.rtrim(F.transform(words, lambda w: F.array_join(cut(w), ""))[0], F.lit(" \t\n\x0b\x0c\r"))
    text = F.when(F.col("whole"), F.col("text")).otherwise(part)
    return spans.join(texts, same).withColumn("text", text).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))
