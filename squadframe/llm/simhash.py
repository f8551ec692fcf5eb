"""SimHash near-duplicates by meeting in the middle of the Hamming ball.

Two fingerprints within 3 bits of each other have a common variant, at most 2 flips from one and 1 from the other. At 1
or 3 bits one of the two has an odd number of ones, so the odd ones send the variants of one flip and the even ones also
those of two. Of three differing bits two lie in the same half, so pairs of flips are only made within a half. Variants
are shuffled, sorted and matched; fingerprints that share one link to the least of those at most one flip away from it,
so a variant shared by k fingerprints gives k - 1 links, not k squared; every link is real and no connection between two
fingerprints is lost.

Three bits is near identity. Where texts are to be caught from a Jaccard similarity on (keep_one), the ball's links are
candidates, and several short fingerprints find those that the ball can't: each is a hash of ROWS minima over the text's
shingles, two texts of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS (0.9996 at 0.8). Every candidate
is confirmed by the Jaccard similarity of the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, keep_rows, small_batches, work_table

SEED = 42
#: Differing bits at most; the two-step scheme below is made for this radius.
RADIUS = 3
_BLOCK = 1 << 14
#: Variants that meet in one task (8 bytes each), and fingerprints whose variants are made at a time.
VARIANTS_IN_TASK, _SLICE = 1 << 23, 1 << 11
#: Jaccard similarity of the shingle sets from which keep_one takes two texts as near copies.
SIMILAR = 0.8
#: Short fingerprints of a text, and minima in each.
BANDS, ROWS = 20, 5
#: Shingles (8 bytes each) and members of a block of a group.
SHINGLES_IN_BLOCK, MEMBERS_IN_BLOCK = 1 << 19, 1 << 10


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """64 bits, each set if it is set in over half the shingles' XXH64, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - words_per_shingle + 1)
    last = ends[words_per_shingle - 1 :] if len(words) >= words_per_shingle else ends[-1:]
    hash64, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : min(n, at + _BLOCK)].tolist(), last[at : at + _BLOCK].tolist(), strict=True)
        h = np.array([hash64(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, sum, fp), sum being xxhash64 of the text and fp a signed 64-bit integer; one row per row of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words_per_shingle) for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "sum", "fp"])

    return docs.select(id_col, F.xxhash64(text_col), text_col).mapInArrow(each, f"doc_id {kind}, sum long, fp long")


def _masks() -> np.ndarray:
    """The flips of a variant: none, each of the 64 bits, and the pairs of bits that lie in the same half."""
    one = [1 << i for i in range(64)]
    two = [one[i] | one[j] for half in (0, 32) for i in range(half, half + 32) for j in range(half, i)]
    return np.array([0, *one, *two], np.uint64)


_MASKS = _masks()
_AWAY = np.bitwise_count(_MASKS)
#: An odd factor that deals neighbouring variants evenly, and its inverse modulo 2^64.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_UNSPREAD = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _variants(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants of the fingerprints as (bucket, rest): `bits` bits of the dealt variant, and its others with the
    number of its flips in the low bits. A fingerprint with an odd number of ones has 65 variants, an even one 1,057."""
    odd = (np.bitwise_count(fps) & 1).astype(bool)
    dealt, flips = [], []
    for some, n in ((fps[odd], 65), (fps[~odd], len(_MASKS))):
        dealt.append(((some[:, None] ^ _MASKS[None, :n]) * _SPREAD).ravel())
        flips.append(np.tile(np.arange(n, dtype=np.uint64), len(some)))
    v = np.concatenate(dealt)
    return (v >> np.uint64(64 - bits)).astype(np.uint32), v << np.uint64(bits) | np.concatenate(flips)


def _meet(bucket: int, rest: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) among the fingerprints that meet in one bucket: each to the least one at most one flip away from
    the variant that they share."""
    if len(rest) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rest = np.sort(rest)
    same = rest[1:] >> np.uint64(bits) == rest[:-1] >> np.uint64(bits)
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    rest = rest[shared]
    key, flip = rest >> np.uint64(bits), (rest & np.uint64((1 << bits) - 1)).astype(np.int64)
    fp = ((key | np.uint64(bucket) << np.uint64(64 - bits)) * _UNSPREAD) ^ _MASKS[flip]
    run = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    none = np.uint64((1 << 64) - 1)
    hub = np.full(int(run[-1]) + 1 if len(run) else 0, none)
    near = _AWAY[flip] <= 1
    np.minimum.at(hub, run[near], fp[near])
    to = hub[run]
    linked = (to != none) & (to != fp)
    return fp[linked], to[linked]


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints of fps(fp): all at 3 or fewer differing bits, and enough of
    them that two fingerprints are connected exactly if they are under all such pairs.

    Every fingerprint sends 65 or 1,057 variants, whatever else there is. A variant travels as 8 bytes: its high bits
    are the bucket, and the number of its flips takes their place, so the fingerprint can be told from it. As the
    fingerprints are distinct, at most 2,081 of them share a variant: no bucket can grow hot.
    """
    spark = fps.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffled, fps.count() * 561 // VARIANTS_IN_TASK)
    bits = max(11, (parts - 1).bit_length())
    each_part = -(-(1 << bits) // parts)  # buckets of a part

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                own = np.frombuffer(batch.column(0).slice(at, _SLICE).cast(pa.int64()).to_numpy(), np.uint64)
                bucket, rest = _variants(own, bits)
                order = np.argsort(bucket, kind="stable")
                counts = np.bincount(bucket, minlength=1 << bits)
                ends = np.concatenate([[0], np.cumsum(counts)])
                rest = rest[order]
                cuts = [(k, k * each_part, min((k + 1) * each_part, 1 << bits)) for k in range(-(-(1 << bits) // each_part))]
                cuts = [(k, low, high) for k, low, high in cuts if ends[high] > ends[low]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in cuts], pa.int32()), pa.array([counts[low:high].tolist() for _, low, high in cuts], pa.list_(pa.int32())), pa.array([rest[ends[low] : ends[high]].tobytes() for _, low, high in cuts], pa.binary())],
                    ["part", "counts", "variants"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, counts, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                held.setdefault(part, []).append((np.concatenate([[0], np.cumsum(counts.values.to_numpy())]), np.frombuffer(data.as_py(), np.uint64)))
        for part, pieces in held.items():
            found = [_meet(part * each_part + b, np.concatenate([x[ends[b] : ends[b + 1]] for ends, x in pieces]), bits) for b in range(len(pieces[0][0]) - 1)]
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    senders = max(1, parts // 4)
    sent = fps.select("fp").repartition(senders, "fp").mapInArrow(emit, "part int, counts array<int>, variants binary")
    return sent.repartitionById(parts, "part").mapInArrow(match, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """Per row of docs: doc_id, sum (xxhash64 of the text), fp (signed long), fingerprint (16 hex digits),
    component_id, kept.

    component_id is the smallest doc_id reachable over links of 3 or fewer bits, kept marks one row of each component
    (also where ids repeat; null ids come last). Rows without words have fingerprint zero and link like any other.
    Other columns are ignored.
    """
    rows = work_table(fingerprints(docs, id_col, text_col, words_per_shingle).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    found = work_table(links(work_table(rows.select("fp").distinct(), "distinct")), "near")
    return _grouped(rows, components(found, "a", "b")).select(
        "doc_id", "sum", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")


def _grouped(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds component_id and kept to rows (doc_id, sum, fp, row), under components (node, root) of values of fp."""
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    by_fp = rows.groupBy("fp").agg(least, F.count("*").alias("n")).join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by_fp = work_table(by_fp.where(F.col("n").isNotNull()), "classes")
    tops = work_table(by_fp.groupBy("root").agg(F.min("first").alias("top"), F.sum("n").alias("n")).where("n > 1"), "tops")
    named = work_table(by_fp.select("fp", "root").join(tops, "root").select("fp", F.col("top.doc_id").alias("top_id"), F.col("top.row").alias("top_row")), "named")
    all_rows = rows.join(named, "fp", "left")
    alone = F.col("top_row").isNull()
    return all_rows.select(
        "doc_id", "sum", "fp",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("top_row"))).alias("kept"))


def shingles(text: str | None, words_per_shingle: int = 5) -> set[bytes]:
    """The shingles of a text, words lower-cased and one space apart; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + words_per_shingle]) for i in range(max(1, len(words) - words_per_shingle + 1))}


_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)


def _hashes(text: str | None, words_per_shingle: int) -> np.ndarray:
    return np.array(sorted({xxhash.xxh64_intdigest(x, SEED) for x in shingles(text, words_per_shingle)}), np.uint64)


def sketch(text: str | None, words_per_shingle: int = 5) -> tuple[int, np.ndarray, int]:
    """A digest of the shingle set (signed), its BANDS short fingerprints (signed, one number space for each), and its size."""
    h = _hashes(text, words_per_shingle)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 1 << 10):
        least = np.minimum(least, (h[at : at + (1 << 10), None] * (_DRAWS[0] | np.uint64(1)) + _DRAWS[1]).min(axis=0))
    bands = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63), np.array(bands, np.uint64).view(np.int64), len(h)


def _sketches(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """(doc_id, sum, fp, bands, n, sim), fp being the digest of the shingle set, n its size and sim the 64-bit fingerprint
    (signed); one row per row of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(*sketch(x.as_py(), words_per_shingle), fingerprint(x.as_py(), words_per_shingle)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _, _, _ in made], pa.int64()), pa.array([x for _, x, _, _ in made], pa.list_(pa.int64())), pa.array([x for _, _, x, _ in made], pa.int64()), pa.array(np.array([x for _, _, _, x in made], np.uint64).view(np.int64))],
                ["doc_id", "sum", "fp", "bands", "n", "sim"])
            del made
            pa.default_memory_pool().release_unused()

    return docs.select(id_col, F.xxhash64(text_col), text_col).mapInArrow(each, f"doc_id {kind}, sum long, fp long, bands array<long>, n long, sim long")


def _ball(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of shingle sets (fp) whose fingerprints (sim) differ in 3 bits or fewer: the least set of each
    fingerprint with those of the fingerprints it links to, and with the others of its own."""
    sets = rows.select("fp", "sim").distinct()
    least = work_table(sets.groupBy("sim").agg(F.min("fp").alias("least")), "least")
    own = sets.join(least, "sim").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    found = links(least.select(F.col("sim").alias("fp")))
    for k in "ab":
        found = found.join(least.select(F.col("sim").alias(k), F.col("least").alias(f"set_{k}")), k)
    return own.unionByName(found.where("set_a <> set_b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts (fp, text) have a Jaccard similarity of SIMILAR or more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = shingles(x.as_py(), words_per_shingle), shingles(y.as_py(), words_per_shingle)
                both = len(x & y)
                alike.append(both >= SIMILAR * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))
            pa.default_memory_pool().release_unused()

    left, right = (texts.select(F.col("fp").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(each, "a long, b long")


def _met(tile: pa.Table, words_per_shingle: int) -> pa.Table:
    """Links (a, b) of a tile: each pair of its sides (of one block with itself, each two members) is tried in the tile of
    the first short fingerprint that the two share, unless they are connected. Links that connect nothing new are left out."""
    band, right = tile["band"][0].as_py(), tile["later"].to_numpy()
    fp, size, root = tile["fp"].to_numpy(), tile["n"].to_numpy(), tile["root"].to_numpy().copy()
    bands = pc.list_flatten(tile["bands"]).to_numpy().reshape(len(fp), -1)
    sets = [_hashes(x.as_py(), words_per_shingle) for x in tile["text"]]
    alone = not right.any()
    left = np.arange(len(fp)) if alone else np.flatnonzero(~right)
    flat, owner = np.concatenate([sets[i] for i in left]), np.repeat(left, [len(sets[i]) for i in left])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    links = []
    for b in left if alone else np.flatnonzero(right):
        some = left[left < b] if alone else left
        some = some[(root[some] != root[b]) & (np.minimum(size[some], size[b]) >= SIMILAR * np.maximum(size[some], size[b]))]
        same = bands[some] == bands[b]
        some = some[bands[b, same.argmax(axis=1)] == band] if len(some) else some
        if not len(some):
            continue
        low, high = np.searchsorted(flat, sets[b]), np.searchsorted(flat, sets[b], "right")
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(owner[at], minlength=len(fp))[some]
        for a in some[both >= SIMILAR * (size[some] + size[b] - both)]:
            if root[a] != root[b]:
                root[root == root[a]] = root[b]
                links.append((fp[a], fp[b]))
    return pa.table({k: pa.array([x[i] for x in links], pa.int64()) for i, k in enumerate("ab")})


def _in_groups(sets: DataFrame, roots: DataFrame, texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """Links (a, b) between members of one group (sets (fp, bands, n) that share a short fingerprint) that are SIMILAR and
    not connected yet under roots (node, root): every such pair is tried.

    Members stand in the order of their sizes, in blocks of bounded sizes; two blocks meet in a tile where the sizes of
    their members allow the similarity. So memory is bounded, and only pairs of several components in a group take time.
    Groups of three or fewer have been tried in full before.
    """
    rooted = sets.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sent = rooted.select("fp", "n", "root", F.explode("bands").alias("band"))
    mixed = sent.groupBy("band").agg(F.count("*").alias("k"), F.min("root").alias("low"), F.max("root").alias("high")).where("k > 3 and low < high").select("band")
    weight = F.greatest("n", F.lit(SHINGLES_IN_BLOCK // MEMBERS_IN_BLOCK))
    dealt = sent.join(mixed, "band").withColumn("block", F.floor((F.sum(weight).over(Window.partitionBy("band").orderBy("n", "fp")) - weight) / SHINGLES_IN_BLOCK))
    dealt = work_table(dealt, "members")
    blocks = dealt.groupBy("band", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = (blocks.select("band", F.col("block").alias(k), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}")) for k in "ij")
    tiles = one.join(two, "band").where((F.col("i") <= F.col("j")) & (F.col("high_i") >= F.col("low_j") * SIMILAR)).select("band", "i", "j")
    sides = [dealt.join(tiles.where(when).withColumn("block", F.col(k)), ["band", "block"]).withColumn("later", F.lit(k == "j")) for k, when in (("i", "true"), ("j", "i < j"))]
    met = sides[0].unionByName(sides[1]).drop("block").join(sets.select("fp", "bands"), "fp").join(texts, "fp")
    return met.groupBy("band", "i", "j").applyInArrow(lambda tile: _met(tile, words_per_shingle), "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """Per row of docs: doc_id, sum, fp (digest of the shingle set), component_id, kept, as near_groups, under links
    between texts whose shingle sets have a Jaccard similarity of SIMILAR or more.

    Texts whose fingerprints link in the ball are candidates, and any two texts that share a short fingerprint. First each
    text is tried with the least of all its groups, then with the least and its neighbour in each group, and then every
    pair of a group that these links don't connect: each link is real, and no candidate stays untried that could connect
    more.
    """
    made = _sketches(docs, id_col, text_col, words_per_shingle).withColumn("row", F.monotonically_increasing_id())
    rows = work_table(made, "sketches")
    order = Window.partitionBy("band").orderBy("fp")
    sets = work_table(rows.select("fp", "bands", "n").dropDuplicates(["fp"]), "sets")
    sent = sets.select("fp", F.explode("bands").alias("band"))
    met = sent.select(F.col("fp").alias("a"), F.first("fp").over(order).alias("hub"), F.lag("fp").over(order).alias("prev")).where("prev is not null")
    tried = work_table(met.groupBy("a", "hub", "prev").count().drop("count"), "tried")
    first = work_table(tried.groupBy("a").agg(F.min("hub").alias("b")), "first")

    ball = work_table(_ball(rows), "ball")

    used = tried.select("a").union(tried.select("hub")).union(tried.select("prev")).union(ball.select("a")).union(ball.select("b")).distinct().withColumnRenamed("a", "fp")
    one = rows.groupBy("fp").agg(F.min("sum").alias("sum")).join(used, "fp")
    text = docs.select(F.xxhash64(text_col).alias("sum"), F.col(text_col).alias("text"))
    texts = work_table(text.join(one, "sum").dropDuplicates(["fp"]).select("fp", "text"), "texts")

    found = work_table(_confirmed(first, texts, words_per_shingle), "found")
    under = found.select(F.col("a").alias("node"), F.col("b").alias("top"))
    rest = tried.select("a", F.explode(F.array("hub", "prev")).alias("b")).union(ball).distinct()
    for k in "ab":
        rest = rest.join(under.select(F.col("node").alias(k), F.col("top").alias(f"top_{k}")), k, "left").withColumn(f"top_{k}", F.coalesce(f"top_{k}", k))
    rest = work_table(rest.where("top_a <> top_b").select("a", "b").join(first, ["a", "b"], "left_anti"), "rest")
    near = work_table(found.unionByName(_confirmed(rest, texts, words_per_shingle)), "near")
    roots = components(near, "a", "b")
    more = work_table(_in_groups(sets, roots, texts, words_per_shingle), "more")
    return _grouped(rows, roots if more.isEmpty() else components(near.unionByName(more), "a", "b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each component of texts that are SIMILAR or more."""
    return keep_rows(docs, similar_groups(docs, id_col, text_col, words_per_shingle), id_col, text_col)
