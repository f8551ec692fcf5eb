"""Sharding by a k-d tree over document metadata.

The tree is split at distributed weighted medians along the widest dimension until each leaf is one shard with its
part of the bytes. A split with k shards below it divides the bytes as k//2 to k - k//2. Medians come from histograms
that Spark aggregates and narrows step by step; the driver sees a bounded number of bins. What is placed are equal texts
together, as one point of their whole weight: only those that outweigh a shard are divided. Rows are read twice, to be
described and to be given their shard. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_offsets, work_table

#: Bins of a histogram step (12 bits), a split's error as a part of a shard's bytes, and the weight classes of points,
#: as parts of a shard's bytes, by which splits are evened out.
BIN_BITS, TOLERANCE, CLASSES = 12, 0.002, (float("inf"), 0.25, 0.05, 0.01)
_GRID, _BITS = 24, 62


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Narrow rows: doc_id, size, text_crc32, mark (a second checksum), and the dimensions d0 (share of bytes beyond one for each character), d1
    (share of spaces) and d2 (checksum). The size is no dimension: leaves of long texts only could not be made equal.
    Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = text_bytes(text)
    share = lambda part: F.when(n > 0, part / n).otherwise(F.lit(0.0))
    return docs.select(
        F.col(id_col).alias("doc_id"), (n + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("mark"),
        share(n - F.char_length(text)).alias("d0"), share(F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))).alias("d1"),
        (F.pmod(F.xxhash64(text), F.lit(1 << 20)) / float(1 << 20)).alias("d2"))


def _tie() -> Column:
    """62 bits for points in one place: parts of equal texts that outweigh a shard, and texts with equal dimensions."""
    return F.shiftrightunsigned(F.xxhash64("one", "mark", "piece"), 2)


def _beyond() -> Column:
    """Right of the cut: keys above it, and at the cut those with a tie value of so much at least."""
    return (F.col("key") > F.col("at")) | ((F.col("key") == F.col("at")) & (_tie() >= F.col("tie")))


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of numbers (one for each node of a level) as a literal table."""
    names, kinds = zip(*[c.split(" ") for c in schema.split(", ")], strict=True)
    body = ", ".join("(" + ", ".join(f"cast('{x!r}' as {k})" for x, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return spark.sql(f"select * from values {body} as t({', '.join(names)})")


def _thresholds(rows: DataFrame, wanted: dict[int, float], slack: float) -> tuple[dict[int, int], dict[int, tuple[int, float]]]:
    """For each node of rows (node, key, size) the cut with a weight of keys below it near the wanted one.

    Returns (node: cut) where that came within slack or to the nearer side of a single row, and (node: (key, weight below
    it)) where one key of several rows holds the rest. Each step divides one bin per node into 2^BIN_BITS bins, over the
    keys that it really has.
    """
    spark = rows.sparkSession
    cuts: dict[int, int] = {}
    single: dict[int, tuple[int, float]] = {}
    open_ = {n: (0, (1 << _BITS) - 1, 0.0) for n in wanted}  # the keys' range and the weight below it
    while open_:
        ranges = [(n, low, top, max(0, (top - low).bit_length() - BIN_BITS)) for n, (low, top, _) in open_.items()]
        inside = rows.join(F.broadcast(_values(spark, ranges, "node int, low long, top long, step int")), "node").where("key between low and top")
        bins = inside.groupBy("node", F.expr("shiftright(key - low, step)").alias("bin")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).collect()
        for node, (_, top, below) in list(open_.items()):
            cut = None
            for r in sorted((r for r in bins if r["node"] == node), key=lambda r: r["bin"]):
                left = wanted[node] - below
                if left > slack and left >= r["w"]:
                    below += r["w"]
                elif left <= slack or r["n"] == 1 and 2 * left < r["w"]:
                    cut = r["least"]
                    break
                elif r["w"] - left <= slack or r["n"] == 1:
                    cut = r["most"] + 1
                    break
                else:
                    break
            else:
                cut = top + 1
            if cut is not None:
                cuts[node] = cut
            elif r["least"] == r["most"]:
                single[node] = (r["least"], below)
            else:
                open_[node] = (r["least"], r["most"], below)
                continue
            del open_[node]
    return cuts, single


#: What names a point.
_POINT = ["one", "text_crc32", "mark", "piece"]


def _points(rows: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The rows with the point that each belongs to, and the points with their weight as size.

    Equal texts (by size and two checksums; others that agree in these only stay together too) are one point. Those that
    outweigh a shard's share, fewer than there are shards, are divided by row into parts of half a share.
    """
    named = rows.withColumnRenamed("size", "one")
    most = named.groupBy("one", "text_crc32", "mark").agg((F.col("one") * F.count("*")).alias("w")).where(F.col("w") > share)
    parts = F.broadcast(most.select("one", "text_crc32", "mark", F.ceil(F.col("w") / (share / 2)).alias("parts")))  # fewer than the shards
    named = named.join(parts, ["one", "text_crc32", "mark"], "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    points = named.groupBy(*_POINT).agg(F.sum("one").alias("size"), *[F.first(d).alias(d) for d in ("d0", "d1", "d2")])
    return named, work_table(points, "points")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard).

    size is the text's UTF-8 bytes plus 8; shards' sums of it are near equal, as far as single texts allow it. Equal
    texts share a shard unless they outweigh one. Null ids and texts and repeated rows count like any others; with fewer
    texts than shards some stay empty. The result depends on the rows alone but for the rows of divided texts.
    """
    spark = docs.sparkSession
    described = work_table(describe(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "described")
    every = described.agg(F.sum("size")).first()[0] or 0
    placed, rows = _points(described, every / shards)
    rows = rows.withColumn("node", F.lit(0))
    own, dims = rows.columns, ("d0", "d1", "d2")
    level, scale, total = {0: shards}, None, every  # a node is named by the first of its shards
    while any(n > 1 for n in level.values()):
        found = rows.groupBy("node").agg(F.sum("size").alias("w"), F.max("size").alias("max_size"), *[F.min(d).alias(f"min_{d}") for d in dims], *[F.max(d).alias(f"max_{d}") for d in dims]).collect()
        stats = {r["node"]: r for r in found if level[r["node"]] > 1}
        heaviest = max((r["max_size"] for r in found), default=0)
        if not stats:
            break
        scale = scale or {d: (stats[0][f"max_{d}"] - stats[0][f"min_{d}"]) or 1.0 for d in dims}
        plan, wanted = [], {}
        for n, s in stats.items():
            widest = max(range(len(dims)), key=lambda i, s=s: ((s[f"max_{dims[i]}"] - s[f"min_{dims[i]}"]) / scale[dims[i]], -i))
            low = float(s[f"min_{dims[widest]}"])
            plan.append((n, widest, low, float(s[f"max_{dims[widest]}"]) - low or 1.0))
            wanted[n] = s["w"] * (level[n] // 2) / level[n]
        # 56 bits: the place in the widest dimension's range, then the checksum, so that only equal texts tie
        place = F.floor((F.array(*dims)[F.col("dim")] - F.col("low")) / F.col("span") * ((1 << _GRID) - 1)).cast("long")
        keyed = rows.join(F.broadcast(_values(spark, plan, "node int, dim int, low double, span double")), "node", "left")
        keyed = keyed.withColumn("key", F.shiftleft(place, 32).bitwiseOR(F.col("text_crc32"))).select(*own, "key")
        slack = tolerance * total / shards
        # Each class of weights is divided at a median of its own, the heaviest first: what a heavy point leaves uneven
        # the lighter ones even out.
        tops = [c * total / shards for c in CLASSES if c is CLASSES[0] or heaviest > c * total / shards]
        bounds = list(zip([*tops[1:], -1.0], [float(1 << 62), *tops[1:]], strict=True))
        inside = lambda low, high: (F.col("size") > low) & (F.col("size") <= high)
        weights = {r["node"]: r for r in rows.groupBy("node").agg(*[F.sum(F.when(inside(*b), F.col("size")).otherwise(0)).alias(f"w{k}") for k, b in enumerate(bounds)]).collect()}
        border, left = [], dict.fromkeys(wanted, 0)
        for k, (low, high) in enumerate(bounds):
            own_class = keyed.where(inside(low, high))
            rest = {n: sum(weights[n][f"w{j}"] for j in range(k, len(bounds))) for n in wanted}
            aim = {n: (wanted[n] - left[n]) * weights[n][f"w{k}"] / max(1, rest[n]) for n in wanted}
            cuts, single = _thresholds(own_class, aim, slack)
            ties: dict[int, int] = {}
            if single:
                tied = own_class.join(F.broadcast(_values(spark, [(n, at) for n, (at, _) in single.items()], "node int, key long")), ["node", "key"]).select("node", _tie().alias("key"), "size")
                ties, still = _thresholds(tied, {n: aim[n] - w for n, (_, w) in single.items()}, slack)
                ties |= {n: at + 1 for n, (at, _) in still.items()}
            found = [(n, at, 0, low, high) for n, at in cuts.items()] + [(n, at, ties[n], low, high) for n, (at, _) in single.items()]
            if k + 1 < len(bounds):
                at = F.broadcast(_values(spark, found, "node int, at long, tie long, above double, upto double"))
                for r in own_class.join(at, "node").where(~_beyond()).groupBy("node").agg(F.sum("size").alias("w")).collect():
                    left[r["node"]] += r["w"]
            border += found
        cut = F.broadcast(_values(spark, border, "node int, at long, tie long, above double, upto double"))
        same = (keyed["node"] == cut["node"]) & (F.col("size") > F.col("above")) & (F.col("size") <= F.col("upto"))
        right = F.lit(None)
        for n in wanted:
            right = F.when(keyed["node"] == n, n + level[n] // 2).otherwise(right)
        # written level by level: every level then runs the same short plan
        rows = keyed.join(cut, same, "left").select(*[keyed[c] for c in own if c != "node"], F.when(_beyond(), right).otherwise(keyed["node"]).alias("node"))
        rows = work_table(rows, "level")
        level = {m: k for n, c in level.items() for m, k in (((n, c // 2), (n + c // 2, c - c // 2)) if c > 1 else ((n, c),))}
    placed = placed.join(rows.select(*_POINT, F.col("node").alias("shard")), _POINT).select("doc_id", F.col("one").alias("size"), "text_crc32", "shard")
    return running_offsets(placed, "shard", ["doc_id", "text_crc32", "size"], F.lit(1), "slot", buckets=128)
