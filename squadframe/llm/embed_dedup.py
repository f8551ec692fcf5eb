"""Near-duplicate embeddings by product quantisation.

Vectors of a label are dealt to the coarse cells of an inverted file; what a cell's centre leaves over is coded by
subspace. Every vector probes the cells near it, compares itself with their codes by table look-ups, and the pairs
that come near enough are checked by their exact cosine. Identical vectors are one entry with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, work_table

#: Vectors that the codebooks are fitted on (by a hash of the vector), coarse cells, subspaces and centres in each.
SAMPLE, CELLS, PARTS, CENTRES, ROUNDS = 20_000, 64, 16, 32, 8
#: A vector probes the cells whose centre is at most so much farther from it (as an angle) than its own.
PROBE_ANGLE = 0.2
#: How far the coded cosine may lie below the threshold for the exact one to be computed.
SLACK = 0.12
#: Entries of a block; two blocks meet in one task at a time.
BLOCK = 512


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of x times a power of two each (so nothing is rounded) that brings their largest entry near one: norms and
    products of the smallest and largest doubles then neither vanish nor overflow, and cosines stay the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of x by Lloyd's steps, from evenly spaced rows of x (in the order given)."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (mine := own == c).any():
                centres[c] = x[mine].mean(axis=0)
    return centres


class Index:
    """Coarse centres (unit vectors) and a codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, cells: int = CELLS, parts: int = PARTS, centres: int = CENTRES):
        x = _unit(sample.astype(np.float64))
        self.coarse = _unit(kmeans(x, cells) + 1e-9)
        rest = x - self.coarse[self.nearest(x)]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1]))
        self.books = [kmeans(rest[:, c], centres, 4) for c in self.cuts]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.coarse.T, axis=1)

    def probes(self, x: np.ndarray, angle: float) -> np.ndarray:
        """(row, cell) of all cells whose centre is within `angle` of being the nearest."""
        far = np.arccos(np.clip(x @ self.coarse.T, -1, 1))
        return np.argwhere(far <= far.min(axis=1, keepdims=True) + angle)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[cell]
        return np.stack([np.argmin((b**2).sum(1) - 2 * rest[:, c] @ b.T, axis=1) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def estimates(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Coded cosines (query, entry) of the cell: a table for each query and subspace, summed over the codes."""
        out = np.repeat((queries @ self.coarse[cell])[:, None], len(codes), axis=1)
        for c, book, k in zip(self.cuts, self.books, codes.T, strict=True):
            out += (queries[:, c] @ book.T)[:, k]
        return out


def _usable() -> Column:
    v = F.col("v")
    good = F.col("label").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def _place(found: DataFrame, indexes: dict[int, Index], probe: float) -> DataFrame:
    """Adds to the entries: own cell, codes, what coding takes from the cosine with itself (lost), and probed cells,
    each by the index of the vector's width."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(batch.schema.get_field_index("width")).to_numpy()
            for width, at in ((w, k) for w in np.unique(widths) for k in range(0, int((widths == w).sum()), 4096)):
                part = batch.take(pa.array(np.flatnonzero(widths == width)[at : at + 4096]))
                index = indexes[int(width)]
                x = _unit(np.array(part.column(part.schema.get_field_index("v")).to_pylist(), float))
                cell = index.nearest(x)
                codes = index.codes(x, cell)
                coded = index.coarse[cell].copy()
                for c, book, k in zip(index.cuts, index.books, codes.T, strict=True):
                    coded[:, c] += book[k]
                tried = index.probes(x, probe)
                cells = np.split(tried[:, 1], np.searchsorted(tried[:, 0], np.arange(1, len(x))))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(1 - np.einsum("ij,ij->i", x, coded)), pa.array([c.tolist() for c in cells], pa.list_(pa.int32()))],
                    [*part.schema.names, "cell", "codes", "lost", "probes"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(each, f"{fields}, cell int, codes binary, lost double, probes array<int>")


def _meet(indexes: dict[int, Index], threshold: float, slack: float):
    """For one block of queries and one of a cell's entries: (node, links, root).

    links adds up, over all blocks, to the weight of a node's linked neighbours; root joins what the block connects.
    """

    def each(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"node": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if queries.empty or entries.empty:
            return none
        index = indexes[int(entries["width"].iloc[0])]
        q, x = (_scaled(np.stack(f["v"].to_numpy()).astype(float)) for f in (queries, entries))
        qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        codes = np.stack([np.frombuffer(c, np.uint8) for c in entries["codes"]])
        cell = int(entries["cell"].iloc[0])
        near = index.estimates(q / qn[:, None], cell, codes) + entries["lost"].to_numpy() >= threshold - slack
        qk, xk = queries["node"].to_numpy(), entries["node"].to_numpy()
        i, j = np.nonzero(near & (qk[:, None] != xk[None, :]))
        sure = np.empty(len(i), bool)
        for at in range(0, len(i), 1 << 15):
            a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            sure[at : at + (1 << 15)] = np.einsum("ij,ij->i", q[a], x[b]) / (qn[a] * xn[b]) >= threshold
        i, j = i[sure], j[sure]
        if not len(i):
            return none
        # the entry counts the pair here too, unless its own probes lead it to the query's cell
        own = queries["own"].to_numpy()[i]
        probed = np.zeros((len(xk), int(max(own.max(), max(map(max, entries["probes"])))) + 1), bool)
        for k, cells in enumerate(entries["probes"]):
            probed[k, cells] = True
        back = ~probed[j, own]
        weight_q, weight_x = queries["n"].to_numpy(), entries["n"].to_numpy()
        nodes = np.concatenate([qk, xk])
        links = np.concatenate([np.bincount(i, weight_x[j], len(qk)), np.bincount(j[back], weight_q[i][back], len(xk))])
        root, before = nodes.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            low = np.minimum(root[i], root[len(qk) + j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, len(qk) + j, low)
        used = np.zeros(len(nodes), bool)
        used[i] = used[len(qk) + j] = True
        out = pd.DataFrame({"node": nodes, "links": links.astype("int64"), "root": root})[used]
        return out[(out["links"] > 0) | (out["node"] != out["root"])]

    return each


def near_groups(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", probe: float = PROBE_ANGLE, slack: float = SLACK, cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link at a cosine (double precision) of threshold or more, if their labels are equal and not null. Null
    and zero vectors and those with null or non-finite components link with nothing, nor do vectors of different
    lengths. n_links counts the other rows linked directly, component_id is the smallest vec_id
    reachable, kept marks vec_id = component_id. Candidates come from the quantised index, so a pair may be missed
    (see the recall in the README), but no pair below the threshold is linked; identical vectors always are. Each length
    that occurs has an index of its own, fitted on at most SAMPLE vectors, which holds all of them; cells default to the
    root of the number of distinct vectors, 16 to 1024.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    # single-precision vectors travel as they are, with half the bytes; every calculation is in double precision
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = work_table(vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).withColumn("usable", _usable()), "vectors")
    found = work_table(rows.where("usable").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "entries")
    found = found.withColumn("width", F.size("v"))
    indexes = {}
    for r in found.groupBy("width").count().collect():  # the lengths that occur
        sample = found.where(F.col("width") == r["width"]).select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()["v"]
        indexes[r["width"]] = Index(np.stack(sample).astype(float), cells or int(np.clip(np.sqrt(r["count"]), 16, 1024)))
    if not indexes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    placed = work_table(_place(found, indexes, probe), "placed")

    # blocks of a cell: by its entries and by the queries that probe it
    held = placed.groupBy("label", "width", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    asked = placed.select("label", "width", F.explode("probes").alias("cell")).groupBy("label", "width", "cell").agg(F.ceil(F.count("*") / block).alias("asked"))
    sizes = work_table(held.join(asked, ["label", "width", "cell"]), "sizes")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    keys = ["label", "width", "cell", "part", "ask"]
    entries = (
        placed.join(sizes, ["label", "width", "cell"])
        .select("label", "width", "cell", deal(F.col("blocks")).alias("part"), F.explode(F.sequence(F.lit(0), (F.col("asked") - 1).cast("int"))).alias("ask"), "node", "n", "v", "codes", "lost", "probes")
    )
    queries = (
        placed.select("label", "width", F.explode("probes").alias("cell"), F.col("cell").alias("own"), "node", "n", "v").join(sizes, ["label", "width", "cell"])
        .select("label", "width", "cell", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("part"), deal(F.col("asked")).alias("ask"), "own", "node", "n", "v")
    )
    queries = queries.toDF(*queries.columns)  # both come from one table: columns of their own
    met = work_table(queries.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(_meet(indexes, threshold, slack), "node long, links long, root long"), "met")

    roots = components(met.where("node <> root"), "node", "root")
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    named = work_table(found.select("label", "v", "n", "least", "node").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    tops = work_table(named.groupBy("root").agg(F.min("least").alias("top"), F.sum("n").alias("size")).where("size > 1"), "tops")
    some = work_table(named.join(tops, "root").select(F.col("label"), F.col("v"), "top", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "linked")
    out = rows.join(some, ["label", "v"], "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("top"))
    return out.select(F.col("vec_id").cast(kind), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
