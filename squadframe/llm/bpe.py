"""Byte-level BPE encoding and decoding with overlapping chunks.

Long texts are dealt out in overlapping chunks and pre-tokenised in parallel. A left-to-right scan depends only on
where it starts, so two scans that share a boundary agree from there on: each chunk is taken from the first boundary
that it has in common with the chunk before it. The stitched pieces are then encoded by rank. Decoding concatenates
the ids' raw bytes. Ids travel as little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Characters of a chunk and of the overlap with the next, in which boundaries must resynchronise.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Characters beyond a piece that can matter to it (a lookahead, the rest of a contraction), plus one.
AHEAD = 3
#: Distinct pieces of one generation of a task's memory; it holds two of them.
REMEMBERED = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of neighbours with the lowest rank is joined first, the leftmost at equal rank.

    Candidates wait in a heap, so a piece of n bytes takes n log n steps.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if j in (0, n) or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """Piece to its ids as bytes, filled on demand.

    When it is full, its pieces become the older generation; what is asked for again comes back from there, and what
    is not asked for is gone with the next change.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = got
        return got


_known: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    """One memory for each Python worker and vocabulary."""
    if path not in _known:
        _known[path] = Pieces(read_ranks(path))
    return _known[path]


def _ids(path: str, pattern: str, text: str, upto: int | None = None) -> bytes:
    """Ids of the text, or of its first `upto` characters, where a piece is known to end; the rest is context."""
    found, n = regex.findall(pattern, text), len(text)
    while upto is not None and n > upto:
        n -= len(found.pop())
    return b"".join(map(_pieces(path).__getitem__, found))


def boundaries(pattern: str, text: str, last: bool) -> list[int]:
    """Starts of the pieces. Short of the text's end those are left out that characters beyond the chunk could move:
    a piece looks at most AHEAD - 1 characters past its end."""
    found = [m.start() for m in regex.finditer(pattern, text)]
    return found if last else [b for b in found if b <= len(text) - AHEAD]


def _encode_column(docs: DataFrame, path: str, pattern: str, keys: list[str], cut: bool = False) -> DataFrame:
    """Encodes the column text, up to the column upto if cut."""
    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys) + ", ids binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ends = part.column(len(keys) + 1).to_pylist() if cut else [None] * part.num_rows
                ids = [_ids(path, pattern, x.as_py() or "", n) for x, n in zip(part.column(len(keys)), ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(ids, pa.binary())], [*keys, "ids"])

    return docs.select(*keys, "text", *["upto"] * cut).mapInArrow(each, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of docs: doc_id and ids (binary, 4 bytes each). No special tokens; null counts as empty.

    Texts of up to `chunk` characters are encoded where they are read. Longer ones go out as chunks of that length
    plus `overlap`; where a chunk has no boundary in common with the one before it (one piece longer than the
    overlap), the whole text is encoded in one piece instead, with the same result. Repeated rows stay repeated;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n = F.coalesce(F.char_length("text"), F.lit(0))
    short = _encode_column(rows.where(n <= chunk), path, pattern, ["doc_id"])

    long = rows.where(n > chunk).withColumn("row", F.monotonically_increasing_id())
    parts = (
        long.select("doc_id", "row", "text", F.posexplode(F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(chunk))).alias("part", "at"))
        .select("doc_id", "row", "part", (F.col("at") + chunk + overlap >= F.char_length("text")).alias("last"), F.substring("text", F.col("at") + 1, F.lit(chunk + overlap)).alias("text"))
        .repartition("row", "part")
    )
    fields = f"doc_id {parts.schema['doc_id'].dataType.simpleString()}, row long, part int, last boolean, text string, head array<int>, tail array<int>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for last, text in zip(batch.column(3).to_pylist(), batch.column(4), strict=True):
                found = boundaries(pattern, text.as_py(), last)
                heads.append([b for b in found if b < overlap])
                tails.append([b - chunk for b in found if b >= chunk])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*batch.schema.names, "head", "tail"])

    order = Window.partitionBy("row").orderBy("part")
    scanned = parts.mapInArrow(scan, fields)
    start = F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    stitched = scanned.withColumn("start", start).withColumn("next", F.lead("start").over(order)).withColumn("final", F.lead("part").over(order).isNull())
    stitched = stitched.withColumn("broken", F.max(F.col("start").isNull()).over(Window.partitionBy("row")))
    # the overlap of a broken text is cut off and its chunks are put together again
    whole = stitched.where("broken").select("doc_id", "row", F.lit(0).alias("part"), F.struct("part", F.substring("text", 1, chunk).alias("text")).alias("x"))
    whole = whole.groupBy("doc_id", "row", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "").alias("text")).withColumn("upto", F.char_length("text"))
    high = F.when(F.col("final"), F.char_length("text")).otherwise(F.lit(chunk) + F.col("next"))
    cut = stitched.where(~F.col("broken")).select("doc_id", "row", "part", F.substring(F.col("text"), F.col("start") + 1, high - F.col("start") + AHEAD).alias("text"), (high - F.col("start")).alias("upto"))
    coded = _encode_column(cut.unionByName(whole), path, pattern, ["doc_id", "row", "part"], cut=True)
    joined = coded.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("part", F.hex("ids").alias("ids")))).alias("all"))
    return short.unionByName(joined.select("doc_id", F.unhex(F.array_join(F.transform("all", lambda x: x["ids"]), "")).alias("ids")))


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the raw bytes of the ids (null ids: empty) as a binary column."""
    names = [c for c in coded.columns if c != out]
    schema = ", ".join(f"`{k}` {coded.schema[k].dataType.simpleString()}" for k in names) + f", `{out}` binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            tokens[i] = b
        token = tokens.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                data = [b"".join(map(token, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in part.column(names.index(ids_col))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*names, out])

    return coded.select(*names).mapInArrow(each, schema)
