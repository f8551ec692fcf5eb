"""Exact deduplication by content-defined chunk recipes.

Texts are cut where a rolling hash of their bytes says so; a document becomes the ordered list of its chunks'
identifiers. Chunk bytes move once, to be deduplicated and verified: a digest that stands for two different chunks is
found there, and its chunks are then told apart by their bytes. After that only the lists are compared.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, small_batches, work_table

#: Chunk sizes in bytes: least, usual (a power of two beyond the least) and most.
LEAST, USUAL, MOST = 512, 2048, 16384
#: Colliding digests up to this number go to the tasks as a set; beyond, every identifier carries its chunk's bytes.
COLLISIONS = 10_000
_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)
_RUN = re.compile(b"  +")
_BLOCK = 1 << 20
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with each run of white space as one space; null counts as empty."""
    return _RUN.sub(b" ", (text or "").encode().translate(_BLANK))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks, the last one being len(data); nothing for empty data. Memory is bounded for any length."""
    ends, last, n = [], 0, len(data)
    if n > LEAST:
        raw = np.frombuffer(data, np.uint8)
        for at in range(0, n, _BLOCK):
            low = max(0, at - 31)
            h = _GEAR[raw[low : at + _BLOCK]]
            for k in (1, 2, 4, 8, 16):
                h[k:] += h[:-k] << np.uint32(k)
            for c in (np.flatnonzero((h[at - low :] >> np.uint32(32 - (USUAL.bit_length() - 1))) == 0) + at + 1).tolist():
                while c - last > MOST:
                    last += MOST
                    ends.append(last)
                if c - last >= LEAST:
                    last = c
                    ends.append(c)
        while n - last > MOST:
            last += MOST
            ends.append(last)
    return ends + [n] if last < n else ends


def recipe(data: bytes, bits: int = 128, told_apart: frozenset[bytes] | None = frozenset()) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """The document's identifier list as bytes, and its (digest, chunk) pairs.

    A chunk whose digest is in told_apart (None: every chunk) is identified by its bytes instead.
    """
    ids, chunks, low = [], [], 0
    for high in cuts(data):
        chunk = data[low:high]
        digest = (xxhash.xxh3_128_intdigest(chunk) >> (128 - bits)).to_bytes(16, "big")
        ids.append(b"\1" + struct.pack("<I", len(chunk)) + chunk if told_apart is None or digest in told_apart else b"\0" + digest)
        chunks.append((digest, chunk))
        low = high
    return b"".join(ids), chunks


def _chunk_table(docs: DataFrame, bits: int) -> DataFrame:
    """(digest, chunk) of every chunk of the texts in the first column."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                for pair in recipe(normalised(text.as_py()), bits)[1]:
                    rows.append(pair)
                    held += len(pair[1])
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], ["digest", "chunk"])
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], ["digest", "chunk"])

    return docs.mapInArrow(each, "digest binary, chunk binary")


def _recipe_table(docs: DataFrame, bits: int, told_apart: frozenset[bytes] | None) -> DataFrame:
    """(doc_id, sum, recipe, text_sha256) of (doc_id, text, sum)."""
    kind = docs.schema[0].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sums = [], []
            for text in batch.column(1):
                data = normalised(text.as_py())
                lists.append(recipe(data, bits, told_apart)[0])
                sums.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lists, pa.binary()), pa.array(sums, pa.string())], ["doc_id", "sum", "recipe", "text_sha256"])

    return docs.mapInArrow(each, f"doc_id {kind}, sum long, recipe binary, text_sha256 string")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256, sum (xxhash64 of the text).

    Texts are equal when identical after replacing each run of white space by one space; null counts as empty, and
    empty texts form a group like any other. keep_id is the smallest id of the group (nulls last); one row of a group
    is kept, also where ids repeat or are null. Other columns are ignored. bits shortens the digests (for tests).
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("sum"))
    shared = (
        _chunk_table(rows.select("text"), bits).distinct()
        .groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    )
    seen = shared.limit(COLLISIONS + 1).collect()  # expected to be none of 2^128
    told_apart = None if len(seen) > COLLISIONS else frozenset(bytes(r[0]) for r in seen)
    lists = work_table(_recipe_table(rows, bits, told_apart).withColumn("row", F.monotonically_increasing_id()), "recipes")
    groups = work_table(
        lists.groupBy("recipe")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("recipe", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"), "group_size"),
        "groups")
    found = lists.join(groups, "recipe", "left")
    return found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("first_row"))).alias("kept"),
        "text_sha256", "sum")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts."""
    return keep_rows(docs, duplicate_groups(docs, id_col, text_col), id_col, text_col)
