"""Token ids in grammar-compressed shard files, written and read by Spark.

Documents are dealt out by ascending id; each task encodes its own, appends the end id and cuts shards of a bounded
number of ids. A shard is compressed by Re-Pair: frequent pairs of neighbouring symbols are replaced by nonterminals,
again and again, until no pair is frequent. The file holds the rules, the length of what each of them expands to, and
every document's number of ids and symbols, so one document, or any range of ids, is decoded without the rest.

Layout of a file (little-endian): magic, width in bytes of a symbol, first nonterminal, numbers of rules, documents and
symbols; then the rules (two symbols each), their expansion lengths (4 bytes each), ids of each document, symbols of each
document (4 bytes each), and the symbols. Files are values of a binary column, so that any store that Spark reads and
writes can hold them.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import shared_folder, small_batches

#: Ids from which a shard is full (a document is never divided), the count from which a pair is frequent, and how far
#: below the most frequent pair's count a pair may lie to be replaced in the same round.
SHARD_IDS, LEAST, TOGETHER = 1 << 18, 16, 32
#: Distinct pieces, and parts cut by the library, of one generation of a worker's memory; it holds two of them.
REMEMBERED, WIDE = 1 << 19, 1 << 16
#: Bytes of text from which documents are encoded together, and pieces that are looked up together.
GROUP, BLOCK = 1 << 22, 1 << 20
_MAGIC, _HEAD = b"RPR1", "<4sBxxxIIII"
#: Characters up to U+024F, and beyond it usual punctuation, Greek, Cyrillic, kana, Chinese and Hangul: numbers, white
#: space, and what else is no letter; the rest of them are letters.
_N, _S = "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_O = r"\0-\x08\x0e-\x1f!-/:-@\[-`{-\x84\x86-\x9f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7"
_SIGNS = r"\u200b-\u2027\u202a-\u202e\u2030-\u205e\u20a0-\u20bf\u3001-\u3003\u3008-\u3011\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
_LETTERS = r"\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03f5\u0400-\u0481\u048a-\u0523\u3041-\u3096\u30a1-\u30fa\u30fc-\u30fe\u4e00-\u9fa5\uac00-\ud7a3"
_O += _SIGNS
_L = f"^{_N}{_S}{_O}"
# Fixed value: the pre-tokenisation of byte-level BPE, here for these characters only.
_PIECE = re.compile(f" [{_L}]+|[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[{_O}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WIDE = re.compile(rf"[^\0-\u024f{_SIGNS}{_LETTERS}]")
_BORDER = re.compile(r"(?<=\S)(?=[ \n]\S)")
# Fixed value: the characters that stand for bytes in byte-level BPE.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _SHOWN)}
#: Bits of the slots by which pairs are counted first.
_SLOTS = 18


class Memory(dict):
    """Values by key, made on demand. When it is full its entries become the older generation; what is asked for again
    comes back from there, and what is not is gone with the next change."""

    def __init__(self, make: Callable[[str], object], most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) <= 32:
            self[key] = got
        return got


class Encoder:
    """Ids of whole texts as little-endian 4-byte integers, by the tokenizer library's model; strings of special tokens
    are ordinary text.

    Texts of usual characters are cut into pieces by a pattern, words with others by the library: a space or a line feed
    between two characters that are no white space always starts a new piece, so what such borders part is cut on its
    own. The pieces of many texts are looked up together, each distinct one once.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        cut, self.size, tokenize = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.get_vocab_size(), tokenizer.model.tokenize
        self.wide = Memory(lambda part: [part[i:j] for _, (i, j) in cut(part)], WIDE)
        self.ids = Memory(lambda piece: array("I", [t.id for t in tokenize(piece.encode().decode("latin-1").translate(_BYTES))]).tobytes(), REMEMBERED)

    def pieces(self, text: str) -> list[str]:
        if not _WIDE.search(text):
            return _PIECE.findall(text)
        return [x for part in _BORDER.split(text) for x in (self.wide[part] if _WIDE.search(part) else _PIECE.findall(part))]

    def block(self, pieces: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of pieces one after the other, and the number of ids of each."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        known = [self.ids[x] for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        at = np.repeat((np.cumsum(sizes) - sizes)[codes] - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(known), "<u4")[at].tobytes(), n

    def __call__(self, texts: list[str]) -> list[bytes]:
        pieces, ends = [], [0]
        for text in texts:
            pieces += self.pieces(text)
            ends.append(len(pieces))
        blocks = [self.block(pieces[i : i + BLOCK]) for i in range(0, len(pieces), BLOCK)]
        ids = b"".join([x for x, _ in blocks])
        bounds = 4 * np.cumsum(np.concatenate([[0], *[n for _, n in blocks]]))[ends]
        return [ids[i:j] for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


def encoder(path: str) -> Encoder:
    """The encoder of a file: one in each Python worker, with its memory of pieces, for all tasks that it runs."""
    held = vars(sys.modules.setdefault("squadframe_worker_memory", ModuleType("squadframe_worker_memory")))
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def _frequent(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur `least` times, most frequent first, and their counts."""
    ordered = np.sort(code)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(starts, len(code)))
    some = np.flatnonzero(counts >= least)
    best = some[np.argsort(-counts[some], kind="stable")]
    return ordered[starts[best]], counts[best]


def grammar(ids: np.ndarray, first: int, end: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n, 2), the lengths they expand to, and the symbols that stand for ids. Nonterminals count from `first`.

    A round counts the pairs and replaces the most frequent one together with those nearly as frequent; where two of
    them overlap the more frequent one is taken, in runs of one symbol every second. No pair starts with the end id, so
    a document's symbols are its own. It ends when no pair is replaced `least` times.
    """
    seq = ids.astype(np.uint32)
    rules, lengths = [np.zeros((0, 2), np.int64)], np.ones(first, np.int64)
    # where a frequent pair can start: of older symbols none becomes frequent that was not, as pairs only lose places
    open_ = np.ones(len(seq), bool)
    while len(seq) > 1:
        at = np.flatnonzero(open_[:-1])
        a, b = seq[at], seq[at + 1]
        # pairs in a slot with fewer than `least` are not frequent, which is looked at if it can spare much; the others are counted one by one
        slot = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))) >> np.uint32(32 - _SLOTS)
        some = np.flatnonzero(((np.bincount(slot, minlength=1 << _SLOTS) >= least)[slot] if len(at) >> (_SLOTS - 4) else True) & (a != end))
        at, slot = at[some], slot[some]
        if not len(at):
            break
        open_[:] = False
        open_[at] = True
        code = a[some].astype(np.uint64) << np.uint64(32) | b[some]
        found, counts = _frequent(code, least)
        chosen = found[counts >= counts[0] // TOGETHER] if len(found) else found
        none = len(chosen)
        # a table from slots to ranks; of pairs that share a slot the most frequent one is replaced now
        table = np.full(1 << _SLOTS, none, np.int32)
        own = (((chosen >> np.uint64(32)).astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (chosen.astype(np.uint32) * np.uint32(0x85EBCA77))) >> np.uint32(32 - _SLOTS)
        table[own[::-1]] = np.arange(none - 1, -1, -1)
        rank = table[slot]
        hit = np.flatnonzero(rank < none)
        hit = hit[chosen[rank[hit]] == code[hit]]
        at, rank = at[hit], rank[hit]
        beside = np.diff(at) == 1
        left, right = np.full(len(at), none), np.full(len(at), none)
        left[1:][beside], right[:-1][beside] = rank[:-1][beside], rank[1:][beside]
        kept = (rank <= left) & (rank <= right)
        at, rank = at[kept], rank[kept]
        # neighbours of one rank are a run of one symbol: every second place of it
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        kept = (np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0
        at, rank = at[kept], rank[kept]
        good = np.bincount(rank, minlength=none) >= max(2, least // 2)
        if not good.any():
            break
        kept = good[rank]
        at, rank = at[kept], rank[kept]
        pairs = np.stack([chosen[good] >> np.uint64(32), chosen[good] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64)
        seq[at] = (len(lengths) + np.cumsum(good) - 1)[rank]
        rules.append(pairs)
        lengths = np.concatenate([lengths, lengths[pairs].sum(axis=1)])
        open_[at] = open_[at[at > 0] - 1] = True
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        seq, open_ = seq[kept], open_[kept]
    return np.concatenate(rules), lengths[first:], seq


def pack(documents: list[bytes], first: int, end: int, least: int = LEAST) -> bytes:
    """The file of documents whose ids (4 bytes each) end with the end id."""
    sizes = np.array([len(d) // 4 for d in documents], np.int64)
    rules, lengths, seq = grammar(np.frombuffer(b"".join(documents), "<u4"), first, end, least)
    ends = np.searchsorted(np.cumsum(np.concatenate([np.ones(first, np.int64), lengths])[seq]), np.cumsum(sizes)) + 1
    width = max(1, (int(first + len(rules)).bit_length() + 7) // 8)
    narrow = lambda x: x.astype("<u4").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
    head = struct.pack(_HEAD, _MAGIC, width, first, len(rules), len(sizes), len(seq))
    return b"".join([head, narrow(rules.ravel()), lengths.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), np.diff(ends, prepend=0).astype("<u4").tobytes(), narrow(seq)])


class ShardFile:
    """A file opened for reading: the rules are expanded once, documents and ranges of ids on demand."""

    def __init__(self, data: bytes):
        magic, width, self.first, n_rules, n_docs, n_symbols = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a shard file")
        at = struct.calcsize(_HEAD)

        def wide(n: int) -> np.ndarray:
            nonlocal at
            out = np.zeros((n, 4), np.uint8)
            out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
            at += n * width
            return out.view("<u4").ravel().astype(np.int64)

        def numbers(n: int) -> np.ndarray:
            nonlocal at
            at += 4 * n
            return np.frombuffer(data, "<u4", n, at - 4 * n).astype(np.int64)

        self.rules, lengths = wide(2 * n_rules).reshape(-1, 2), numbers(n_rules)
        self.sizes, self.symbols_of = numbers(n_docs), numbers(n_docs)
        self.symbols = wide(n_symbols)
        self.lengths = np.concatenate([np.ones(self.first, np.int64), lengths])
        # what the rules expand to, one after the other: every pass replaces the nonterminals by their rules
        flat = np.arange(self.first, self.first + n_rules)
        while (deep := flat >= self.first).any():
            out = np.repeat(flat, 1 + deep)
            left = np.flatnonzero(deep) + np.arange(int(deep.sum()))
            out[left], out[left + 1] = self.rules[flat[deep] - self.first].T
            flat = out
        self.pool = np.concatenate([np.arange(self.first), flat])
        self.starts = np.concatenate([np.arange(self.first), self.first + np.cumsum(lengths) - lengths])
        self.doc_ends, self.symbol_ends = np.cumsum(self.sizes), np.cumsum(self.symbols_of)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.starts[symbols] - ends + n, n) + np.arange(int(n.sum()))].astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.symbol_ends[k] - self.symbols_of[k] : self.symbol_ends[k]])

    def between(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the file, out of the symbols that cover them."""
        ends = np.cumsum(self.lengths[self.symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop) + 1
        skip = start - (ends[a - 1] if a else 0)
        return self.expand(self.symbols[a:b])[skip : skip + max(0, stop - start)]


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches together until they have that many bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def write_files(docs: DataFrame, path: str, to: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, least: int = LEAST) -> None:
    """Writes the files of docs below the folder `to` as rows (part, shard, in_part, doc_ids, n_ids, file);
    in_part counts the ids before the file in its part.

    Files of a part and parts follow each other in ascending order of the ids (nulls first; rows with equal ids in any
    order). path names a tokenizer file of the tokenizers library. Every text is encoded whole, null and empty ones have
    the end id only, repeated rows are documents of their own; other columns are ignored. A file holds whole documents:
    as many as have shard_ids ids, or one longer one.
    """
    small_batches(docs.sparkSession, 64)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard, done = encoder(path), TaskContext.get().partitionId(), 0, 0
        names, held, size, id_type = [], [], 0, None

        def batch() -> pa.RecordBatch:
            ids = pa.array([pa.array(names, id_type).to_pylist()], pa.list_(id_type))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([done], pa.int64()), ids, pa.array([size // 4], pa.int64()), pa.array([pack(held, encode.size, end_id, least)], pa.binary())],
                ["part", "shard", "in_part", "doc_ids", "n_ids", "file"])

        for group in _groups(batches, GROUP):
            id_type = group.schema.field(0).type
            texts = group.column(1).to_numpy().tolist()
            for name, ids in zip(group.column(0).to_pylist(), encode([x or "" for x in texts]), strict=True):
                ids += end
                if held and size + len(ids) > 4 * shard_ids:
                    yield batch()
                    names, held, size, shard, done = [], [], 0, shard + 1, done + size // 4
                names.append(name)
                held.append(ids)
                size += len(ids)
        if held:
            yield batch()

    rows.mapInArrow(each, f"part int, shard int, in_part long, doc_ids array<{kind.simpleString()}>, n_ids long, file binary").write.parquet(to)


def read_files(spark, at: str) -> DataFrame:
    """The files below a folder with the position of each one's first id among all: (part, shard, start, doc_ids, n_ids, file)."""
    files = spark.read.parquet(at)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row of two numbers for each task that wrote, so one task adds them up and they are broadcast
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("at_part"))
    placed = files.join(F.broadcast(parts), "part").withColumn("start", F.col("at_part") + F.col("in_part"))
    return placed.select("part", "shard", "start", "doc_ids", "n_ids", "file")


def documents(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens (with the end id), ids_crc32, and its ids if asked for."""
    small_batches(files.sparkSession, 8)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, names, data in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                file = ShardFile(data.as_py())
                ids = memoryview(file.expand(file.symbols).tobytes())
                ends = file.doc_ends.tolist()
                parts = [ids[4 * i : 4 * j] for i, j in zip([0, *ends], ends, strict=False)]
                columns = [names.values, pa.array(start + file.doc_ends - file.sizes), pa.array(file.sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(p) for p in parts], pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return files.select("start", "doc_ids", "file").mapInArrow(each, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def ids_between(files: DataFrame, start: int, stop: int) -> DataFrame:
    """Ids start to stop - 1 of the whole sequence, as rows (start, ids): of each file that they touch its part of them.

    Only those files are decoded, and of them only the symbols that cover the range.
    """
    small_batches(files.sparkSession, 8)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                low, high = max(start, at), min(stop, at + n)
                ids = ShardFile(data.as_py()).between(low - at, high - at).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([ids], pa.binary())], ["start", "ids"])

    inside = files.where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return inside.select("start", "n_ids", "file").mapInArrow(each, "start long, ids binary")


def new_folder(spark) -> str:
    """A new folder for files among the shared ones."""
    return f"{shared_folder(spark)}/work/token-files-{uuid.uuid4().hex}"
