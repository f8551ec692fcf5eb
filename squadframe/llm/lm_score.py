"""Language-model scores by subword lattice likelihood.

A word is spelled by the pieces of an existing subword vocabulary in every possible way; a forward recursion in log
space adds up all segmentations. Piece weights start from the vocabulary's own ranks and are re-estimated once from
the expected piece counts of all training words. On top of the pieces the lattice has one arc for each whole word that
training has seen, with its discounted relative frequency, in each of a few classes of documents (their languages);
a text's probability is the mixture of the classes' products. White space only separates words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, work_table

#: Classes with a mixture component of their own (the most frequent ones), the most frequent words that every task
#: holds (rarer ones are joined by a shuffle), and entries of a task's counter before it is passed on.
CLASSES, HELD_WORDS, HELD_COUNTS = 6, 100_000, 300_000
#: Pseudo-count of a piece, and how often a word new to a class is one that other classes know.
PSEUDO, KNOWN_ELSEWHERE = 0.1, 0.2
#: The end of a text, which no word can be.
END = ""
_START = "▁"


def read_pieces(path: str) -> dict[str, float]:
    """Piece to starting weight, from a SentencePiece model file: 1 / (rank + 1), bytes as the rarest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out[piece] = 1.0 / model.get_piece_size()
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and _START not in piece[1:]:
            out[piece] = 1.0 / (2.0 - model.get_score(i)) if model.get_score(i) <= 0 else 1.0
    return out


class Lattice:
    """Piece log-probabilities: pieces that start a word, and pieces or the end that go on with it."""

    def __init__(self, weights: dict[str, float], words: float):
        start = {p[1:]: w for p, w in weights.items() if p.startswith(_START)}
        inner = {p: w for p, w in weights.items() if not p.startswith(_START)}
        total, rest = sum(start.values()), sum(inner.values()) + words
        self.byte = [log(inner[f"<0x{i:02X}>"] / rest) for i in range(256)]
        self.end = log(words / rest)
        pieces = {p: log(w / rest) for p, w in inner.items() if not (p.startswith("<0x") and len(p) == 6)}
        # piece to log weight; None for what is only the beginning of a piece, so that a search knows where to stop
        self.start = dict.fromkeys(p[:k] for p in start for k in range(len(p))) | {p: log(w / total) for p, w in start.items()}
        self.inner = dict.fromkeys(p[:k] for p in pieces for k in range(1, len(p))) | pieces
        # the same as plain numbers
        self.plain_start, self.plain_inner = ({p: None if w is None else exp(w) for p, w in t.items()} for t in (self.start, self.inner))

    def forward(self, word: str) -> float:
        """Log of the sum of the weights of all ways through the word.

        Node 0 is the start, node i + 1 the place before character i; the bare start leads to node 1, the starting
        pieces and the inner pieces to their ends. Bytes spell a character that is no piece.
        """
        n, inner, start = len(word), self.inner.get, self.start.get
        a: list[float | None] = [None] * (n + 2)
        a[1] = self.start[""]
        for j in range(1, n + 1):
            w = start(word[:j], 0)
            if w == 0:
                break
            if w is not None:
                a[j + 1] = w
        for i in range(n):
            x = a[i + 1]
            if x is None:
                continue
            if inner(word[i]) is None:
                y, z = a[i + 2], x + self._bytes(word[i])
                a[i + 2] = z if y is None else max(y, z) + log1p(exp(-abs(y - z)))
            for j in range(i + 1, n + 1):
                w = inner(word[i:j], 0)
                if w == 0:
                    break
                if w is None:
                    continue
                y, z = a[j + 1], x + w
                if y is None:
                    a[j + 1] = z
                elif y > z:
                    a[j + 1] = y + log1p(exp(z - y))
                else:
                    a[j + 1] = z + log1p(exp(y - z))
        return a[-1]

    def _bytes(self, c: str) -> float:
        return sum(self.byte[b] for b in c.encode())

    def log_probability(self, word: str) -> float:
        """Natural log of the sum over all segmentations."""
        return self.forward(word) + self.end

    def expected(self, word: str, times: float, into: Counter) -> None:
        """Adds times the expected number of uses of each piece in the word."""
        n, inner, start = len(word), self.plain_inner.get, self.plain_start.get
        a, b = [1.0] + [0.0] * (n + 1), [0.0] * (n + 1) + [1.0]
        a[1] = self.plain_start[""]
        ways = [(0, 1, a[1], _START)]
        for j in range(1, n + 1):
            w = start(word[:j], 0)
            if w == 0:
                break
            if w is not None:
                a[j + 1] += w
                ways.append((0, j + 1, w, _START + word[:j]))
        for i in range(1, n + 1):
            x = a[i]
            if not x:
                continue
            if inner(word[i - 1]) is None:
                w = exp(self._bytes(word[i - 1]))
                a[i + 1] += x * w
                ways.append((i, i + 1, w, None))
            for j in range(i, n + 1):
                piece = word[i - 1 : j]
                w = inner(piece, 0)
                if w == 0:
                    break
                if w is not None:
                    a[j + 1] += x * w
                    ways.append((i, j + 1, w, piece))
        if a[-1] < 1e-280:  # a word too long for plain numbers: by halves
            self.expected(word[: n // 2], times, into)
            self.expected(word[n // 2 :], times, into)
            return
        scale = times / a[-1]
        for i, j, w, piece in reversed(ways):
            way = w * b[j]
            b[i] += way
            if piece is not None:
                into[piece] += a[i] * way * scale
            else:
                for byte in word[i - 1].encode():
                    into[f"<0x{byte:02X}>"] += a[i] * way * scale


def _flush(counts: dict, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    rows = [(*(k if isinstance(k, tuple) else (k,)), *(v if isinstance(v, list) else [v])) for k, v in counts.items()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def count_words(docs: DataFrame, classes: list[str | None]) -> DataFrame:
    """Word counts of docs (text, class, learn): word, seen (in any row), known (in rows to learn from), and n0.. by
    class. Null texts are empty; every row has one END. Tasks add up before they pass on, in bounded memory."""
    place = {c: i for i, c in enumerate(classes)}
    k = len(classes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt: list[Counter] = [Counter() for _ in range(k + 1)]
        kinds, names = [pa.string(), pa.int32(), pa.int64()], ["word", "kind", "n"]

        def out() -> Iterator[pa.RecordBatch]:
            for i, c in enumerate(learnt):
                if c:
                    yield _flush({(w.decode(), i): n for w, n in c.items()}, names, kinds)
                    c.clear()

        for batch in batches:
            for text, name, learn in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = learnt[place.get(name, k - 1) if learn else k]
                own.update((text.as_py() or "").encode().lower().split())
                own[b""] += 1
            if sum(map(len, learnt)) > HELD_COUNTS:
                yield from out()
        yield from out()

    found = docs.select("text", "class", "learn").mapInArrow(each, "word string, kind int, n long")
    by = [F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(k)]
    return found.groupBy("word").agg(F.sum("n").alias("seen"), F.sum(F.when(F.col("kind") < k, F.col("n")).otherwise(0)).alias("known"), *by)


def estimate(words: DataFrame, weights: dict[str, float], total: int) -> Lattice:
    """One step of expectation and maximisation over all training words, from the starting weights."""
    first = Lattice(weights, sum(w for p, w in weights.items() if not p.startswith(_START)) / 3)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first.expected(word, n, found)
        if found:
            yield _flush(found, ["piece", "n"], [pa.string(), pa.float64()])

    used = words.where((F.col("known") > 0) & (F.col("word") != END)).select("word", "known").mapInArrow(each, "piece string, n double")
    counts = {r["piece"]: r["n"] for r in used.groupBy("piece").agg(F.round(F.sum("n"), 3).alias("n")).collect()}  # at most the vocabulary
    return Lattice({p: counts.get(p, 0.0) + PSEUDO for p in weights}, total + PSEUDO)


def mixed(own: np.ndarray, anywhere: np.ndarray, spelled: np.ndarray, new: float) -> np.ndarray:
    """log10 of a class's word probabilities: from its counts, from all counts, and from the spelling (natural log)."""
    counted = (1 - new) * own + new * KNOWN_ELSEWHERE * anywhere
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(counted), log(new * (1 - KNOWN_ELSEWHERE)) + spelled) / log(10)


def score(docs: DataFrame, pieces: str, held_out: int = 2, folds: int = 7, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Learns from rows whose id's crc32 modulo folds is not held_out. Tokens are the words (A-Z lower-cased) and one end
    for each text; null and empty texts have the end only. base_score is the add-one word model. Without training rows
    no word is known. class_col only names the mixture's components in training, it is no input of a score; None makes
    one component. Repeated rows and null ids count like any; other columns are ignored.
    """
    spark = docs.sparkSession
    learn = crc_remainder(F.col(id_col), folds) != held_out
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.col(class_col).cast("string") if class_col else F.lit("")).alias("class"), learn.alias("learn"))
    by_class = rows.where("learn").groupBy("class").count()
    sizes = by_class.orderBy(F.desc("count"), "class").limit(CLASSES + 1).collect()
    classes = [r["class"] for r in sizes[:CLASSES]] or [""]
    docs_in = {r["class"]: r["count"] for r in sizes[:CLASSES]}
    if len(sizes) > CLASSES:  # the rarer classes are one
        classes.append("\0rest")
        docs_in["\0rest"] = by_class.agg(F.sum("count")).first()[0] - sum(docs_in.values())
    k = len(classes)

    words = work_table(count_words(rows, classes), "words")
    sums = words.agg(F.sum("known").alias("N"), F.count(F.when(F.col("known") > 0, 1)).alias("V"), F.count(F.when(F.col("known") == 1, 1)).alias("once"), *[F.sum(f"n{i}").alias(f"N{i}") for i in range(k)], *[F.count(F.when(F.col(f"n{i}") == 1, 1)).alias(f"once{i}") for i in range(k)]).first()
    total, distinct = sums["N"] or 0, sums["V"] or 0
    lattice = estimate(words, read_pieces(pieces), total)
    n_class = [sums[f"N{i}"] or 0 for i in range(k)]
    new = [min(0.5, (sums[f"once{i}"] + 1) / (n + 1)) if n else 1.0 for i, n in enumerate(n_class)]
    trained = sum(docs_in.values())
    prior = [log((docs_in.get(c, 0) + 1) / (trained + k)) / log(10) for c in classes]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a long word's spelling is too small for plain numbers and stays a logarithm; END has none, it is only counted
            spelled = np.array([lattice.log_probability(w) if w else -700.0 for w in batch.column(0).to_pylist()])
            known = np.array(batch.column(2).to_pylist(), float)
            logs = [mixed(np.array(batch.column(3 + i).to_pylist(), float) / max(1, n_class[i]), known / max(1, total), spelled, new[i]) for i in range(k)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.log10((known + 1) / (total + distinct + 1))), *map(pa.array, logs)], ["word", "seen", "known", "base", *[f"p{i}" for i in range(k)]])

    logs_schema = ", ".join(f"p{i} double" for i in range(k))
    measured = work_table(words.select("word", "seen", "known", *[f"n{i}" for i in range(k)]).mapInArrow(measure, f"word string, seen long, known long, base double, {logs_schema}"), "measured")
    # how often a word must be seen to be held: by classes of an eighth of a power of two, as many as fit
    often = F.floor(F.log2("seen") * 8).cast("int")
    room, least = HELD_WORDS, 1 << 20
    for r in sorted(measured.groupBy(often.alias("often")).count().collect(), key=lambda r: -r["often"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["often"]
    frequent = measured.where(often >= least).drop("seen").toArrow().to_pandas()
    place = {w.encode(): i for i, w in enumerate(frequent["word"])}
    table = frequent[["base", *[f"p{i}" for i in range(k)]]].to_numpy(float)
    known = (frequent["known"] > 0).to_numpy()
    held = spark.sparkContext.broadcast((place, np.hstack([known[:, None].astype(float), table])))  # HELD_WORDS rows
    names = ["n_known", "base", *[f"p{i}" for i in range(k)]]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, table = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_tokens, added, rare, times = [], [], [], []
                for text in part.column(2):
                    counts = Counter((text.as_py() or "").encode().lower().split())
                    counts[b""] = 1
                    n_tokens.append(counts.total())
                    at_, n, missing, often = [], [], [], []
                    for w, c in counts.items():
                        i = place.get(w)
                        if i is None:
                            missing.append(w.decode())
                            often.append(c)
                        else:
                            at_.append(i)
                            n.append(c)
                    added.append(np.array(n, float) @ table[at_] if n else np.zeros(table.shape[1]))
                    rare.append(missing)
                    times.append(often)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n_tokens, pa.int64()), *map(pa.array, np.array(added).T), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                    ["doc_id", "learn", "n_tokens", *names, "rare", "times"])

    sums_schema = ", ".join(f"{x} double" for x in names)
    scanned = rows.select("doc_id", "learn", "text").mapInArrow(read, f"doc_id {kind}, learn boolean, n_tokens long, {sums_schema}, rare array<string>, times array<int>")
    scanned = work_table(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    rare = scanned.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    joined = rare.join(measured.select("word", (F.col("known") > 0).cast("double").alias("n_known"), *names[1:]), "word")
    late = joined.groupBy("row").agg(*[F.sum(F.col("n") * F.col(x)).alias(f"late_{x}") for x in names])
    both = scanned.drop("rare", "times").join(late, "row", "left")
    added = {x: F.col(x) + F.coalesce(f"late_{x}", F.lit(0.0)) for x in names}
    logs = [added[f"p{i}"] + prior[i] for i in range(k)]
    most = F.greatest(*logs) if k > 1 else logs[0]
    score = most + F.log10(sum((F.pow(F.lit(10.0), x - most) for x in logs[1:]), F.pow(F.lit(10.0), logs[0] - most)))
    return both.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", F.round(added["n_known"]).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), added["base"].alias("base_score"), score.alias("score"))
