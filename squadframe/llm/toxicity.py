"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Every window of a text is compressed
with both; toxic wording is what the toxic dictionary shortens and the ordinary one does not. The differences of the
window lengths, summed up per text in a few figures, are calibrated to a probability on labelled texts that neither
dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, small_batches

#: Bytes of a window, of the ordinary dictionary and of the trained toxic segments; zstandard's level.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 96, 1 << 19, 1 << 14, 6
#: Bounds of what the driver learns from: labelled texts of each class (chosen by a hash of the id), two thirds of
#: them for the dictionaries, and windows of each class (chosen by a hash of their bytes).
SAMPLE_TEXTS, SAMPLE_WINDOWS = 3000, 100_000
#: Rounds in which the dictionaries learn from the windows that they told apart wrongly.
ROUNDS = 2
#: Shorter by so many bytes, a window speaks for the toxic dictionary.
GAIN = 2


def windows(text: str | None) -> list[bytes]:
    """The whole text in lower case, cut at spaces into windows of at most WINDOW bytes."""
    data = (text or "").lower().encode()
    out, at, n = [], 0, len(data)
    while at < n:
        end = at + WINDOW
        if end < n:
            space = data.rfind(b" ", at + 1, end)
            end = space if space > at else end
        out.append(data[at:end])
        at = end
    return out


@dataclass
class Model:
    """base: ordinary text; toxic: segments that stand before the same base in the toxic dictionary."""

    base: bytes
    toxic: bytes
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0


class Scorer:
    """A model made ready in one task."""

    def __init__(self, model: Model):
        self.model = model
        self.pair = [self._compressor(model.base), self._compressor(model.toxic + b" " + model.base)]

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=own, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def gains(self, parts: list[bytes]) -> np.ndarray:
        """By how many bytes each window is shorter with the toxic dictionary."""
        ordinary, toxic = (c.compress for c in self.pair)
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in parts), np.float64, len(parts))

    def figures(self, text: str | None) -> list[float]:
        gain = np.sort(self.gains(windows(text)))[::-1]
        if not len(gain):
            return [0.0] * 6
        hits = (gain >= GAIN).sum()
        return [gain[0], gain[:3].mean(), gain.clip(0).mean(), hits / len(gain), float(np.log1p(hits)), float(np.log1p(len(gain)))]

    def score(self, text: str | None) -> float:
        m = self.model
        if not len(m.weights):
            return m.prior
        z = m.weights[0] + ((np.array(self.figures(text)) - m.mean) / m.scale) @ m.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def train_dictionaries(ordinary: list[bytes], toxic: list[bytes], rounds: int = ROUNDS) -> Model | None:
    """Dictionaries from windows of both classes; None if there is too little text to train on.

    After the first round the toxic segments are trained on the toxic windows that gained, and ordinary windows that
    gained as well join the base, so that it explains them.
    """
    base, chosen, model = b" ".join(ordinary[: ORDINARY_BYTES // WINDOW]), toxic, None
    for k in range(rounds + 1):
        try:
            segments = zstandard.train_dictionary(TOXIC_BYTES, chosen, d=6, k=24).as_bytes()[-TOXIC_BYTES:]
        except zstandard.ZstdError:  # too few or too uniform windows: they are the dictionary
            segments = b" ".join(dict.fromkeys(chosen))[-TOXIC_BYTES:]
        if not segments or not base:
            return model
        model = Model(base, segments)
        if k < rounds:
            scorer = Scorer(model)
            gained = [w for w, g in zip(toxic, scorer.gains(toxic), strict=True) if g >= GAIN]
            wrong = [w for w, g in zip(ordinary, scorer.gains(ordinary), strict=True) if g >= GAIN]
            chosen = gained if len(gained) >= 20 else chosen
            base = b" ".join(wrong[: ORDINARY_BYTES // WINDOW // 2]) + b" " + base
    return model


def calibrate(model: Model, figures: np.ndarray, toxic: np.ndarray, rate: float) -> Model:
    """Logistic regression of the label on the figures; the classes count as often as labels have them (rate)."""
    model.prior = rate
    if len(set(toxic.tolist())) < 2:
        return model
    model.mean, model.scale = figures.mean(axis=0), figures.std(axis=0) + 1e-6
    x = np.hstack([np.ones((len(figures), 1)), (figures - model.mean) / model.scale])
    weight = np.where(toxic == 1, rate / toxic.mean(), (1 - rate) / (1 - toxic.mean()))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (toxic - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model from labelled rows of docs; labels (id, label 0 or 1; others and null ids are left out) may hold rows
    without a document. A repeated id counts once, as toxic if any of its labels is. The sample is bounded, see
    SAMPLE_TEXTS and SAMPLE_WINDOWS; None if a class has no text."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    picked = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_TEXTS)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.withColumn("turn", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).cast("int"))
    # at most 2 x SAMPLE_TEXTS ids: the texts themselves don't move
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = windows(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["label", "part"])

    parts = texts.where("turn > 0").select("label", "text").mapInArrow(cut, "label int, part binary")
    found = [[bytes(r[0]) for r in parts.where(F.col("label") == k).orderBy(F.xxhash64("part"), "part").limit(SAMPLE_WINDOWS).select("part").collect()] for k in (0, 1)]
    model = train_dictionaries(*found)
    if model is None:
        return None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            figures = [scorer.figures(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(figures, pa.list_(pa.float64()))], ["label", "figures"])

    rows = texts.where("turn = 0").select("label", "text").mapInArrow(measure, "label int, figures array<double>").collect()
    rows.sort(key=lambda r: (r["label"], r["figures"]))
    return calibrate(model, np.array([r["figures"] for r in rows]), np.array([r["label"] for r in rows], float), counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds toxicity (0 to 1, higher: likelier toxic) to all rows and columns of docs.

    Null and empty texts are scored as a text without windows; without a model every score is 0. A column named
    toxicity is replaced. Whole texts are scored, nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[docs[c] for c in docs.columns if c != "toxicity"])
    names = rows.columns
    at = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", toxicity double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            got = [scorer.score(x.as_py()) if scorer else 0.0 for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*names, "toxicity"])

    return rows.mapInArrow(each, schema)


def classify(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 from the threshold on).

    Labels are learnt only from ids whose crc32 modulo folds is not held_out. Only the text is an input of the score;
    other columns are ignored, repeated rows and null ids scored like any.
    """
    model = fit(docs, labels.where(crc_remainder(F.col(id_col), folds) != held_out), id_col, text_col)
    rows = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return rows.select("doc_id", (crc_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
