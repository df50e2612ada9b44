"""Language identification: sparse multinomial regression on hashed character n-grams.

Features are TF-IDF weights of the one- to three-character grams of the lower-cased text, hashed to ``DIM`` buckets and
scaled to length one. Document frequencies come from all training documents. Weights are learned by
follow-the-regularised-leader with an elastic net (the first penalty keeps most weights at zero) on a sample of about
``ROWS_PER_LANGUAGE`` documents a language, of which a fifth only sets the temperature that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gridfare.llm.columns import unsigned_share

DIM = 1 << 14
ROWS_PER_LANGUAGE = 1_200
SLAB_CHARS = 1 << 20
UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the grams of a whole text, read in overlapping slabs."""
    counts = np.zeros(DIM, np.int64)
    for begin in range(0, len(text), SLAB_CHARS):
        points = np.frombuffer(text[begin : begin + SLAB_CHARS + 2].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        inner = begin + SLAB_CHARS < len(text)
        key = np.zeros(len(points), np.uint32)
        for width in range(3):
            grams = len(points) - width
            if grams <= 0:
                break
            key = key[:grams] * np.uint32(0x9E3779B1) + points[width:] + np.uint32(1)
            mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(18)
            counts += np.bincount(mixed[: SLAB_CHARS if inner else None], minlength=DIM)
    return counts


@dataclass
class Model:
    """``weights`` has a row per bucket and a column per language; the last row is the bias."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        values = (1 + np.log(counts[at])) * self.idf[at]
        return at, values / max(float(np.sqrt(values @ values)), 1e-12)

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        logits = self.logits(*self.features(gram_counts(text)))
        chances = _softmax(logits / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(min(chances[best], 1.0))


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def train(
    model: Model,
    rows: list[tuple[np.ndarray, np.ndarray]],
    truth: np.ndarray,
    *,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    seed: int = 3,
) -> None:
    """Follow the regularised leader: weights are the closed-form optimum of the linearised losses so far plus penalties."""
    shape = model.weights.shape
    linear, squares = np.zeros(shape), np.zeros(shape)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for number in order.permutation(len(rows)):
            at, values = rows[number]
            at, values = np.append(at, DIM), np.append(values, 1.0)
            pull, seen = linear[at], squares[at]
            strength = (beta + np.sqrt(seen)) / alpha + l2
            now = np.where(np.abs(pull) <= l1, 0.0, (np.sign(pull) * l1 - pull) / strength)
            chances = _softmax(values @ now)
            chances[truth[number]] -= 1
            slope = values[:, None] * chances
            step = (np.sqrt(seen + slope * slope) - np.sqrt(seen)) / alpha
            linear[at] = pull + slope - step * now
            squares[at] = seen + slope * slope
    strength = (beta + np.sqrt(squares)) / alpha + l2
    model.weights = np.where(np.abs(linear) <= l1, 0.0, (np.sign(linear) * l1 - linear) / strength)


def calibrate(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss on a grid from 0.05 to 20."""
    grid = np.geomspace(0.05, 20, 121)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def held_out(doc_id: Column) -> Column:
    """Rows that never train: CRC-32 of the id as text leaves rest one when divided by three. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sparse(text: Column) -> Column:
    @arrow_udf("struct<at:array<smallint>,n:array<int>>")
    def grams(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [(np.flatnonzero(c), c) for c in (gram_counts(text or "") for text in batch.to_pylist())]
            yield pa.array(
                [{"at": at.astype(np.int16), "n": c[at].astype(np.int32)} for at, c in found],
                pa.struct([("at", pa.list_(pa.int16())), ("n", pa.list_(pa.int32()))]),
            )

    return grams(text)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each bucket occurs. Every task sums its own; a sum has ``DIM`` entries whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIM, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += gram_counts(text or "") > 0
        yield pa.record_batch([pa.array(np.arange(DIM, dtype=np.int32)), pa.array(seen)], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIM)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on rows with a text and a language that are not held out; with none of them every prediction is ``und``."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {row["lang"]: row["count"] for row in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    model = Model(languages, np.ones(DIM), np.zeros((DIM + 1, len(languages))), 1.0)
    if not languages:
        return model
    seen = document_frequencies(rows)
    model.idf = np.log((1 + sum(counts.values())) / (1 + seen)) + 1
    share = F.lit(0.0)
    for language, count in counts.items():
        share = F.when(F.col("lang") == language, rows_per_language / count).otherwise(share)
    drawn = unsigned_share(F.xxhash64(F.col("doc_id"), F.lit(11)))
    chosen = rows.where(drawn < share).select("doc_id", "lang", _sparse(F.col("text")).alias("grams"), drawn.alias("draw"))
    sample = chosen.orderBy("draw", "doc_id").select("lang", "grams.at", "grams.n").toArrow().to_pylist()
    built = []
    for row in sample:
        dense = np.zeros(DIM, np.int64)
        dense[np.array(row["at"], dtype=np.int64)] = row["n"]
        built.append(model.features(dense))
    truth = np.array([languages.index(row["lang"]) for row in sample])
    aside = np.arange(len(built)) % 5 == 4
    train(model, [x for x, out in zip(built, aside) if not out], truth[~aside])
    if aside.any():
        model.temperature = calibrate(np.stack([model.logits(*built[i]) for i in np.flatnonzero(aside)]), truth[aside])
    return model


def predict(text: Column, model: Model) -> Column:
    """struct<lang_pred, score> of a text column."""

    @arrow_udf("struct<lang_pred:string,score:double>")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [model.predict(text) for text in batch.to_pylist()]
            yield pa.array(
                [{"lang_pred": language, "score": score} for language, score in found],
                pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]),
            )

    return guess(text)


def label_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; null texts and texts without a letter are ``und`` with score 0."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    guessed = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), model).alias("guess"))
    return guessed.select("doc_id", "held_out", "guess.lang_pred", "guess.score")
