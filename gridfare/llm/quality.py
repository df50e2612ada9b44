"""A quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into blocks of eight. Two neighbouring blocks are a chunk, so chunks overlap by half and
together cover the whole text. A byte enters with a learned vector and with its echo: whether the four bytes that begin
there have begun within the ``ECHO`` bytes before, which lets filters see repetition. Learned filters answer to every chunk,
each filter keeps its strongest answer, and a small dense layer combines these into one probability. Texts are read in
slabs, so memory does not grow with their length.

The fit uses a bounded sample: the ``train_rows`` labelled rows with the smallest hash among those of at most
``train_bytes`` bytes. Scores never see anything but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gridfare.llm.columns import keyed_text

BLOCK, DIMS, FILTERS, HIDDEN, ECHO = 8, 8, 32, 16, 32
SLAB_BLOCKS = 32_768
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, BATCH = 2_000, 32_768, 10, 32


@dataclass
class Network:
    """``embed`` gives bytes their vectors (byte 0 pads and is zero); ``first`` and ``second`` are a filter's two halves."""

    embed: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def random(seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        wide = BLOCK * (DIMS + 1)
        net = Network(
            normal(256, DIMS, scale=0.5), normal(wide, FILTERS, scale=wide**-0.5), normal(wide, FILTERS, scale=wide**-0.5),
            np.zeros(FILTERS, np.float32), normal(FILTERS, HIDDEN, scale=FILTERS**-0.5), np.zeros(HIDDEN, np.float32),
            normal(HIDDEN, scale=HIDDEN**-0.5), np.zeros(1, np.float32),
        )
        net.embed[0] = 0
        return net

    def weights(self) -> list[np.ndarray]:
        return list(vars(self).values())

    def blocks(self, flat: np.ndarray, begin: int, end: int) -> np.ndarray:
        """One row per block from ``begin`` to ``end``: for each byte its vector and its echo."""
        rows = np.empty(((end - begin) * BLOCK, DIMS + 1), np.float32)
        rows[:, :DIMS] = self.embed[flat[begin * BLOCK : end * BLOCK]]
        rows[:, DIMS] = echoes(flat, begin * BLOCK, end * BLOCK)
        return rows.reshape(end - begin, -1)

    def combine(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, hidden layer, pooled answers above zero) from the strongest answer of each filter."""
        strong = np.maximum(pooled + self.bias, 0)
        mixed = np.maximum(strong @ self.hidden + self.hidden_bias, 0)
        logit = np.clip(mixed @ self.out + self.out_bias, -30, 30)
        return 1 / (1 + np.exp(-logit)), mixed, strong

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """One probability per text, given as arrays of bytes."""
        flat, starts = lay_out(texts)
        pooled = np.full((len(texts), FILTERS), -np.inf, np.float32)
        chunks = len(flat) // BLOCK - 1
        for begin in range(0, chunks, SLAB_BLOCKS):
            end = min(begin + SLAB_BLOCKS, chunks)
            blocks = self.blocks(flat, begin, end + 1)
            answers = blocks[:-1] @ self.first + blocks[1:] @ self.second
            # The chunk that begins at a text's last block would reach into the next text.
            last = starts[1:] - 1
            answers[last[(last >= begin) & (last < end)] - begin] = -np.inf
            low = np.searchsorted(starts, begin, "right") - 1
            inside = starts[(starts > begin) & (starts < end)] - begin
            cuts = np.concatenate([[0], inside])
            best = np.maximum.reduceat(answers, cuts)
            pooled[low : low + len(cuts)] = np.maximum(pooled[low : low + len(cuts)], best)
        return self.combine(pooled)[0]


def lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, the first block of each): zeros fill a text's last block and ``ECHO`` bytes more."""
    counts = np.array([len(text) // BLOCK + 1 + ECHO // BLOCK for text in texts], dtype=np.int64)
    starts = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()) * BLOCK, np.uint8)
    for start, text in zip((starts * BLOCK).tolist(), texts):
        flat[start : start + len(text)] = text
    return flat, starts


def echoes(flat: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Whether the four bytes at each position are those at one of the ``ECHO`` positions before; zeros never are."""
    around = np.zeros(ECHO + end - begin + 3, np.uint32)
    known = flat[max(begin - ECHO, 0) : end + 3]
    first = ECHO - min(begin, ECHO)
    around[first : first + len(known)] = known
    grams = around[:-3] | around[1:-2] << np.uint32(8) | around[2:-1] << np.uint32(16) | around[3:] << np.uint32(24)
    own = grams[ECHO:]
    found = np.zeros(len(own), bool)
    for lag in range(2, ECHO + 1):
        found |= own == grams[ECHO - lag : len(grams) - lag]
    return found & (around[ECHO:-3] != 0)


def train(texts: list[np.ndarray], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7, rate: float = 3e-3) -> Network:
    """Fit by Adam on the log loss; only the chunk that won its filter learns."""
    net = Network.random(seed)
    rng = np.random.default_rng(seed + 1)
    weights = net.weights()
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        mixed_order = rng.permutation(len(texts))
        for begin in range(0, len(texts), BATCH):
            chosen = mixed_order[begin : begin + BATCH]
            grads = _gradients(net, [texts[i] for i in chosen], labels[chosen])
            step += 1
            for weight, grad, mean, square in zip(weights, grads, means, squares):
                mean += 0.1 * (grad - mean)
                square += 0.001 * (grad * grad - square)
                weight -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            net.embed[0] = 0
    return net


def _gradients(net: Network, texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    flat, starts = lay_out(texts)
    ends = np.append(starts[1:], len(flat) // BLOCK) - 1
    blocks = net.blocks(flat, 0, len(flat) // BLOCK)
    codes = flat.reshape(-1, BLOCK)
    answers = blocks[:-1] @ net.first + blocks[1:] @ net.second
    won = np.stack([start + answers[start:end].argmax(axis=0) for start, end in zip(starts, ends)])
    pooled = answers[won, np.arange(FILTERS)]
    chance, mixed, strong = net.combine(pooled)
    slope = ((chance - labels) / len(texts)).astype(np.float32)
    to_mixed = slope[:, None] * net.out * (mixed > 0)
    to_pooled = (to_mixed @ net.hidden.T) * (strong > 0)
    first = np.einsum("df,dfk->kf", to_pooled, blocks[won])
    second = np.einsum("df,dfk->kf", to_pooled, blocks[won + 1])
    embed = np.zeros_like(net.embed)
    for half, at in ((net.first, won), (net.second, won + 1)):
        back = (to_pooled[:, :, None] * half.T).reshape(-1, DIMS + 1)
        np.add.at(embed, codes[at].reshape(-1), back[:, :DIMS])
    return [
        embed, first, second, to_pooled.sum(axis=0), strong.T @ to_mixed, to_mixed.sum(axis=0), mixed.T @ slope,
        slope.sum(keepdims=True),
    ]


def byte_views(batch: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each text without copying; a null is empty."""
    array = batch.cast(pa.large_binary())
    ends = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)
    return [data[a:b] if valid else data[:0] for a, b, valid in zip(ends[:-1], ends[1:], array.is_valid().to_pylist())]


def probability(text: Column, net: Network) -> Column:
    """The network's probability for a text column; a null text is an empty one."""

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            views = byte_views(batch)
            yield pa.array(net.score(views).astype(np.float64) if views else [], pa.float64())

    return score(text)


def held_out(doc_id: Column) -> Column:
    """Rows that never train: CRC-32 of the id as text, divided by five without rest. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
    train_bytes: int = TRAIN_BYTES,
) -> Network:
    """Fit on labelled rows that are not held out. Without any row the answer is the untrained network's 0.5.

    Rows are chosen by id and length; only the chosen ones, ``train_rows`` at most, are broadcast to meet their texts.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    marks = marks.where("label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = keyed_text(docs).where(~held_out(F.col("doc_id")) & (F.octet_length("text") <= train_bytes))
    fitting = marks.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = fitting.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    met = texts.join(F.broadcast(chosen), "doc_id")
    # Of a repeated id the text of least hash, whatever the order of rows.
    found = met.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = found.select("label", F.col("text").cast("binary").alias("text")).toArrow()
    if not sample.num_rows:
        net = Network.random(0)
        net.out[:] = 0
        return net
    views = [np.frombuffer(value, np.uint8) for value in sample["text"].to_pylist()]
    return train(views, sample["label"].to_numpy().astype(np.float32))


def score_documents(docs: DataFrame, net: Network, *, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; empty and null texts get the score of an empty text."""
    scored = keyed_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), probability(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, net: Network, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that the network does not reject, with all their columns; nothing is shuffled."""
    return docs.where(probability(docs[text_col].cast("string"), net) >= threshold)
