"""Document scores by masked pseudo-likelihood.

A small window network predicts every token of a text from the tokens on both of its sides. The sum of the logarithms of
these conditional probabilities scores the document.

Tokens are lower-cased words and pieces of words, each with its blank in front: the commonest words of the whole corpus, the
pieces that cover most of the other words, and every single byte. A word without a number is cut into the longest pieces
from the left, so each text has tokens of its own and no two words share one. Each context position has a table of hidden vectors; their sum passes through tanh, and a two-level softmax first
names the token's class and then the token in it, classes being runs of words of like frequency. Texts become tokens once, in a
table in the shared folder, from which training and scoring read. Training is data-parallel: in a round every task starts from
the common network, takes every position of all its documents as a target (every ``stride``-th one if asked), and emits its
weights in chunks; the chunks of all tasks are summed, weighted by examples. A sum has as many entries as the network, whatever
the input, so the driver holds one network.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gridfare.llm.columns import keyed_text
from gridfare.llm.words import Lookup, Spelt
from gridfare.session import checkpointed, scratch_path

CLASSES, MEMBERS = 32, 32
SIZE = CLASSES * MEMBERS
BYTES, PIECES, LONGEST_PIECE = 256, 256, 4
SIDE, HIDDEN = 2, 16
ROUNDS, STRIDE, BATCH, RATE = 1, 1, 4_096, 0.1
#: Exponentials of numbers up to here, and sums of a few of them, are far from the ends of 32-bit floats.
SAFE = 60.0
HELD_WORDS, SLAB_TOKENS, CHUNK = 200_000, 65_536, 4_096
#: Bytes of texts whose words are looked up together, and of the longest word that is cut beside others. They bound memory.
BLOCK_BYTES, LONG_WORD = 2_000_000, 64

_SHAPES = {
    "table": (2 * SIDE, SIZE, HIDDEN), "bias": (HIDDEN,), "to_class": (HIDDEN, CLASSES), "class_bias": (CLASSES,),
    "to_member": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS),
}
WEIGHTS = sum(int(np.prod(shape)) for shape in _SHAPES.values())


@dataclass
class Model:
    """``numbers`` has the words and pieces, from 1 on; 0 stands outside the text. ``flat`` holds all weights one after the other."""

    numbers: dict[bytes, int]
    flat: np.ndarray
    _words: Lookup | None = field(default=None, repr=False)

    def parts(self) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            out[name] = self.flat[at : at + size].reshape(shape)
            at += size
        return out

    def tokens(self, text: str) -> np.ndarray:
        """The numbers of all words and pieces, in order."""
        return np.concatenate([ids for ids, _ in self.encode(pa.array([text], pa.string()))]).astype(np.int64)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(tokens of some texts one after the other, where each text ends in them), of all texts; a word is cut when it is met first."""
        if self._words is None:
            cutter = Cutter(self.numbers)
            self._words = Lookup(lambda words: cutter.spell([word.encode() for word in words]))
        for block in blocks(texts):
            words, ends = byte_words(block)
            ids, counts = self._words.encode(words.cast(pa.large_string()))
            yield ids, np.concatenate([[0], np.cumsum(counts)])[ends]


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of ``BLOCK_BYTES`` together, or little more than one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK_BYTES)) + 1).tolist(), len(texts)]
    for begin, end in zip(cuts, cuts[1:]):
        if begin < end:
            yield texts.slice(begin, end - begin)


def byte_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts one after the other, where each text's end): lower-cased and cut as bytes are, by ASCII alone."""
    cut_ = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    some = pc.greater(pc.binary_length(cut_.values), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return cut_.values.filter(some), before[cut_.offsets.to_numpy()[1:]]


def cut(word: bytes, numbers: dict[bytes, int]) -> list[int]:
    """The number of a word, or those of the longest pieces from its left to its right."""
    whole, out, at = b" " + word, [], 0
    if number := numbers.get(whole):
        return [number]
    while at < len(whole):
        for width in range(min(LONGEST_PIECE, len(whole) - at), 0, -1):
            if number := numbers.get(whole[at : at + width]):
                break
        out.append(number)
        at += width
    return out


def laid_out(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all words, a blank before each and ``LONGEST_PIECE`` behind the last, where each begins); words hold no blank."""
    line = np.frombuffer(b"".join([b" ", b" ".join(words), b" " * LONGEST_PIECE]), np.uint8)
    return line, np.flatnonzero(line == 32)[: len(words)]


class Cutter:
    """``cut`` for many words at once: the longest piece at every place of a line of words, from a tree of the pieces' bytes.

    Words hold no blank, so no piece reaches over the end of a word.
    """

    def __init__(self, numbers: dict[bytes, int]) -> None:
        self.numbers = numbers

    @cached_property
    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        """(the node behind a node and a byte, 0 for none; the token that ends there, 0 for none); 1 is the root."""
        branches, ends = [[0] * 256, [0] * 256], [0, 0]
        for token, number in self.numbers.items():
            if len(token) > LONGEST_PIECE:
                continue
            node = 1
            for byte in token:
                if not branches[node][byte]:
                    branches[node][byte] = len(branches)
                    branches.append([0] * 256)
                    ends.append(0)
                node = branches[node][byte]
            ends[node] = number
        return np.array(branches, np.int32).reshape(-1), np.array(ends, np.uint16)

    def spell(self, words: Sequence[bytes]) -> Spelt:
        whole = np.fromiter((self.numbers.get(b" " + word, 0) for word in words), np.uint16, len(words))
        long = np.fromiter((len(word) > LONG_WORD for word in words), bool, len(words))
        parts = [(np.flatnonzero(whole), whole[whole > 0], np.zeros(np.count_nonzero(whole), np.int64))]
        for place in np.flatnonzero(long & (whole == 0)).tolist():
            own = np.array(cut(words[place], self.numbers), np.uint16)
            parts.append((np.full(len(own), place), own, np.arange(len(own))))
        owner = np.flatnonzero(~long & (whole == 0))
        if len(owner):
            line, at = laid_out([words[place] for place in owner.tolist()])
            ends = np.append(at[1:], len(line) - LONGEST_PIECE)
            branches, tokens = self.tree
            node = branches[256 + line[: len(line) - LONGEST_PIECE].astype(np.int32)]
            longest, width = tokens[node], np.ones(len(node), np.int32)
            for more in range(1, LONGEST_PIECE):
                node = branches[256 * node + line[more : len(line) - LONGEST_PIECE + more]]
                found = tokens[node]
                longest, width = np.where(found, found, longest), np.where(found, more + 1, width)
            turn = 0
            while len(at):
                parts.append((owner, longest[at], np.full(len(at), turn)))
                at = at + width[at]
                open_ = at < ends
                at, owner, ends, turn = at[open_], owner[open_], ends[open_], turn + 1
        owners, ids, turns = (np.concatenate(column) for column in zip(*parts))
        counts = np.bincount(owners, minlength=len(words))
        out = np.empty(len(ids), np.uint16)
        out[(np.cumsum(counts) - counts)[owners] + turns] = ids
        return out, counts


def windows(texts: list[np.ndarray], stride: int = 1, first: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(contexts, targets, text of each) of the positions of all texts, at most ``SLAB_TOKENS`` at a time.

    A context has the numbers on the left and on the right of its position; outside a text they are 0. ``first`` says where a
    text's positions begin, from which on every ``stride``-th is taken.
    """
    gap = np.zeros(SIDE, np.uint16)
    line = np.concatenate([gap, *(part for own in texts for part in (own, gap))])
    sizes = np.array([len(own) for own in texts], np.int64)
    begins = SIDE + np.cumsum(sizes + SIDE) - sizes - SIDE
    for number in range(0, len(line), SLAB_TOKENS):
        at = np.arange(number, min(number + SLAB_TOKENS, len(line)))
        owner = np.searchsorted(begins, at, "right") - 1
        place = at - begins[owner] if len(begins) else at
        kept = (owner >= 0) & (place < sizes[owner]) if len(begins) else np.zeros(len(at), bool)
        if stride > 1:
            kept &= (place - np.asarray(first)[owner]) % stride == 0
        at, owner = at[kept], owner[kept]
        if len(at):
            yield np.stack([line[at + step] for step in range(-SIDE, SIDE + 1) if step], axis=1), line[at].astype(np.int64), owner


def _hidden(net: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    total = net["bias"] + np.take(net["table"][0], context[:, 0], axis=0)
    for place in range(1, 2 * SIDE):
        total += np.take(net["table"][place], context[:, place], axis=0)
    # tanh(x) = 1 - 2 / (exp(2x) + 1), in the place of x.
    total += total
    with np.errstate(over="ignore"):
        np.exp(total, out=total)
    total += 1
    np.divide(-2, total, out=total)
    total += 1
    return total


def _totals(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """(sum of the exponentials, what was taken off before) of each row; ``logits`` becomes the exponentials.

    Rows are shifted by their largest entry only where some entry is too far from 0 for its exponential.
    """
    shift = 0.0
    if len(logits) and max(logits.max(), -logits.min()) > SAFE:
        shift = logits.max(axis=1)
        logits -= shift[:, None]
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], np.float32), shift


def _shares(logits: np.ndarray) -> np.ndarray:
    """The softmax of each row, in the place of ``logits``."""
    logits /= _totals(logits)[0][:, None]
    return logits


def _log_total(logits: np.ndarray) -> np.ndarray:
    total, shift = _totals(logits)
    return np.log(total) + shift


def by_class(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """(an order that puts positions of one class together, the run of each class that occurs)."""
    classes = (targets // MEMBERS).astype(np.uint8)
    order = np.argsort(classes, kind="stable")
    ends = np.cumsum(np.bincount(classes, minlength=CLASSES)).tolist()
    return order, [(number, slice(begin, end)) for number, (begin, end) in enumerate(zip([0, *ends], ends)) if begin < end]


def _logits(net: dict[str, np.ndarray], hidden: np.ndarray, runs: list[tuple[int, slice]]) -> tuple[np.ndarray, np.ndarray]:
    """(of the classes, of the members of the target's class) of positions in the order of ``by_class``."""
    outer = hidden @ net["to_class"] + net["class_bias"]
    inner = np.empty((len(hidden), MEMBERS), hidden.dtype)
    for number, run in runs:
        np.matmul(hidden[run], net["to_member"][number], out=inner[run])
        inner[run] += net["member_bias"][number]
    return outer, inner


def log_chances(net: dict[str, np.ndarray], context: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """log P(target | both sides) of each row."""
    order, runs = by_class(targets)
    targets = targets[order]
    every = np.arange(len(targets))
    outer, inner = _logits(net, _hidden(net, context[order]), runs)
    named = outer[every, targets // MEMBERS] + inner[every, targets % MEMBERS]
    out = np.empty(len(targets))
    out[order] = named.astype(np.float64) - _log_total(outer) - _log_total(inner)
    return out


def learn(net: dict[str, np.ndarray], squares: dict[str, np.ndarray], context: np.ndarray, targets: np.ndarray) -> None:
    """One step of adaptive gradient descent on the mean log loss."""
    count = len(targets)
    order, runs = by_class(targets)
    context, targets = context[order], targets[order]
    every = np.arange(count)
    hidden = _hidden(net, context)
    outer, inner = _logits(net, hidden, runs)
    slope, inner = _shares(outer), _shares(inner)
    slope[every, targets // MEMBERS] -= 1
    inner[every, targets % MEMBERS] -= 1
    grads = {name: np.zeros_like(weight) for name, weight in net.items() if name != "table"}
    ones = np.ones(count, np.float32)
    grads["to_class"][:], grads["class_bias"][:] = hidden.T @ slope, ones @ slope
    back = slope @ net["to_class"].T
    for number, run in runs:
        own = inner[run]
        grads["to_member"][number], grads["member_bias"][number] = hidden[run].T @ own, ones[run] @ own
        back[run] += own @ net["to_member"][number].T
    back *= 1 - hidden * hidden
    grads["bias"][:] = ones @ back
    for name, grad in grads.items():
        grad /= count
        squares[name] += grad * grad
        net[name] -= RATE * grad / (np.sqrt(squares[name]) + 1e-6)
    # Sums by place, token and hidden unit; rows that no context names have no gradient and stay as they are.
    grad, slopes = np.empty_like(net["table"]), np.ascontiguousarray(back.T, float)
    for place in range(2 * SIDE):
        at = context[:, place].astype(np.intp)
        for unit in range(HIDDEN):
            grad[place, :, unit] = np.bincount(at, slopes[unit], SIZE)
    grad /= count
    squares["table"] += grad * grad
    step = np.sqrt(squares["table"])
    step += 1e-6
    np.divide(grad, step, out=step)
    step *= RATE
    net["table"] -= step


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts. A task counts its own words first and hands them on whenever it holds too many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

        def emit(found: pa.Table) -> Iterator[pa.RecordBatch]:
            shape = pa.schema([("word", pa.binary()), ("n", pa.int64())])
            return iter(found.select(["word", "n"]).cast(shape).to_batches())

        for batch in batches:
            for block in blocks(batch.column(0)):
                found = pc.value_counts(byte_words(block)[0])
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                if sum(map(len, held[1:])) > HELD_WORDS:
                    held = [merged()]
                    if len(held[0]) > HELD_WORDS:
                        yield from emit(held.pop())
        if held:
            yield from emit(merged())

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different key and the sum of its weights, which are whole numbers below 2^53."""
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, weights, len(found)).astype(np.int64)


def piece_weights(counts: DataFrame, own: set[bytes]) -> DataFrame:
    """(piece, weight) of the words that are not in ``own``: how many tokens a piece saves where it occurs, overlaps included.

    Pieces of one width are numbers made of their bytes; a task adds up those it holds and hands them on when they are too many.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(sorted(own), pa.binary())
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {width: [] for width in range(2, LONGEST_PIECE + 1)}

        def merged(width: int) -> tuple[np.ndarray, np.ndarray]:
            return summed(*(np.concatenate(column) for column in zip(*held[width])))

        def emit(width: int, keys: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
            data = np.ascontiguousarray(keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width])
            ends = np.arange(len(keys) + 1, dtype=np.int32) * width
            pieces = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
            return pa.record_batch([pieces, pa.array(weights, pa.int64())], names=["piece", "weight"])

        for batch in batches:
            other = batch.filter(pc.invert(pc.is_in(batch.column(0), value_set=listed)))
            line, starts = laid_out(other.column(0).to_pylist())
            times = other.column(1).to_numpy()
            for begin in range(0, len(line) - LONGEST_PIECE if len(starts) else 0, SLAB_TOKENS):
                end = min(begin + SLAB_TOKENS, len(line) - LONGEST_PIECE)
                n = times[np.searchsorted(starts, np.arange(begin, end), "right") - 1]
                keys, inside = line[begin:end].astype(np.uint32), np.ones(end - begin, bool)
                for width in range(2, LONGEST_PIECE + 1):
                    last = line[begin + width - 1 : end + width - 1]
                    inside &= last != 32
                    keys |= last.astype(np.uint32) << np.uint32(8 * (width - 1))
                    held[width].append(summed(keys[inside], n[inside] * (width - 1)))
                    if sum(len(found) for found, _ in held[width][1:]) > HELD_WORDS:
                        held[width] = [merged(width)]
                        if len(held[width][0][0]) > HELD_WORDS:
                            yield emit(width, *held[width].pop())
        for width, parts in held.items():
            if parts:
                yield emit(width, *merged(width))

    return counts.mapInArrow(weigh, "piece binary, weight long").groupBy("piece").agg(F.sum("weight").alias("weight"))


def token_counts(counts: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(number, n) of the tokens of all texts, from the counts of their words."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, sums = Cutter(numbers), np.zeros(SIZE, np.int64)
        for batch in batches:
            ids, sizes = cutter.spell(batch.column(0).to_pylist())
            sums += np.bincount(ids, np.repeat(batch.column(1).to_numpy(), sizes), SIZE).astype(np.int64)
        yield pa.record_batch([pa.array(range(SIZE), pa.int64()), pa.array(sums)], names=["number", "n"])

    return counts.mapInArrow(tally, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))


def start(texts: DataFrame, seed: int = 5) -> Model:
    """Numbers for words, pieces and bytes, commonest first, ties by the token; a network that knows their frequencies only."""
    counts = checkpointed(word_counts(texts))  # read three times, and counting reads the corpus
    words = counts.orderBy(F.desc("n"), "word").limit(SIZE - 1 - BYTES - PIECES).toArrow()["word"].to_pylist()
    listed = {bytes([value]): 0 for value in range(BYTES)} | {b" " + word: 0 for word in words}
    # A piece may be a word of its own already; so many more are taken.
    weighed = piece_weights(counts, set(words)).orderBy(F.desc("weight"), "piece").limit(PIECES + len(words)).toArrow()
    new = [piece for piece in weighed["piece"].to_pylist() if piece not in listed]
    tokens = [*listed, *new[:PIECES]]
    times = token_counts(counts, {token: number for number, token in enumerate(tokens, 1)}).toArrow()
    found = dict(zip(times["number"].to_pylist(), times["n"].to_pylist()))
    ranked = sorted((-found.get(number, 0), token) for number, token in enumerate(tokens, 1))
    frequency = np.full(SIZE, 0.5)
    frequency[1 : 1 + len(ranked)] += [-n for n, _ in ranked]
    grouped = frequency.reshape(CLASSES, MEMBERS)
    rng = np.random.default_rng(seed)
    model = Model({token: 1 + rank for rank, (_, token) in enumerate(ranked)}, np.zeros(WEIGHTS, np.float32))
    net = model.parts()
    net["table"][:] = rng.standard_normal(net["table"].shape) * 0.1
    net["to_class"][:] = rng.standard_normal(net["to_class"].shape) * 0.05
    net["to_member"][:] = rng.standard_normal(net["to_member"].shape) * 0.05
    net["class_bias"][:] = np.log(grouped.sum(axis=1) / frequency.sum())
    net["member_bias"][:] = np.log(grouped / grouped.sum(axis=1, keepdims=True))
    return model


def token_ids(text: Column, model: Model) -> Column:
    """The tokens of a text column as little-endian 16-bit numbers; a null text has none."""

    @arrow_udf("binary")
    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([], pa.binary())]
            for ids, ends in model.encode(batch):
                places = np.concatenate([[0], 2 * ends]).astype(np.int32)
                buffers = [None, pa.py_buffer(places.tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())]
                parts.append(pa.Array.from_buffers(pa.binary(), len(ends), buffers))
            yield pa.concat_arrays(parts)

    return number(text)


def token_table(texts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, ids) of all texts, written to the shared folder."""
    path = scratch_path(texts.sparkSession, "masked-ids")
    texts.select("doc_id", token_ids(F.col("text"), model).alias("ids")).write.parquet(path)
    return texts.sparkSession.read.parquet(path)


def _texts(ids: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of texts, (place of the first, tokens of each), that have ``SLAB_TOKENS`` tokens or few more together."""
    held: list[np.ndarray] = []
    start = size = 0
    for place in range(len(ids)):
        held.append(np.frombuffer(ids[place].as_buffer(), "<u2"))
        size += len(held[-1])
        if size >= SLAB_TOKENS:
            yield start, held
            start, held, size = place + 1, [], 0
    if held:
        yield start, held


def train_round(table: DataFrame, model: Model, stride: int = STRIDE) -> Model:
    """The mean of the networks that the tasks make of ``model``, weighted by their examples."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.numbers, model.flat.copy())
        net = own.parts()
        squares = {name: np.zeros_like(weight) for name, weight in net.items()}
        seen = 0
        for batch in batches:
            first = [(doc_id or 0) % stride for doc_id in batch.column(0).to_pylist()]
            for start, texts in _texts(batch.column(1)):
                for context, targets, _ in windows(texts, stride, first[start : start + len(texts)]):
                    seen += len(targets)
                    for begin in range(0, len(targets), BATCH):
                        learn(net, squares, context[begin : begin + BATCH], targets[begin : begin + BATCH])
        if seen:
            sums = np.append(own.flat.astype(np.float64), 1.0) * seen
            starts = np.arange(0, len(sums), CHUNK)
            yield pa.record_batch([pa.array(starts), pa.array([sums[i : i + CHUNK].tobytes() for i in starts], pa.binary())], names=["start", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for start_, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(sums, np.float64)
                held[start_] = held[start_] + part if start_ in held else part
        yield pa.record_batch([pa.array(held.keys(), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["start", "sums"])

    shape = "start long, sums binary"
    rows = table.select("doc_id", "ids").mapInArrow(local, shape).repartition("start").mapInArrow(add, shape).collect()
    if not rows:
        return model
    total = np.zeros(WEIGHTS + 1)
    for row in rows:
        part = np.frombuffer(row["sums"], np.float64)
        total[row["start"] : row["start"] + len(part)] += part
    return Model(model.numbers, (total[:-1] / total[-1]).astype(np.float32))


def train(table: DataFrame, model: Model, *, rounds: int = ROUNDS, stride: int = STRIDE) -> Model:
    for _ in range(rounds):
        model = train_round(table, model, stride)
    return model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, stride: int = STRIDE) -> Model:
    """Train on all documents; an empty corpus leaves the starting network."""
    texts = keyed_text(docs, id_col, text_col)
    model = start(texts)
    return train(token_table(texts, model), model, rounds=rounds, stride=stride)


def scored(ids: Column, model: Model) -> Column:
    """struct<n_tokens, log_likelihood> of a column of ``token_ids``: tokens of a few texts are predicted together."""

    @arrow_udf("struct<n_tokens:long,log_likelihood:double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = model.parts()
        for batch in batches:
            sums, counts = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for first, texts in _texts(batch):
                counts[first : first + len(texts)] = [len(own) for own in texts]
                for context, targets, owner in windows(texts):
                    sums[first : first + len(texts)] += np.bincount(owner, log_chances(net, context, targets), len(texts))
            yield pa.StructArray.from_arrays([pa.array(counts), pa.array(sums)], ["n_tokens", "log_likelihood"])

    return score(ids)


def score_tokens(table: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) of every row of (doc_id, ids)."""
    rows = table.select("doc_id", scored(F.col("ids"), model).alias("s"))
    return rows.select("doc_id", "s.n_tokens", "s.log_likelihood", (F.col("s.log_likelihood") / F.nullif("s.n_tokens", F.lit(0))).alias("per_token"))


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) of every row.

    ``n_tokens`` counts words and pieces. A text without words, a null one too, has the empty sum 0 and no mean; repeated rows are scored alike.
    """
    return score_tokens(keyed_text(docs, id_col, text_col).select("doc_id", token_ids(F.col("text"), model).alias("ids")), model)


def score_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score_documents`` with a model of the same documents; texts become tokens once for both."""
    texts = keyed_text(docs, id_col, text_col)
    model = start(texts)
    table = token_table(texts, model)
    return score_tokens(table, train(table, model))
