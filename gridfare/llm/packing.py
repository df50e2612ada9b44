"""Packing by lexical retrieval: a seed document's window is filled with the nearest unused documents by BM25.

Documents are tokenised once, into a table in the shared folder. Document frequencies count all of them. Documents are then
dealt by ranges of their two most telling tokens (and their hashed id, so that a common token spreads over many tasks): a
partition is a shard of lexically close documents. A task builds the inverted index of its shard, takes the longest open
document as seed, asks with all of its tokens, and adds the best unused neighbours until the window is full. The last one is
cut and its rest stays open. Long documents fill windows of their own first. What is left of a shard, less than a window, is
cut at powers of two, which are not padded. Only a shard of more than ``BLOCK_TOKENS``, three times what shards are made for, is
indexed in blocks.
"""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Tokenizer

from gridfare.llm.byte_bpe import BLOCK_CHARS, narrow_pattern
from gridfare.llm.columns import keyed_text
from gridfare.llm.words import SPELT_WORDS, Lookup, Spelt
from gridfare.session import scratch_path

WINDOW, END_ID = 2_048, 1
SHARD_TOKENS, BLOCK_TOKENS = 2_000_000, 6_000_000
#: Texts and their characters that are tokenised together.
CODED_ROWS, TEXT_CHARS = 1_024, 4_000_000
#: A token in one document of so many is common in its shard; so many common ones at most have columns, which bounds their memory.
DENSE, DENSE_COLUMNS = 16, 1_024
#: The share of documents whose places set the borders of the shards (every document has a place, so they decide about balance
#: alone), and the numbers that hashed ids are folded to, by which documents of one pair of tokens spread.
BORDER_SHARE, SPREAD = 0.05, 1 << 20
#: BM25's saturation and length weights.
SATURATION, LENGTH_WEIGHT = 1.2, 0.75


def byte_signs() -> dict[int, str]:
    """The printable characters that stand for bytes in the tokens of a file, by byte."""
    # Printable bytes stand for themselves, the others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


class WordTokens:
    """Ids by a tokenizer file. Texts of the first 256 characters, which its normal form leaves as they are but for case, are
    cut at spaces; a new chunk is cut by the file's pattern and a new word goes through the file's model. All other texts go through the library whole, those that hold one of its added tokens too.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.added = [token["content"] for token in content.get("added_tokens", ())]
        find = narrow_pattern(content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        signs, model = byte_signs(), self.tokenizer.model

        def merge(words: list[str]) -> Spelt:
            signed = (word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(signs) for word in words)
            spelt = [[token.id for token in model.tokenize(word)] for word in signed]
            counts = np.fromiter(map(len, spelt), np.int64, len(spelt))
            return np.fromiter(chain.from_iterable(spelt), np.int32, int(counts.sum())), counts

        words = Lookup(merge)

        def spell(chunks: list[str]) -> Spelt:
            ids, counts, begin = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
            while begin < len(chunks):
                if len(chunks[begin]) > BLOCK_CHARS:
                    matches = (match[0] for match in find.finditer(chunks[begin]))
                    parts = [words.encode(pa.array(own, pa.large_string()))[0] for own in iter(lambda: list(islice(matches, SPELT_WORDS)), [])]
                    ids += parts
                    counts.append(np.array([sum(map(len, parts))], np.int64))
                    begin += 1
                    continue
                end, size = begin, 0
                while end < len(chunks) and (end == begin or size + len(chunks[end]) <= BLOCK_CHARS):
                    size += len(chunks[end])
                    end += 1
                cut = [find.findall(chunk) for chunk in chunks[begin:end]]
                own, lengths = words.encode(pa.array(list(chain.from_iterable(cut)), pa.large_string()))
                ends = np.cumsum([0, *map(len, cut)])
                ids.append(own)
                counts.append(np.diff(np.concatenate([[0], np.cumsum(lengths)])[ends]))
                begin = end
            return np.concatenate(ids), np.concatenate(counts)

        self.chunks = Lookup(spell)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        easy = [text.lower() if (text.isascii() or is_latin(text)) and not any(token in text for token in self.added) else None for text in texts]
        parts = chain.from_iterable(map(self.easy_ids, blocks([text for text in easy if text is not None])))
        for low, text in zip(easy, texts):
            out.append(next(parts) if low is not None else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32))
        return out

    def easy_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are cut at spaces and line ends."""
        pieces = pc.split_pattern(pa.array([text.replace("\n", " ") for text in texts], pa.large_string()), " ")
        ids, counts = self.chunks.encode(pieces.values)
        ends = np.concatenate([[0], np.cumsum(counts)])[pieces.offsets.to_numpy()]
        return np.split(ids, ends[1:-1])


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of ``TEXT_CHARS`` characters together, or one longer text."""
    begin = 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) <= TEXT_CHARS:
            size += len(texts[end])
            end += 1
        yield texts[begin:end]
        begin = end


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One per worker, so that its tasks share the words it has met."""
    # Look-ups make and drop large buffers; the system's own pool gives them back at once.
    pa.set_memory_pool(pa.system_memory_pool())
    return WordTokens(path)


def give_back() -> None:
    """A worker lives on from step to step; memory that it has freed goes back to the system."""
    gc.collect()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def drop_words() -> None:
    """All texts are tokenised: what a worker remembers of words would stay beside all later steps."""
    word_tokens.cache_clear()
    give_back()


def width(vocabulary: int) -> str:
    """The narrowest type that holds all ids."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def last_places(ids: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each token of a text, where the text has it last; ``last`` has an entry for each token, whatever it holds."""
    last[ids] = np.arange(len(ids))
    return last[ids]


def token_table(texts: DataFrame, path: str, vocabulary: int) -> DataFrame:
    """(doc_id, ids, seen): the ids of each text and the closing id as little-endian integers, and one more row a task.

    That row has ``seen`` alone: in how many of the task's texts each token occurs, then its texts and its tokens. The table
    is written to the shared folder, where both kinds of rows are read without tokenising again.
    """
    kind = width(vocabulary)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known, seen, last = word_tokens(path), np.zeros(vocabulary + 2, np.int64), np.zeros(vocabulary, np.int64)
        names = ["doc_id", "ids", "seen"]
        for batch in batches:
            for begin in range(0, batch.num_rows, CODED_ROWS):
                part = batch.slice(begin, CODED_ROWS)
                coded = [np.append(own, END_ID).astype(kind) for own in known.encode(part.column(1).to_pylist())]
                for own in coded:
                    seen[own[last_places(own, last) == np.arange(len(own))]] += 1
                    seen[-1] += len(own)
                seen[-2] += len(coded)
                values = pa.array([own.tobytes() for own in coded], pa.binary())
                yield pa.record_batch([part.column(0), values, pa.nulls(len(coded), pa.binary())], names=names)
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=names)

    at = scratch_path(texts.sparkSession, "packing-ids")
    texts.mapInArrow(ids, "doc_id long, ids binary, seen binary").write.parquet(at)
    return texts.sparkSession.read.parquet(at)


def document_frequencies(table: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """(documents with each token, documents, tokens) over all rows; as many entries as the vocabulary, plus two."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_words()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen = np.frombuffer(value, np.int64)
                at = np.flatnonzero(seen)
                yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["token", "n"])

    counted = table.where("seen IS NOT NULL").select("seen").mapInArrow(entries, "token int, n long")
    rows = counted.groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocabulary + 2, np.int64)
    out[rows["token"].to_numpy()] = rows["n"].to_numpy()
    return out[:vocabulary], int(out[vocabulary]), int(out[vocabulary + 1])


class BlockIndex:
    """Inverted index of a shard: for each token the documents that hold it, with their BM25 weights.

    Tokens of one document in ``DENSE`` or more have a column of weights, since their lists would be nearly as long.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        self.terms, docs, weights, terms = [], [], [], []
        for number, own in enumerate(ids):
            term, times = np.unique(own, return_counts=True)
            times = times / (times + SATURATION * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * len(own) / mean_length))
            self.terms.append(term[idf[term] > 0])
            terms.append(term)
            docs.append(np.full(len(term), number, np.int32))
            weights.append((idf[term] * times).astype(np.float32))
        every, self.size = np.concatenate(terms), len(ids)
        order = np.argsort(every, kind="stable")
        self.docs, self.weights = np.concatenate(docs)[order], np.concatenate(weights)[order]
        self.starts = np.searchsorted(every[order], np.arange(len(idf) + 1))
        common = np.flatnonzero(np.diff(self.starts) * DENSE >= self.size)[:DENSE_COLUMNS]
        self.column = np.full(len(idf), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.size), np.float32)
        for column, term in enumerate(common.tolist()):
            own = slice(self.starts[term], self.starts[term + 1])
            self.dense[column, self.docs[own]] = self.weights[own]

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[seed]
        columns = self.column[terms]
        asked = np.zeros(len(self.dense), np.float32)
        asked[columns[columns >= 0]] = 1.0
        terms = terms[columns < 0]
        begins, sizes = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.size) + asked @ self.dense


Piece = tuple[int, int, int]  # document of the block, first token, tokens


def pack_block(ids: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[list[Piece]]:
    """The sequences of a block, each a list of pieces. All are ``window`` long but the last few, which are powers of two."""
    sizes = np.array([len(own) for own in ids], dtype=np.int64)
    sequences: list[list[Piece]] = []
    for number in np.flatnonzero(sizes >= window).tolist():
        sequences += [[(number, start, window)] for start in range(0, int(sizes[number]) - window + 1, window)]
    rest = sizes % window
    begin = sizes - rest
    index = BlockIndex(ids, idf, mean_length)
    for seed in np.argsort(-rest, kind="stable").tolist():
        if not rest[seed]:
            continue
        filled: list[Piece] = [(seed, int(begin[seed]), int(rest[seed]))]
        space = window - int(rest[seed])
        rest[seed] = 0
        for number in nearest(index, seed, rest) if space else ():
            taken = min(space, int(rest[number]))
            filled.append((number, int(begin[number]), taken))
            begin[number] += taken
            rest[number] -= taken
            space -= taken
            if not space:
                break
        sequences += [filled] if not space else cut_at_powers(filled, window - space)
    return sequences


def nearest(index: BlockIndex, seed: int, rest: np.ndarray) -> Iterator[int]:
    """The unused documents by falling score, ties by place; ordered in growing portions, as a few fill a window."""
    unused = np.flatnonzero(rest)
    against = -index.scores(seed)[unused]
    portion = 64
    while len(unused):
        if portion < len(unused):
            # All that score like the last of the portion belong to it, which keeps ties in order.
            limit = np.partition(against, portion)[portion]
            near = against <= limit
        else:
            near = np.ones(len(unused), bool)
        first, own = unused[near], against[near]
        yield from first[np.argsort(own, kind="stable")].tolist()
        unused, against = unused[~near], against[~near]
        portion *= 4


def cut_at_powers(pieces: list[Piece], length: int) -> list[list[Piece]]:
    """The same tokens in sequences whose lengths are the powers of two that add up to ``length``."""
    out: list[list[Piece]] = []
    waiting = list(reversed(pieces))
    for bit in reversed(range(length.bit_length())):
        space = (length >> bit & 1) << bit
        own: list[Piece] = []
        while space:
            number, start, size = waiting.pop()
            taken = min(size, space)
            own.append((number, start, taken))
            space -= taken
            if taken < size:
                waiting.append((number, start + taken, size - taken))
        if own:
            out.append(own)
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty and have the closing id alone; repeated rows are packed like any others; an empty table gives no
    row. Sequence numbers are unique, not consecutive.
    """
    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    kind = width(vocabulary)
    table = token_table(keyed_text(docs, id_col, text_col), path, vocabulary)
    coded = table.where("ids IS NOT NULL").select("doc_id", "ids")
    seen, rows, tokens = document_frequencies(table, vocabulary)
    idf = np.log1p((rows - seen + 0.5) / (seen + 0.5))
    idf[END_ID] = 0.0
    mean_length = max(tokens / max(rows, 1), 1.0)

    def place(borders: list[int]) -> Column:
        """(order, shard) of a row: its two most telling tokens, then its hashed id, and how many borders are at or below that."""

        @arrow_udf("struct<order:long,shard:int>")
        def telling(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            drop_words()
            last = np.zeros(vocabulary, np.int64)
            for values, hashes in batches:
                order = np.zeros(len(values), np.int64)
                for row, value in enumerate(values.to_pylist()):
                    own = np.frombuffer(value, kind)
                    times = np.bincount(last_places(own, last))
                    term, times = own[times > 0], times[times > 0]
                    # A token of one document only leads to no neighbour.
                    weight = idf[term] * times / (times + SATURATION) * (seen[term] > 1)
                    for _ in range(2):
                        # The smallest of the tokens that weigh most.
                        best = term[weight == weight.max()].min()
                        order[row] = order[row] * vocabulary + int(best)
                        weight[term == best] = -1.0
                order = order * SPREAD + hashes.to_numpy()
                shard = np.searchsorted(np.array(borders, np.int64), order, "right").astype(np.int32)
                yield pa.StructArray.from_arrays([pa.array(order), pa.array(shard)], ["order", "shard"])

        return telling(F.col("ids"), F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_words()
        numbers = TaskContext.get().partitionId() << 36
        ids: list[np.ndarray] = []
        owners: list[int | None] = []

        def emit() -> pa.RecordBatch:
            nonlocal numbers
            out: list[tuple] = []
            for sequence in pack_block(ids, idf, mean_length, window):
                offset = 0
                for number, start, length in sequence:
                    crc = zlib.crc32(ids[number][start : start + length].astype("<u4").tobytes())
                    out.append((owners[number], start, length, crc, len(ids[number]), numbers, offset))
                    offset += length
                numbers += 1
            ids.clear()
            owners.clear()
            names = [part.split()[0] for part in _PIECES.split(", ")]
            return pa.record_batch([pa.array(column, pa.int64()) for column in zip(*out)], names=names)

        held = 0
        for batch in batches:
            for owner, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                owners.append(owner)
                ids.append(np.frombuffer(value, kind))
                held += len(ids[-1])
                if held >= BLOCK_TOKENS:
                    yield emit()
                    held = 0
        if ids:
            yield emit()

    shards, borders = max(1, ceil(tokens / SHARD_TOKENS)), []
    if shards > 1:
        shares = [number / shards for number in range(1, shards)]
        looked = coded.sample(BORDER_SHARE, 7).select(place([])["order"].alias("order"))
        borders = looked.agg(F.percentile_approx("order", shares, max(10_000, 20 * shards))).first()[0] or []
    near = coded.withColumn("at", place(borders)).select("doc_id", "ids", "at.order", "at.shard")
    near = near.repartitionById(shards, F.col("shard")).sortWithinPartitions("order", "doc_id")
    return near.select("doc_id", "ids").mapInArrow(pack, _PIECES)
