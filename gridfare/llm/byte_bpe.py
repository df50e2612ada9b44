"""Byte-level BPE encoding and decoding by merge replay.

The pre-token pattern cuts each text into words. The distinct words of a block of texts are laid end to end as bytes, and
an inverted index leads from a token pair, named by the rank of its merge, to the positions where it stands. Merges are
replayed over the whole block in rank order; each one touches its two neighbours and nothing else. Words do not influence
each other, so a block gives the same ids as the whole corpus would, and no word ever has to be shuffled: blocks are the
Arrow batches of a task, and a task remembers the words it has replayed.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gridfare.llm.columns import keyed_text

#: Characters cut into words at a time, words replayed together, and words a worker remembers, also by their ids, as words may
#: be very long. They bound memory; none changes a result.
BLOCK_CHARS = 2_000_000
REPLAYED_WORDS = 100_000
REMEMBERED_WORDS, REMEMBERED_IDS = 300_000, 8_000_000
SLICE_ROWS = 512
_NONE = np.int32(2**31 - 1)


class Ranks:
    """What a replay has to know: the token of each byte, of a byte that ends a word, and the rank and token of each merge."""

    def __init__(self, byte: list[int], last: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.byte, self.last = np.array(byte, dtype=np.int32), np.array(last, dtype=np.int32)
        # Tokens that no merge goes on from can stand in a pair too.
        self.span = 1 + max(*byte, *last, *(max(*pair, token) for pair, (_, token) in pairs.items()))
        listed = sorted((first * self.span + second, rank) for (first, second), (rank, _) in pairs.items())
        self.keys = np.array([key for key, _ in listed], dtype=np.int64)
        self.values = np.array([rank for _, rank in listed], dtype=np.int32)
        self.merged = {rank: token for rank, token in pairs.values()}

    def whole(self, word: bytes) -> int:
        """The token that a word is without any merge, or -1."""
        return -1

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE."""
        wanted = first.astype(np.int64) * self.span + second
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], _NONE)


    def one(self, first: int, second: int) -> int | None:
        """The rank of one pair, if it merges."""
        wanted = first * self.span + second
        at = int(self.keys.searchsorted(wanted))
        return int(self.values[at]) if at < len(self.keys) and self.keys[at] == wanted else None


class FileRanks(Ranks):
    """A rank file: one base64 token and its rank per line. A pair merges when its bytes are a token; ranks are ids."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.token = {rank: piece for piece, rank in self.rank.items()}
        pairs = {}
        for piece, rank in self.rank.items():
            for cut in range(1, len(piece)):
                first, second = self.rank.get(piece[:cut]), self.rank.get(piece[cut:])
                if first is not None and second is not None:
                    pairs[first, second] = rank, rank
        byte = [self.rank[bytes([b])] for b in range(256)]
        super().__init__(byte, byte, pairs)

    def whole(self, word: bytes) -> int:
        return self.rank.get(word, -1)


@lru_cache(maxsize=2)
def load_ranks(path: str) -> FileRanks:
    return FileRanks(path)


def merge_word(word: bytes, ranks: Ranks) -> list[int]:
    """The ids of one word by the definition: merge the pair of lowest rank, the leftmost first, until none is left.

    Pairs wait in a heap and parts are linked, so a word takes time in proportion to its length times its logarithm.
    """
    parts = [*ranks.byte[list(word[:-1])].tolist(), int(ranks.last[word[-1]])]
    end = len(parts)
    left, right = list(range(-1, end - 1)), list(range(1, end + 1))
    found = ranks.of(np.array(parts[:-1]), np.array(parts[1:]))
    at = np.flatnonzero(found != _NONE)
    # How often a part has changed; a pair that has waited since before is out of date.
    version = [0] * end
    waiting = [(rank, place, 0, 0) for rank, place in zip(found[at].tolist(), at.tolist())]
    heapify(waiting)
    while waiting:
        rank, place, own, other = heappop(waiting)
        after = right[place]
        if version[place] != own or after == end or version[after] != other:
            continue
        parts[place] = ranks.merged[rank]
        right[place], version[after] = right[after], -1
        version[place] += 1
        if right[place] < end:
            left[right[place]] = place
        for first in (left[place], place):
            second = right[first] if first >= 0 else end
            if second < end and (lower := ranks.one(parts[first], parts[second])) is not None:
                heappush(waiting, (lower, first, version[first], version[second]))
    return [part for part, state in zip(parts, version) if state >= 0]


def replay(words: Sequence[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where each word's begin, how many it has); words are not empty.

    ``waiting`` is the inverted index, from the rank of a pair to the positions of its left part. Where merges of one
    rank overlap, or a merge makes a pair of lower rank than its own, the order inside the word matters, and that word is
    done by the definition instead.
    """
    sizes = np.array([len(word) for word in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    token = ranks.byte[data]
    token[starts + sizes - 1] = ranks.last[data[starts + sizes - 1]]
    count = len(token)
    left, right = np.arange(-1, count - 1, dtype=np.int32), np.arange(1, count + 1, dtype=np.int32)
    left[starts], right[starts + sizes - 1] = -1, -1
    whole = np.array([ranks.whole(word) for word in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    live = np.flatnonzero((right >= 0) & (whole[owner] < 0)).astype(np.int32)
    pair = np.full(count, _NONE, dtype=np.int32)
    pair[live] = ranks.of(token[live], token[live + 1])
    waiting: dict[int, list[np.ndarray]] = {}
    order: list[int] = []
    irregular: list[np.ndarray] = []

    def add(spots: np.ndarray) -> None:
        found = pair[spots]
        spots, found = spots[found != _NONE], found[found != _NONE]
        if not len(spots):
            return
        by = np.argsort(found, kind="stable")
        spots, found = spots[by], found[by]
        cuts = np.flatnonzero(np.diff(found)) + 1
        firsts = [0, *cuts.tolist()]
        for rank, first, last in zip(found[firsts].tolist(), firsts, [*firsts[1:], len(spots)]):
            if rank in waiting:
                waiting[rank].append(spots[first:last])
            else:
                waiting[rank] = [spots[first:last]]
                heappush(order, rank)

    add(live)
    heapify(order)
    while order:
        rank = heappop(order)
        spots = np.concatenate(waiting.pop(rank))
        spots = spots[pair[spots] == rank]
        if not len(spots):
            continue
        after = right[spots]
        overlap = pair[after] == rank
        if overlap.any():
            irregular.append(owner[spots[overlap]])
            spots = spots[~np.isin(owner[spots], irregular[-1])]
            after = right[spots]
        beyond = right[after]
        merged = ranks.merged[rank]
        token[spots] = merged
        right[spots] = beyond
        left[beyond[beyond >= 0]] = spots[beyond >= 0]
        pair[after], pair[spots] = _NONE, _NONE
        token[after] = -1
        before = left[spots]
        before = before[before >= 0]
        touched = np.concatenate([spots[beyond >= 0], before[token[before] != merged]])
        pair[touched] = ranks.of(token[touched], token[right[touched]])
        lower = pair[touched] < rank
        if lower.any():
            irregular.append(owner[touched[lower]])
            touched = touched[~np.isin(owner[touched], irregular[-1])]
        add(touched)

    token[whole[owner] >= 0] = -1
    token[starts[whole >= 0]] = whole[whole >= 0]
    lengths = np.add.reduceat((token >= 0).astype(np.int64), starts) if len(words) else np.zeros(0, np.int64)
    places = np.cumsum(lengths) - lengths
    spelt = [token[token >= 0]]
    end = len(spelt[0])
    for number in np.unique(np.concatenate(irregular)).tolist() if irregular else []:
        spelt.append(np.array(merge_word(words[number], ranks), dtype=np.int32))
        places[number], lengths[number] = end, len(spelt[-1])
        end += len(spelt[-1])
    return np.concatenate(spelt), places, lengths


def narrow_pattern(pattern: str) -> re.Pattern:
    """The same pattern for texts of the first 256 characters, with its classes of letters, numbers and spaces spelt out.

    The standard engine, which lacks the classes, is more than twice as fast.
    """
    members = {
        name: "".join(re.escape(chr(c)) for c in range(256) if regex.match(name, chr(c))) for name in (r"\p{L}", r"\p{N}", r"\s")
    }

    def spell(match: re.Match) -> str:
        if match[0][0] == "[":
            return re.sub(r"\\p\{[LN]\}|\\s", lambda inner: members[inner[0]], match[0])
        return f"[^{members[chr(92) + 's']}]" if match[0] == r"\S" else f"[{members[match[0]]}]"

    return re.compile(re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", spell, pattern))


class _Numbers(dict):
    """Word -> number, given in the order of first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


Words = Iterable[str]
Spelt = tuple[np.ndarray, np.ndarray, np.ndarray]


def pattern_cut(pattern: str) -> Callable[[str], Words]:
    """A function that cuts a text into the matches of a pattern; a very long text gives them one by one."""
    wide, narrow = regex.compile(pattern), narrow_pattern(pattern)

    def cut(text: str) -> Words:
        try:
            text.encode("latin-1")
            own = narrow
        except UnicodeEncodeError:
            own = wide
        return own.findall(text) if len(text) <= BLOCK_CHARS else (match[0] for match in own.finditer(text))

    return cut


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker, so that the tasks of a worker share the words it has met."""
    ranks = load_ranks(path)
    return Encoder(pattern_cut(pattern), lambda words: replay([word.encode() for word in words], ranks))


class Encoder:
    """Numbers the words of many texts, spells the new ones together and puts the texts together from them.

    ``cut`` gives the words of a text, ``spell`` the ids of words: all of them, where each word's begin, how many it has.
    """

    def __init__(self, cut: Callable[[str], Words], spell: Callable[[list[str]], Spelt], remember: int = REMEMBERED_WORDS) -> None:
        self.cut, self.spell, self.remember = cut, spell, remember
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        words = islice(self.numbers, len(self.lengths), None)
        while fresh := list(islice(words, REPLAYED_WORDS)):
            ids, places, lengths = self.spell(fresh)
            self.starts = np.concatenate([self.starts, len(self.ids) + places])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        spelt, counts, begin = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while begin < len(texts):
            end, size = begin + 1, len(texts[begin])
            while end < len(texts) and size + len(texts[end]) <= BLOCK_CHARS:
                size += len(texts[end])
                end += 1
            if len(self.numbers) > self.remember or len(self.ids) > REMEMBERED_IDS:
                self.forget()
            words = [self.cut(text) for text in texts[begin:end]]
            numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int32)
            sizes = [len(own) for own in words] if isinstance(words[0], list) else [len(numbers)]
            self.learn()
            lengths = self.lengths[numbers]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            at = np.repeat(self.starts[numbers] - ends[:-1], lengths) + np.arange(int(ends[-1]))
            spelt.append(self.ids[at])
            counts.append(np.diff(ends[np.cumsum([0, *sizes])]))
            begin = end
        return np.concatenate(spelt), np.concatenate(counts)


def sliced(batches: Iterator[pa.Array], rows: int = SLICE_ROWS) -> Iterator[pa.Array]:
    """The same rows in smaller batches, so that fewer texts are held in Python at a time."""
    for batch in batches:
        for begin in range(0, len(batch), rows):
            yield batch.slice(begin, rows)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Token ids (array<int>) of a text column, without special tokens. Null gives null, an empty text an empty array."""

    @arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = encoder(path, pattern)
        for batch in sliced(batches):
            texts = batch.to_pylist()
            values, counts = known.encode([text or "" for text in texts])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            missing = pa.array([text is None for text in texts], pa.bool_())
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=missing)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes (binary) that an array of ids stands for. Null ids give null; an unknown id fails the job."""

    @arrow_udf("binary")
    def text_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = load_ranks(path).token
        for batch in sliced(batches):
            values = batch.values.to_numpy(zero_copy_only=False)
            ends = batch.offsets.to_numpy()
            yield pa.array(
                [
                    b"".join(map(token.__getitem__, values[start:end].tolist())) if valid else None
                    for start, end, valid in zip(ends[:-1], ends[1:], batch.is_valid().to_pylist())
                ],
                pa.binary(),
            )

    return text_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; a null text counts as empty, repeated rows are repeated."""
    texts = keyed_text(docs, id_col, text_col)
    return texts.select("doc_id", encode(F.col("text"), path, pattern).alias("ids"))


def round_trip_digests(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them; one scan and no shuffle."""
    coded = encode_documents(docs, path, pattern, id_col=id_col, text_col=text_col)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
