"""Words met before, kept as Arrow columns.

A worker looks up all words of a block of texts at once by Arrow's hash tables, so only words it has not met become Python
strings, and what it remembers takes little more memory than their characters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What is remembered at most before a block: words, their ids, their bytes. They bound memory; none changes a result.
REMEMBERED_WORDS, REMEMBERED_IDS, REMEMBERED_BYTES = 500_000, 8_000_000, 32_000_000
SPELT_WORDS = 50_000
Spelt = tuple[np.ndarray, np.ndarray]


class Lookup:
    """The ids of words; ``spell`` gives those of new words: all ids one after the other, how many each word has."""

    def __init__(self, spell: Callable[[list[str]], Spelt]) -> None:
        self.spell = spell
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: pa.Array) -> None:
        ids, lengths = [self.ids], [self.lengths]
        for begin in range(0, len(words), SPELT_WORDS):
            values, counts = self.spell(words.slice(begin, SPELT_WORDS).to_numpy(zero_copy_only=False).tolist())
            ids.append(values)
            lengths.append(counts)
        self.known = pa.concat_arrays([self.known, words])
        self.ids, self.lengths = np.concatenate(ids), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The place of each word among the remembered ones; new words are learned."""
        if len(self.known) > REMEMBERED_WORDS or len(self.ids) > REMEMBERED_IDS or self.known.nbytes > REMEMBERED_BYTES:
            self.forget()
        found = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().copy()
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = words.take(pa.array(new)).dictionary_encode()
            found[new] = len(self.known) + fresh.indices.to_numpy()
            self.learn(fresh.dictionary)
        return found

    def encode(self, words: pa.Array) -> Spelt:
        """(ids of all words one after the other, number of ids of each word)."""
        numbers = self.numbers(words)
        lengths = self.lengths[numbers]
        before = np.cumsum(lengths) - lengths
        return self.ids[np.repeat(self.starts[numbers] - before, lengths) + np.arange(int(lengths.sum()))], lengths
