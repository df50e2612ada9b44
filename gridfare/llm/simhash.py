"""Near duplicates by SimHash, linked by the general pigeonhole principle.

A fingerprint has a bit for each of 64 hash bits that more than half of a text's word shingles set. Two fingerprints link
when at most ``distance`` bits differ. The 64 bits are grouped into ``parts`` partitions, correlated bits together. If
the partitions have thresholds that add up to ``distance - parts + 1``, two linked fingerprints agree within the threshold
in some partition at least (a threshold of -1 leaves a partition out). For each fingerprint a dynamic program picks the
thresholds of least estimated cost, candidates and probes together, so that crowded partitions get low ones. Estimates
come from exact histograms of the halves of each partition over all different fingerprints. A fingerprint is stored under
its own value in every partition, probes all values within its thresholds, and each candidate is verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gridfare.llm.columns import free_name, keyed_text
from gridfare.llm.components import components
from gridfare.session import checkpointed

SHINGLE, SEED, DISTANCE, PARTS, REACH = 4, 42, 4, 3, 2
SLAB = 65_536
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned integer; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(word) + 1 for word in words))
    width = min(shingle, len(words))
    begins = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for first in range(0, len(begins), SLAB):
        spans = zip(begins[first : first + SLAB], ends[first + width - 1 : first + width - 1 + SLAB])
        hashes = np.frombuffer(b"".join([digest(joined[a : b - 1], SEED) for a, b in spans]), np.uint8)
        counts += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(begins)).tobytes(), "big")


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprints of a text column as signed longs; a null text has no words."""

    @arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [fingerprint(value or "", shingle) for value in batch.to_pylist()]
            yield pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    return prints(text)


def _bits(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64)[:, None] >> _SHIFTS & np.uint64(1)).astype(np.float64)


def _summed(prints: DataFrame, size: int, count) -> np.ndarray:
    """Sum over all fingerprints of ``count(values)``, an array of ``size`` entries: one partial sum a task."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += count(batch.column(0).to_numpy())
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    rows = prints.select("print").mapInArrow(local, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def group_bits(together: np.ndarray, count: float, parts: int) -> list[list[int]]:
    """Bits in partitions of equal size (but for one), each grown from a seed by the highest summed correlation."""
    mean = np.diag(together) / max(count, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    bond = np.abs((together / max(count, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(bond, 0)
    left, groups = set(range(64)), []
    for number in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - number)
        own = [max(sorted(left), key=lambda bit: bond[bit, sorted(left)].max())]
        left.discard(own[0])
        while len(own) < size:
            best = max(sorted(left), key=lambda bit: bond[bit, own].sum())
            own.append(best)
            left.discard(best)
        groups.append(own)
    return groups


def _gather(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that the listed bits form, the first bit lowest."""
    out = np.zeros(len(values), np.int64)
    for place, bit in enumerate(bits):
        out |= ((values.view(np.uint64) >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << place
    return out


def _halves(group: list[int]) -> list[list[int]]:
    return [group[: len(group) // 2], group[len(group) // 2 :]]


@lru_cache(maxsize=64)
def masks(width: int, reach: int) -> tuple[tuple[int, ...], ...]:
    """For each number of flipped bits from 0 to ``reach``, all ways to flip so many of ``width``."""
    return tuple(tuple(sum(1 << bit for bit in chosen) for chosen in combinations(range(width), flips)) for flips in range(reach + 1))


class Plan:
    """How bits are grouped, and what each threshold is expected to cost."""

    def __init__(self, groups: list[list[int]], histogram: np.ndarray, count: float, distance: int) -> None:
        self.groups, self.count, self.distance = groups, max(count, 1.0), distance
        self.near: list[list[np.ndarray]] = []  # share of fingerprints at each distance from a half's value
        at = 0
        for group in groups:
            own = []
            for half in _halves(group):
                table = histogram[at : at + (1 << len(half))] / self.count
                at += 1 << len(half)
                values = np.arange(len(table))
                own.append(np.stack([sum(table[values ^ mask] for mask in flips) for flips in masks(len(half), REACH)]))
            self.near.append(own)

    def costs(self, values: np.ndarray) -> np.ndarray:
        """(rows, partitions, thresholds from -1 to REACH): expected candidates and probes."""
        out = np.zeros((len(values), len(self.groups), REACH + 2))
        for number, (group, (low, high)) in enumerate(zip(self.groups, self.near)):
            one, two = (_gather(values, half) for half in _halves(group))
            share, probes = np.zeros(len(values)), 0
            for flips in range(REACH + 1):
                share = share + sum(low[a][one] * high[flips - a][two] for a in range(flips + 1))
                probes += len(masks(len(group), REACH)[flips])
                out[:, number, flips + 1] = self.count * share + probes
        return out

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """Per row the thresholds of least cost whose sum is ``distance - partitions + 1``."""
        costs = self.costs(values)
        parts = len(self.groups)
        goal = self.distance + 1  # thresholds shifted by one, so that they start at zero
        best = np.full((len(values), goal + 1), np.inf)
        best[:, 0] = 0
        picks = []
        for number in range(parts):
            grown, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
            for shifted in range(REACH + 2):
                trial = np.full_like(best, np.inf)
                trial[:, shifted:] = best[:, : goal + 1 - shifted] + costs[:, number, shifted][:, None]
                better = trial < grown
                grown[better], pick[better] = trial[better], shifted
            best = grown
            picks.append(pick)
        out, left = np.zeros((len(values), parts), np.int64), np.full(len(values), goal)
        for number in reversed(range(parts)):
            out[:, number] = picks[number][np.arange(len(values)), left]
            left = left - out[:, number]
        return out - 1


def plan(prints: DataFrame, *, parts: int = PARTS, distance: int = DISTANCE) -> Plan:
    """Statistics over all different fingerprints: how bits go together, then a histogram of each half partition."""
    if not parts * (REACH + 1) >= distance + 1:
        raise ValueError("so few partitions cannot cover the distance")
    sums = _summed(prints, 64 * 64 + 1, lambda values: np.append((_bits(values).T @ _bits(values)).ravel(), len(values)))
    groups = group_bits(sums[:-1].reshape(64, 64), sums[-1], parts)
    halves = [half for group in groups for half in _halves(group)]

    def histogram(values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(_gather(values, half), minlength=1 << len(half)) for half in halves])

    return Plan(groups, _summed(prints, sum(1 << len(half) for half in halves), histogram), sums[-1], distance)


def _stored(prints: Column, how: Plan) -> Column:
    """array<long>: the key of each partition, its number above the value."""

    @arrow_udf("array<long>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = batch.to_numpy(zero_copy_only=False)
            own = np.stack([_gather(values, group) | number << 40 for number, group in enumerate(how.groups)], axis=1)
            ends = np.arange(len(values) + 1, dtype=np.int32) * len(how.groups)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(own.ravel()))

    return keys(prints)


def _probed(prints: Column, how: Plan) -> Column:
    """array<long>: the keys within the thresholds of each partition."""

    @arrow_udf("array<long>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = batch.to_numpy(zero_copy_only=False)
            wanted = how.thresholds(values) if len(values) else np.zeros((0, len(how.groups)), np.int64)
            own = [_gather(values, group) | number << 40 for number, group in enumerate(how.groups)]
            within = [
                [np.array(sum(masks(len(group), REACH)[: reach + 1], ()), np.int64) for reach in range(REACH + 1)] for group in how.groups
            ]
            out = []
            for row, reaches in enumerate(wanted.tolist()):
                out.append(np.concatenate([own[n][row] ^ within[n][reach] for n, reach in enumerate(reaches) if reach >= 0]))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))

    return keys(prints)


def links(prints: DataFrame, *, parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """(first, second) of all pairs of different fingerprints (column ``print``) that differ in few bits; first is smaller."""
    how = plan(prints, parts=parts, distance=distance)
    stored = prints.select("print", F.explode(_stored(F.col("print"), how)).alias("key"))
    probing = prints.select(F.col("print").alias("probe"), F.explode(_probed(F.col("print"), how)).alias("key"))
    close = F.bit_count(F.col("print").bitwiseXOR(F.col("probe"))) <= distance
    met = probing.join(stored, "key").where(close & (F.col("print") != F.col("probe")))
    return met.select(F.least("print", "probe").alias("first"), F.greatest("print", "probe").alias("second")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Null and empty texts have fingerprint zero and are linked like any others; repeated rows fall together; a row without
    an id takes the component of its fingerprint. Documents with one fingerprint are one node, whatever their number.
    """
    rows = checkpointed(keyed_text(docs, id_col, text_col).select("doc_id", fingerprints(F.col("text")).alias("print")))
    nodes = checkpointed(rows.groupBy("print").agg(F.min("doc_id").alias("low")))
    joined = components(links(nodes, parts=parts, distance=distance), "first", "second")
    placed = nodes.join(joined.withColumnRenamed("node", "print"), "print", "left")
    placed = placed.select("print", "low", F.coalesce("component", "print").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "component").select("print", "component_id")
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each component, with all its columns; rows without an id stay.

    A row stays if its own component is named by its id, so where an id is repeated each of its rows is judged by its own text.
    """
    placed = near_duplicates(docs, id_col=id_col, text_col=text_col)
    staying = placed.where("doc_id = component_id").select("doc_id", "fingerprint").distinct()
    mark = free_name(docs, "_print")
    texts = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    marked = docs.where(docs[id_col].isNotNull()).withColumn(mark, F.lower(F.lpad(F.hex(fingerprints(texts)), 16, "0")))
    own = (marked[id_col].cast("long") == staying["doc_id"]) & (marked[mark] == staying["fingerprint"])
    return marked.join(staying, own, "left_semi").drop(mark).union(docs.where(docs[id_col].isNull()))
