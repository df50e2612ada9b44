"""Trees for many experiments at once: forests, extra trees and boosting, grown from histograms.

An experiment is a learner, a held-out fold and a set of columns. Columns are binned once per fold, and training rows that are equal
in fold, bins of the experiment's columns, label and weight become one row with a count: a tree cannot tell them apart, and the
bootstrap count of ``n`` equal rows is one Poisson draw of mean ``n``. A tree on at most ``NODE_ROWS`` such rows is grown in one task,
some trees of an experiment together. On more, each task adds up whole-number statistics of its rows by (experiment, tree, node, column,
bin); one aggregate merges them, and the best split of a node is chosen where its bins meet, until a node has few enough rows. All
experiments and trees that are due share a pass over the rows, as many as ``PASS_CELLS`` allows. Statistics are fixed-point numbers, so
their sums do not depend on the order of rows, and bootstrap counts, column choices and random thresholds are hashes of seed, tree and
row or node: both ways give the same tree, and so does a lost task that runs again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfare.session import scratch_path

BINS = 64
#: Different rows of a node that one task finishes, histogram cells a task holds in a pass, rows scored together.
NODE_ROWS, PASS_CELLS, CHUNK_ROWS = 1 << 21, 1 << 22, 1 << 17
#: Trees that a task grows from the same rows, at most.
TASK_TREES = 25
#: One in fixed point.
UNIT = 1 << 20
SEED = 42


@dataclass(frozen=True)
class Learner:
    """``kind`` is forest, extra_trees or boosting; ``share`` of the columns is tried at a node ("sqrt" or "all").

    With ``classes`` the labels are 0 to ``classes - 1`` and a leaf has the share of each; otherwise it has one number.
    """

    kind: str
    trees: int
    depth: int
    share: str = "sqrt"
    rate: float = 0.1
    regression: bool = False
    seed: int = SEED
    classes: int = 0


class Experiment(NamedTuple):
    model: str
    setting: str
    fold: int
    columns: tuple[int, ...]
    learner: Learner


# ---- randomness ----


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """64 random-looking bits of the parts, the same everywhere."""
    state = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            state = (np.asarray(part).astype(np.int64).astype(np.uint64) + state) * np.uint64(0xBF58476D1CE4E5B9)
            state = (state ^ (state >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            state = state ^ (state >> np.uint64(32))
    return state


def _uniform(*parts: np.ndarray | int) -> np.ndarray:
    return (_mixed(*parts) >> np.uint64(11)).astype(float) * 2.0**-53


#: How likely a bootstrap sample of the size of the data holds a row at most 0, 1, … times.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(12)])


@lru_cache(maxsize=4096)
def _poisson(mean: int) -> tuple[int, np.ndarray]:
    """How likely a Poisson number of this mean is at most ``low``, ``low + 1``, …; beyond lies less than a double can tell."""
    reach = int(12 * np.sqrt(mean)) + 20
    low = max(mean - reach, 0)
    numbers = np.arange(1, mean + reach + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(mean) - np.log(numbers))]) - mean
    return low, np.cumsum(np.exp(logs[low:]))


def copies(learner: Learner, tree: int, row_id: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """How often a tree sees each row, or each ``n`` equal rows: a bootstrap for forests, once for the others."""
    if learner.kind != "forest":
        return np.ones(len(row_id), np.int64) if n is None else n
    drawn = _uniform(learner.seed, tree, row_id)
    seen = np.searchsorted(_POISSON, drawn, "right")
    if n is not None:
        many = np.flatnonzero(n > 1)
        many = many[np.argsort(n[many], kind="stable")]
        means, begins = np.unique(n[many], return_index=True)
        for mean, a, b in zip(means.tolist(), begins, [*begins[1:], len(many)]):
            low, shares = _poisson(mean)
            seen[many[a:b]] = low + np.searchsorted(shares, drawn[many[a:b]], "right")
    return seen


# ---- statistics and splits ----


def statistics(learner: Learner, seen: np.ndarray, y: np.ndarray, weight: np.ndarray, margin: np.ndarray | None = None) -> np.ndarray:
    """(rows, mass, slopes…) of each row as whole numbers; boosting has a curve behind its slope, classes have a slope each."""
    mass = seen * weight
    if learner.kind == "boosting" and learner.regression:
        parts = (mass, mass * (y - margin), mass)
    elif learner.kind == "boosting":
        chance = 1 / (1 + np.exp(-margin))
        parts = (mass, mass * (y - chance), mass * chance * (1 - chance))
    elif learner.classes:
        parts = (mass, *(mass * (y == k) for k in range(learner.classes)))
    else:
        parts = (mass, mass * y)
    return np.stack([(seen > 0).astype(np.int64), *(np.rint(p * UNIT).astype(np.int64) for p in parts)], axis=1)


def _statistics_width(learner: Learner) -> int:
    return 4 if learner.kind == "boosting" else 2 + (learner.classes or 1)


def _purity(learner: Learner, sums: np.ndarray) -> np.ndarray:
    """Squared slopes over the mass; NaN without mass."""
    squares = (sums[..., 2:].astype(float) ** 2).sum(axis=-1) if learner.classes else sums[..., 2].astype(float) ** 2
    return squares / sums[..., 1]


def _tried(learner: Learner, tree: int, nodes: np.ndarray, width: int) -> np.ndarray:
    """Which columns each node tries."""
    if learner.share == "all":
        return np.ones((len(nodes), width), bool)
    draws = _uniform(learner.seed + 1, tree, nodes[:, None], np.arange(width)[None, :])
    return draws.argsort(axis=1).argsort(axis=1) < max(int(np.sqrt(width)), 1)


class Split(NamedTuple):
    """Of a number of nodes: the column (-1 for none), the last bin that goes left, statistics of both sides, what is gained."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    gain: np.ndarray


def _choice(learner: Learner, tree: int, nodes: np.ndarray, width: int) -> np.ndarray:
    """The columns each node tries, in ascending order; all nodes try the same number."""
    return np.nonzero(_tried(learner, tree, nodes, width))[1].reshape(len(nodes), -1)


#: A column for all nodes or one for each, and their histograms of it: nodes x bins x statistics.
Cells = tuple[np.ndarray | int, np.ndarray]


def best_splits(learner: Learner, tree: int, nodes: np.ndarray, cells: Iterable[Cells], edges: Sequence[np.ndarray]) -> Split:
    """The best split of each node. ``cells`` gives each node the columns it tries one at a time, in ascending order.

    A split gains as much as the variance falls, which for two classes is their impurity. Extra trees try one threshold a column,
    drawn between the least and the greatest edge inside the node, and moved up to the next edge.
    """
    size = len(nodes)
    best, column, cut = np.zeros(size), np.full(size, -1), np.zeros(size, np.int64)
    left, right = (np.zeros((size, _statistics_width(learner)), np.int64) for _ in range(2))
    table = _edge_table(edges) if learner.kind == "extra_trees" else None
    for place, histogram in cells:
        place = np.broadcast_to(place, size)
        sums = histogram.cumsum(axis=1)
        whole = sums[:, -1:]
        rest = whole - sums
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = _purity(learner, sums) + _purity(learner, rest) - _purity(learner, whole)
        open_ = (sums[..., 1] > 0) & (rest[..., 1] > 0)
        if table is not None:
            open_ &= np.arange(BINS)[None, :] == _drawn_cuts(learner, tree, nodes, place, histogram, *table)[:, None]
        gain = np.where(open_, gain, 0.0)
        at = gain.argmax(axis=1)
        found = gain[np.arange(size), at]
        # Rounding leaves a trace of gain where there is none.
        better = found > np.maximum(best, 1e-9 * np.abs(whole[:, 0, 1 if learner.classes else 2]))
        best[better], column[better], cut[better] = found[better], place[better], at[better]
        left[better], right[better] = sums[better, at[better]], rest[better, at[better]]
    return Split(column, cut, left, right, best)


def _edge_table(edges: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the edges of each column, infinite behind the last; how many there are)."""
    counts = np.array([len(own) for own in edges], np.int64)
    table = np.full((len(edges), max(counts.max(initial=0), 1)), np.inf)
    for own, row in zip(edges, table):
        row[: len(own)] = own
    return table, counts


def _drawn(learner: Learner, tree: int, nodes: np.ndarray, place: int, histogram: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The thresholds of nodes that try the same column."""
    table, counts = _edge_table([edges])
    return _drawn_cuts(learner, tree, nodes, place, histogram, np.repeat(table, place + 1, axis=0), np.repeat(counts, place + 1))


def _drawn_cuts(learner: Learner, tree: int, nodes: np.ndarray, place: np.ndarray | int, histogram: np.ndarray, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    place = np.broadcast_to(place, len(nodes))
    held = histogram[..., 0] > 0
    low, high = held.argmax(axis=1), BINS - 1 - held[:, ::-1].argmax(axis=1)
    last = np.maximum(counts[place] - 1, 0)
    with np.errstate(invalid="ignore"):
        least, most = table[place, np.minimum(low, last)], table[place, np.clip(high - 1, 0, last)]
        value = least + _uniform(learner.seed + 2, tree, nodes, place) * (most - least)
    cut = np.clip((table[place] < value[:, None]).sum(axis=1), low, np.maximum(high - 1, low))
    return np.where(counts[place] > 0, cut, 0)


def _histogram(slot: np.ndarray, bins: np.ndarray, stats: np.ndarray, slots: int) -> np.ndarray:
    """Sums of the statistics, one a row of ``stats``, by slot and bin."""
    flat = slot * BINS + bins
    sums = [np.bincount(flat, own, slots * BINS) for own in stats]
    return np.stack(sums, axis=1).astype(np.int64).reshape(slots, BINS, len(stats))


def _histograms(learner: Learner, tree: int, nodes: np.ndarray, slot: np.ndarray, columns: np.ndarray, stats: np.ndarray) -> Iterator[Cells]:
    """Each node's histograms of the columns it tries, one column of each node at a time."""
    choice = _choice(learner, tree, nodes, len(columns))
    flat, at = columns.reshape(-1), np.arange(len(slot))
    for own in choice.T:
        yield own, _histogram(slot, flat[(own * len(slot))[slot] + at], stats, len(nodes))


def _histograms_below(above: list[np.ndarray], totals: np.ndarray, slot: np.ndarray, columns: np.ndarray, stats: np.ndarray) -> Iterator[Cells]:
    """The same for pairs of children when every column is tried: the smaller child is counted, the other is what it leaves of its parent."""
    counted = np.zeros(len(totals), bool)
    small = 2 * np.arange(len(totals) // 2) + (totals[1::2, 0] < totals[::2, 0])
    counted[small] = True
    mine = np.flatnonzero(counted[slot])
    pair, stats = slot[mine] // 2, stats[:, mine]
    for k, own in enumerate(columns):
        found = _histogram(pair, own[mine], stats, len(small))
        both = np.empty((len(totals), *found.shape[1:]), np.int64)
        both[small], both[small ^ 1] = found, above[k] - found
        yield k, both


def leaf_value(learner: Learner, total: np.ndarray) -> np.ndarray:
    if learner.classes:
        return total[..., 2:] / np.maximum(total[..., 1:2], 1)
    return total[..., 2] / np.maximum(total[..., 3 if learner.kind == "boosting" else 1], 1)


@dataclass
class Tree:
    """Nodes numbered from 1, children 2n and 2n + 1, in ascending order; a leaf has column -1. ``gain`` is what each split gains."""

    node: np.ndarray
    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The place of each row's leaf."""
        inner = self.column >= 0
        column = np.where(inner, self.column, 0)
        cut = np.where(inner, self.cut, BINS)
        left = np.where(inner, np.searchsorted(self.node, 2 * self.node), np.arange(len(self.node)))
        flat, begin = np.ascontiguousarray(bins).reshape(-1), np.arange(len(bins)) * bins.shape[1]
        at = np.zeros(len(bins), np.int64)
        for _ in range(int(self.node[-1]).bit_length() - int(self.node[0]).bit_length()):
            at = left[at] + (flat[begin + column[at]] > cut[at])
        return at


def grow(learner: Learner, tree: int, bins: np.ndarray, stats: np.ndarray, edges: Sequence[np.ndarray], root: int = 1) -> Tree:
    """The tree below ``root`` from all of its rows; numbers go on from the root's."""
    columns = np.ascontiguousarray(bins.T)
    parts: list[tuple] = []
    slot = np.zeros(len(bins), np.int64)
    nodes, totals = np.array([root], np.int64), stats.sum(axis=0)[None, :]
    # Whole numbers below 2^53, so sums of floats are exact.
    weights = np.ascontiguousarray(stats.T, float)
    above: list[np.ndarray] | None = None
    for level in range(root.bit_length() - 1, learner.depth + 1):
        if level == learner.depth:
            parts.append((nodes, np.full(len(nodes), -1), np.zeros(len(nodes), np.int64), leaf_value(learner, totals), np.zeros(len(nodes))))
            break
        held: list[np.ndarray] = []
        if above is None:
            cells = _histograms(learner, tree, nodes, slot, columns, weights)
        else:
            cells = _histograms_below(above, totals, slot, columns, weights)
        split = best_splits(learner, tree, nodes, _kept(cells, held if learner.share == "all" else None), edges)
        parts.append((nodes, split.column, split.cut, leaf_value(learner, totals), split.gain))
        inner = split.column >= 0
        if not inner.all():
            stays = np.flatnonzero(inner[slot])
            slot, columns, weights = slot[stays], columns.take(stays, axis=1), weights.take(stays, axis=1)
        if not len(slot):
            break
        right = columns[split.column[slot], np.arange(len(slot))] > split.cut[slot]
        slot = 2 * (np.cumsum(inner) - 1)[slot] + right
        nodes = np.stack([2 * nodes[inner], 2 * nodes[inner] + 1], axis=1).reshape(-1)
        totals = np.stack([split.left[inner], split.right[inner]], axis=1).reshape(len(nodes), -1)
        above = [h[inner] for h in held] if learner.share == "all" else None
    return Tree(*(np.concatenate([p[k] for p in parts]) for k in range(5)))


def _kept(cells: Iterable[Cells], into: list[np.ndarray] | None) -> Iterator[Cells]:
    for place, histogram in cells:
        if into is not None:
            into.append(histogram)
        yield place, histogram


def _start(learner: Learner, slope: int, mass: int) -> float:
    mean = slope / max(mass, 1)
    if learner.regression:
        return mean
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


def boost(learner: Learner, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, edges: Sequence[np.ndarray], n: np.ndarray | None = None) -> list[Tree]:
    """All rounds on rows that are at hand, ``n`` equal ones each; leaf values hold the rate."""
    n = np.ones(len(y), np.int64) if n is None else n
    margin = np.full(len(y), _start(learner, int((np.rint(weight * y * UNIT).astype(np.int64) * n).sum()), int((np.rint(weight * UNIT).astype(np.int64) * n).sum())))
    trees = []
    for number in range(learner.trees):
        tree = grow(learner, number, bins, statistics(learner, n, y, weight, margin), edges)
        tree.value = tree.value * learner.rate
        margin = margin + tree.value[tree.leaves(bins)]
        trees.append(tree)
    return trees


# ---- passes over the rows ----

ROWS = "fold int, id long, train boolean, y double, weight double, bins binary"
_SPLITS = "experiment int, tree int, node long, col int, cut int, gain double, lefts array<long>, rights array<long>"
_TREES = pa.schema([
    ("experiment", pa.int32()), ("tree", pa.int32()), ("node", pa.list_(pa.int64())), ("col", pa.list_(pa.int32())),
    ("cut", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())), ("gain", pa.list_(pa.float64())),
])
_TREES_DDL = "experiment int, tree int, node array<long>, col array<int>, cut array<int>, value array<double>, gain array<double>"
Edges = Mapping[int, Sequence[np.ndarray]]


class _Rows(NamedTuple):
    ids: np.ndarray
    n: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    bins: np.ndarray


def _chosen_bins(columns: Sequence[int]) -> Column:
    """The bins of these columns, in this order."""
    runs: list[list[int]] = []
    for c in columns:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return F.concat(*[F.substring("bins", a + 1, b - a + 1) for a, b in runs])


def _by_choice(rows: DataFrame, choices: Sequence[tuple[int, ...]], experiments: Sequence[Experiment]) -> DataFrame:
    """Each row once for every choice of columns that an experiment on its fold has: ``own`` is its place, ``bins`` its columns."""
    shapes = []
    for place, columns in enumerate(choices):
        folds = sorted({e.fold for e in experiments if e.columns == columns})
        shapes.append(F.when(F.col("fold").isin(folds), F.struct(F.lit(place).alias("own"), _chosen_bins(columns).alias("bins"))))
    kept = [c for c in rows.columns if c != "bins"]
    return rows.withColumn("_c", F.explode(F.filter(F.array(*shapes), lambda c: c.isNotNull()))).select(*kept, "_c.own", "_c.bins")


def _grouped(rows: DataFrame, choices: Sequence[tuple[int, ...]], experiments: Sequence[Experiment]) -> DataFrame:
    """The training rows, equal ones of a fold and choice as one with their number ``n`` and an id made of what they are."""
    spread = _by_choice(rows.where("train").select("fold", "y", "weight", "bins"), choices, experiments)
    found = spread.groupBy("fold", "own", "bins", "y", "weight").agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("id", F.xxhash64("bins", "y", "weight"))


def _choices(experiments: Sequence[Experiment]) -> list[tuple[int, ...]]:
    return sorted({tuple(e.columns) for e in experiments})


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], _Rows]]:
    """((fold, choice), rows) of a batch."""
    if not batch.num_rows:
        return
    fold, own, ids, n, y, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "own", "id", "n", "y", "weight"))
    for one in sorted(set(zip(fold.tolist(), own.tolist()))):
        mine = np.flatnonzero((fold == one[0]) & (own == one[1]))
        bins = np.frombuffer(b"".join(batch.column("bins").take(pa.array(mine)).to_pylist()), np.uint8).reshape(len(mine), -1)
        yield one, _Rows(ids[mine], n[mine], y[mine], weight[mine], bins)


@dataclass
class _Growing:
    """A tree on the driver: its splits so far, statistics of nodes without one, and earlier trees of a boosting."""

    experiment: int
    tree: int
    splits: dict[int, tuple[int, int, float]]
    totals: dict[int, np.ndarray]
    closed: set[int]
    before: list[Tree]
    learner: Learner
    start: float = 0.0

    def shape(self, rate: float = 1.0) -> Tree:
        nodes = np.array(sorted({*self.splits, *self.totals}), np.int64)
        splits = [self.splits.get(int(n), (-1, 0, 0.0)) for n in nodes]
        none = np.zeros(_statistics_width(self.learner), np.int64)
        values = leaf_value(self.learner, np.stack([self.totals.get(int(n), none) for n in nodes])) * rate
        column, cut, gain = (np.array(v, t) for v, t in zip(zip(*splits), (np.int64, np.int64, float)))
        return Tree(nodes, column, cut, values, gain)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for tree in self.before:
            out = out + tree.value[tree.leaves(bins)]
        return out


def _level(groups: DataFrame, experiments: Sequence[Experiment], edges: Edges, due: list[tuple[_Growing, list[int]]]) -> list[tuple]:
    """Splits of the nodes that are due, from one pass over the grouped rows."""
    choices, most = _choices(experiments), max(_statistics_width(e.learner) for e in experiments)
    shapes = [(g, g.shape(), np.array(sorted(nodes), np.int64)) for g, nodes in due]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, part in _by_group(batch):
                for place, (growing, shape, nodes) in enumerate(shapes):
                    spec = experiments[growing.experiment]
                    if (spec.fold, choices.index(spec.columns)) != group:
                        continue
                    bins = part.bins
                    seen = copies(spec.learner, growing.tree, part.ids, part.n)
                    here = shape.node[shape.leaves(bins)]
                    slot = np.minimum(np.searchsorted(nodes, here), len(nodes) - 1)
                    mine = (nodes[slot] == here) & (seen > 0)
                    margin = growing.margin(bins[mine]) if spec.learner.kind == "boosting" else None
                    stats = statistics(spec.learner, seen[mine], part.y[mine], part.weight[mine], margin)
                    sums = stats.T.astype(float)
                    found = np.stack([_histogram(slot[mine], bins[mine, k], sums, len(nodes)) for k in range(len(spec.columns))])
                    held[place] = held[place] + found if place in held else found
        for place, found in held.items():
            growing, _, nodes = shapes[place]
            column, slot, bin_ = np.nonzero(found[..., 0])
            sums = found[column, slot, bin_]
            same = [np.full(len(column), v) for v in (growing.experiment, growing.tree)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(same[0], pa.int32()), pa.array(same[1], pa.int32()), pa.array(nodes[slot]), pa.array(column, pa.int32()), pa.array(bin_, pa.int32()), *(pa.array(sums[:, k] if k < sums.shape[1] else np.zeros(len(sums), np.int64)) for k in range(most))],
                names=["experiment", "tree", "node", "col", "bin", *(f"s{k}" for k in range(most))],
            )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes come whole and in order; a node has at most columns x bins rows."""
        waiting, out = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            whole = table if waiting is None else pa.concat_tables([waiting, table])
            keys = [whole[c].to_numpy() for c in ("experiment", "tree", "node")]
            cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1), whole.num_rows]
            out += [_chosen(whole.slice(a, b - a), experiments, edges) for a, b in zip(cuts[:-2], cuts[1:-1])]
            waiting = whole.slice(cuts[-2])
        if waiting is not None and waiting.num_rows:
            out.append(_chosen(waiting, experiments, edges))
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[n.split()[0] for n in _SPLITS.split(", ")])

    sums_ddl = ", ".join(f"s{k} long" for k in range(most))
    cells = groups.mapInArrow(count, f"experiment int, tree int, node long, col int, bin int, {sums_ddl}")
    key = ["experiment", "tree", "node"]
    summed = cells.groupBy(*key, "col", "bin").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(most)])
    return summed.repartition(*key).sortWithinPartitions(*key).mapInArrow(choose, _SPLITS).collect()


def _chosen(cells: pa.Table, experiments: Sequence[Experiment], edges: Edges) -> tuple:
    """The split of one node; without one, the first statistics are the node's own."""
    number, tree, node = (cells[c][0].as_py() for c in ("experiment", "tree", "node"))
    spec = experiments[number]
    width = _statistics_width(spec.learner)
    full = np.zeros((len(spec.columns), 1, BINS, width), np.int64)
    full[cells["col"].to_numpy(), 0, cells["bin"].to_numpy()] = np.stack([cells[f"s{k}"].to_numpy() for k in range(width)], axis=1)
    own = [edges[spec.fold][c] for c in spec.columns]
    tried = _choice(spec.learner, tree, np.array([node]), len(spec.columns))[0]
    split = best_splits(spec.learner, tree, np.array([node]), ((k, full[k]) for k in tried.tolist()), own)
    left = split.left[0] if split.column[0] >= 0 else full[0, 0].sum(axis=0)
    return number, tree, node, int(split.column[0]), int(split.cut[0]), float(split.gain[0]), left.tolist(), split.right[0].tolist()


def _passes(due: list[tuple[_Growing, list[int]]], experiments: Sequence[Experiment], cells: int) -> Iterator[list[tuple[_Growing, list[int]]]]:
    """The due nodes in groups whose histograms a task can hold."""
    group, used = [], 0
    for growing, nodes in due:
        step = max(cells // (len(experiments[growing.experiment].columns) * BINS), 1)
        for begin in range(0, len(nodes), step):
            some = nodes[begin : begin + step]
            need = len(some) * len(experiments[growing.experiment].columns) * BINS
            if group and used + need > cells:
                yield group
                group, used = [], 0
            group.append((growing, some))
            used += need
    if group:
        yield group


def _grow_levels(groups: DataFrame, experiments: Sequence[Experiment], edges: Edges, growing: list[_Growing], node_rows: int) -> None:
    """Split all nodes of more than ``node_rows`` rows, level by level, in as few passes as histograms allow."""
    while True:
        due = []
        for one in growing:
            depth = experiments[one.experiment].learner.depth
            nodes = [n for n, t in one.totals.items() if n not in one.closed and t[0] > node_rows and n.bit_length() <= depth]
            if nodes:
                due.append((one, sorted(nodes)))
        if not due:
            return
        at = {(g.experiment, g.tree): g for g in growing}
        for group in _passes(due, experiments, PASS_CELLS):
            for one, nodes in group:
                one.closed.update(nodes)
            for row in _level(groups, experiments, edges, group):
                one, node = at[row["experiment"], row["tree"]], row["node"]
                if row["col"] < 0:
                    one.totals[node] = np.array(row["lefts"])
                    continue
                one.splits[node] = (row["col"], row["cut"], row["gain"])
                del one.totals[node]
                one.totals[2 * node], one.totals[2 * node + 1] = np.array(row["lefts"]), np.array(row["rights"])


def _finish(groups: DataFrame, experiments: Sequence[Experiment], edges: Edges, growing: list[_Growing]) -> DataFrame:
    """Trees below all open nodes, none of more than ``NODE_ROWS`` rows. Whole trees of an experiment share a task and its rows."""
    spark, choices = groups.sparkSession, _choices(experiments)
    whole: dict[int, list[int]] = {}
    jobs: list[tuple[int, list[int], Tree | None, int]] = []
    for one in growing:
        learner = experiments[one.experiment].learner
        nodes = sorted(n for n in one.totals if n not in one.closed and n.bit_length() <= learner.depth)
        if not one.closed:
            whole.setdefault(one.experiment, []).append(one.tree)
        else:
            shape = one.shape()
            jobs += [(one.experiment, [one.tree], shape, n) for n in nodes]
    step = min(max(sum(map(len, whole.values())) // (3 * spark.sparkContext.defaultParallelism), 1), TASK_TREES)
    jobs += [(e, own[a : a + step], None, 1) for e, own in whole.items() for a in range(0, len(own), step)]
    if not jobs:
        return spark.createDataFrame([], _TREES_DDL)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, part in _by_group(batch):
                numbers, blobs, all_rows = [], [], None
                placed: dict[tuple[int, int], np.ndarray] = {}
                for place, (number, own, shape, node) in enumerate(jobs):
                    spec = experiments[number]
                    if (spec.fold, choices.index(spec.columns)) != group:
                        continue
                    if shape is None:
                        all_rows = _packed(part) if all_rows is None else all_rows
                        blob = all_rows
                    else:
                        if (number, own[0]) not in placed:
                            here = shape.node[shape.leaves(part.bins)]
                            placed[number, own[0]] = np.where(copies(spec.learner, own[0], part.ids, part.n) > 0, here, 0)
                        mine = np.flatnonzero(placed[number, own[0]] == node)
                        blob = _packed(_Rows(*(v[mine] for v in part))) if len(mine) else b""
                    if blob:
                        numbers.append(place)
                        blobs.append(blob)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["job", "rows"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition has the rows of one job."""
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for job, blob in zip(batch.column("job").to_pylist(), batch.column("rows").to_pylist()):
                held.setdefault(job, []).append(blob)
        while held:
            job, blobs = held.popitem()
            number, own, _, node = jobs[job]
            spec = experiments[number]
            rows = _unpacked(blobs, len(spec.columns))
            del blobs
            mine = [edges[spec.fold][c] for c in spec.columns]
            if spec.learner.kind == "boosting":
                yield _tree_batch(list((number, k, one) for k, one in enumerate(boost(spec.learner, rows.bins, rows.y, rows.weight, mine, rows.n))))
                continue
            for tree in own:
                seen = copies(spec.learner, tree, rows.ids, rows.n)
                kept = np.flatnonzero(seen)
                stats = statistics(spec.learner, seen[kept], rows.y[kept], rows.weight[kept])
                yield _tree_batch([(number, tree, grow(spec.learner, tree, rows.bins[kept], stats, mine, node))])

    packed = groups.mapInArrow(pack, "job int, rows binary")
    return packed.repartitionById(len(jobs), "job").mapInArrow(finish, _TREES_DDL)


def _packed(rows: _Rows) -> bytes:
    kinds = (np.int64, np.int64, np.float64, np.float64, np.uint8)
    return b"".join(np.ascontiguousarray(v, k).tobytes() for v, k in zip(rows, kinds))


def _unpacked(blobs: list[bytes], width: int) -> _Rows:
    """The rows of all blobs in the order of their numbers of copies, which makes drawing faster."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for blob in blobs:
        size, at = len(blob) // (width + 32), 0
        for k, (kind, each) in enumerate(((np.int64, 8), (np.int64, 8), (np.float64, 8), (np.float64, 8), (np.uint8, width))):
            parts[k].append(np.frombuffer(blob[at : at + size * each], kind))
            at += size * each
    ids, n, y, weight, bins = (np.concatenate(p) for p in parts)
    order = np.argsort(n, kind="stable")
    return _Rows(ids[order], n[order], y[order], weight[order], bins.reshape(-1, width)[order])


def _tree_batch(trees: Sequence[tuple[int, int, Tree]]) -> pa.RecordBatch:
    columns = [
        pa.array([t[0] for t in trees], pa.int32()), pa.array([t[1] for t in trees], pa.int32()), pa.array([t[2].node for t in trees], pa.list_(pa.int64())),
        pa.array([t[2].column.astype(np.int32) for t in trees], pa.list_(pa.int32())), pa.array([t[2].cut.astype(np.int32) for t in trees], pa.list_(pa.int32())),
        pa.array([t[2].value.reshape(-1) for t in trees], pa.list_(pa.float64())), pa.array([t[2].gain for t in trees], pa.list_(pa.float64())),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_TREES)


# ---- whole experiments ----


def column_edges(values: DataFrame, width: int, *, bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """Bin edges of each fold's training rows, from (fold, train, x): at most ``bins - 1`` quantiles a column."""
    shares = [k / bins for k in range(1, bins)]
    wanted = [F.percentile_approx(F.col("x")[k], shares, 10_000).alias(f"e{k}") for k in range(width)]
    found = values.where("train").groupBy("fold").agg(*wanted).collect()
    return {row["fold"]: [np.unique(row[f"e{k}"] or []) for k in range(width)] for row in found}


def binned(values: DataFrame, edges: Edges) -> DataFrame:
    """(fold, id, train, y, weight, x) rows with the columns as one byte each: the number of edges below the value."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            fold = batch.column("fold").to_numpy()
            out = np.zeros(x.shape, np.uint8)
            for one in np.unique(fold):
                mine = fold == one
                for k, own in enumerate(edges.get(int(one), ())):
                    out[mine, k] = np.searchsorted(own, x[mine, k], "left")
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("fold", "id", "train", "y", "weight")] + [pa.array([r.tobytes() for r in out], pa.binary())], names=["fold", "id", "train", "y", "weight", "bins"])

    return values.select("fold", "id", "train", "y", "weight", "x").mapInArrow(cut, ROWS)


def fit(rows: DataFrame, experiments: Sequence[Experiment], edges: Edges, *, node_rows: int = NODE_ROWS) -> DataFrame:
    """Trees of all experiments, (experiment, tree, node, col, cut, value, gain), from ``binned`` rows; written once.

    A tree may come in parts: one for its nodes above those that a task finished, and one for each of these.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "trees")
    choices = _choices(experiments)
    _grouped(rows, choices, experiments).write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    sums = groups.groupBy("fold", "own").agg(F.count(F.lit(1)).alias("rows"), *_starts(F.col("n")))
    counts = {(row["fold"], row["own"]): row for row in sums.collect()}
    growing, large = [], []
    for number, spec in enumerate(experiments):
        count = counts.get((spec.fold, choices.index(spec.columns)))
        if count is None:
            continue
        root = np.array([count["rows"], *[0] * (_statistics_width(spec.learner) - 1)])
        small = count["rows"] <= node_rows
        if spec.learner.kind == "boosting" and not small:
            large.append((number, count))
        else:
            trees = 1 if spec.learner.kind == "boosting" else spec.learner.trees
            growing += [_Growing(number, t, {}, {1: root}, set(), [], spec.learner) for t in range(trees)]
    _grow_levels(groups, experiments, edges, growing, node_rows)
    tops = [(g.experiment, g.tree, g.shape()) for g in growing if g.closed]
    tops += _boost_levels(groups, experiments, edges, large)
    _finish(groups, experiments, edges, growing).write.parquet(f"{path}/below")
    _tree_frame(spark, tops).write.parquet(f"{path}/above")
    return spark.read.parquet(f"{path}/below", f"{path}/above")


def _starts(n: Column) -> list[Column]:
    """Slope and mass of rows that stand for ``n`` each, in fixed point."""
    return [
        F.sum(F.rint(F.col("weight") * F.col("y") * UNIT).cast("long") * n).alias("slope"),
        F.sum(F.rint(F.col("weight") * UNIT).cast("long") * n).alias("mass"),
    ]


def _boost_levels(groups: DataFrame, experiments: Sequence[Experiment], edges: Edges, large: list[tuple]) -> list[tuple[int, int, Tree]]:
    """Boosting on more rows than a task finishes: all experiments go through a round together, a pass a level."""
    before: dict[int, list[Tree]] = {number: [] for number, _ in large}
    for turn in range(max((experiments[n].learner.trees for n, _ in large), default=0)):
        now = []
        for number, sums in large:
            learner = experiments[number].learner
            if turn < learner.trees:
                start = _start(learner, sums["slope"], sums["mass"])
                now.append(_Growing(number, turn, {}, {1: np.array([sums["rows"], 0, 0, 0])}, set(), before[number], learner, start))
        _grow_levels(groups, experiments, edges, now, 0)
        for one in now:
            before[one.experiment] = [*one.before, one.shape(experiments[one.experiment].learner.rate)]
    return [(number, k, tree) for number, trees in before.items() for k, tree in enumerate(trees)]


def _tree_frame(spark: SparkSession, trees: Sequence[tuple[int, int, Tree]]) -> DataFrame:
    data = [(e, t, one.node.tolist(), one.column.tolist(), one.cut.tolist(), one.value.reshape(-1).tolist(), one.gain.tolist()) for e, t, one in trees]
    return spark.createDataFrame(data, _TREES_DDL)


def joined_tree(parts: Sequence[Tree]) -> Tree:
    """One tree of its parts; where a part goes on below a node, that part's word counts."""
    if len(parts) == 1:
        return parts[0]
    nodes: dict[int, tuple] = {}
    for part in sorted(parts, key=lambda p: int(p.node[0])):
        nodes.update(zip(part.node.tolist(), zip(part.column, part.cut, part.value, part.gain)))
    order = sorted(nodes)
    return Tree(np.array(order, np.int64), *(np.array(v) for v in zip(*(nodes[n] for n in order))))


def whole_trees(found: Iterable[Mapping], learner: Learner) -> dict[int, Tree]:
    """The trees of one experiment by number, from the rows of ``fit``."""
    parts: dict[int, list[Tree]] = {}
    for row in found:
        value = np.array(row["value"])
        value = value.reshape(-1, learner.classes) if learner.classes else value
        parts.setdefault(row["tree"], []).append(Tree(np.array(row["node"]), np.array(row["col"]), np.array(row["cut"]), value, np.array(row["gain"])))
    return {tree: joined_tree(parts[tree]) for tree in sorted(parts)}


def predict(rows: DataFrame, trees: DataFrame, experiments: Sequence[Experiment], *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(experiment, id, p) of the rows outside each experiment's training rows: a chance, or a number for a regression.

    Different rows of a fold and choice of columns are dealt in chunks, meet the trees of each experiment on them, and give their
    answer to all rows like them.
    """
    spark, choices = rows.sparkSession, _choices(experiments)
    starts = {row["fold"]: row for row in rows.where("train").groupBy("fold").agg(*_starts(F.lit(1))).collect()}
    held_out = _by_choice(rows.where("NOT train").select("fold", "id", "bins"), choices, experiments)
    points = held_out.select("fold", "own", "bins").distinct()
    path = scratch_path(spark, "points")
    points.write.parquet(path)
    points = spark.read.parquet(path)
    largest = points.groupBy("fold", "own").count().agg(F.max("count")).first()[0] or 0
    chunks = largest // chunk_rows + 1
    used = [(n, e.fold, choices.index(e.columns)) for n, e in enumerate(experiments) if e.fold in starts]
    known = F.broadcast(spark.createDataFrame(used, "experiment int, fold int, own int"))
    dealt = points.join(known, ["fold", "own"]).withColumn("chunk", F.pmod(F.xxhash64("bins"), F.lit(chunks)).cast("int"))
    whole = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def score(key: tuple, own: pa.Table, rows_: pa.Table) -> pa.Table:
        number = key[0].as_py()
        spec = experiments[number]
        if not rows_.num_rows:
            return pa.table({"experiment": pa.array([], pa.int32()), "fold": pa.array([], pa.int32()), "own": pa.array([], pa.int32()), "bins": pa.array([], pa.binary()), "p": pa.array([], pa.float64())})
        bins = np.frombuffer(b"".join(rows_["bins"].to_pylist()), np.uint8).reshape(rows_.num_rows, -1)
        total = np.zeros(len(bins))
        grown = whole_trees(own.to_pylist(), spec.learner)
        for tree in grown.values():
            total = total + tree.value[tree.leaves(bins)]
        if spec.learner.kind == "boosting":
            total = total + _start(spec.learner, starts[spec.fold]["slope"], starts[spec.fold]["mass"])
            total = total if spec.learner.regression else 1 / (1 + np.exp(-total))
        else:
            total = total / max(len(grown), 1)
        return pa.table({"experiment": pa.array([number] * len(total), pa.int32()), "fold": rows_["fold"], "own": rows_["own"], "bins": rows_["bins"], "p": pa.array(total)})

    scored = whole.groupBy("experiment", "chunk").cogroup(dealt.groupBy("experiment", "chunk")).applyInArrow(score, "experiment int, fold int, own int, bins binary, p double")
    return held_out.join(scored, ["fold", "own", "bins"]).select("experiment", "id", "p")
