"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-random rotation (three rounds of random signs and a fast Hadamard transform) and
assigned to the nearest of the signed axes. A table joins two such axes to one bucket. A query probes the ``probes``
likeliest buckets of each table, and what lies there is ranked by its exact distance. Queries that find too few rows there
meet all vectors in a second pass.

Vectors are dealt out by a hash of their id into blocks of about ``block_rows``, each with its own tables, and queries into
slices of about ``slice_rows``; a block meets every slice, and only the nearest of each query leave the pair. A task is
bounded however many vectors share a bucket, and no list of candidate pairs is ever written. Identical vectors cannot all be
among the ten nearest: of each different vector the ``k + 1`` smallest ids are indexed, which loses nothing, and identical
queries are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from gridfare.session import checkpointed

TABLES, PROBES, BLOCK_ROWS, SLICE_ROWS = 24, 256, 16_384, 4_096
#: Queries whose probes are worked out together.
TOGETHER = 64


def _padded(dims: int) -> int:
    return 1 << max(dims - 1, 1).bit_length()


def rotate(vectors: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-random rotation ``number`` of the rows, whose length is a power of two."""
    dims = vectors.shape[1]
    signs = np.random.default_rng(number).choice(np.array([-1.0, 1.0]), size=(3, dims))
    turned = vectors
    for round_signs in signs:
        turned = turned * round_signs
        width = 1
        while width < dims:
            pairs = turned.reshape(-1, dims // (2 * width), 2, width)
            turned = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(-1, dims)
            width *= 2
        turned = turned / np.sqrt(dims)
    return turned


def _padded_units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, with zeros up to a power of two."""
    rows = np.zeros((len(vectors), _padded(vectors.shape[1])))
    rows[:, : vectors.shape[1]] = vectors
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _units(batch: pa.Array, dims: int) -> np.ndarray:
    return _padded_units(np.array(batch.to_pylist(), dtype=np.float64).reshape(-1, dims))


def _answers(units: np.ndarray, number: int) -> np.ndarray:
    """How near each row is to every signed axis: the positive ones, then the negative ones."""
    turned = rotate(units, number)
    return np.concatenate([turned, -turned], axis=1)


def buckets(vector: Column, dims: int, tables: int) -> Column:
    """array<int>: the bucket of each table, its two axes in one number."""

    @arrow_udf("array<int>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            units = _units(batch, dims)
            axes = 2 * units.shape[1]
            pairs = ((_answers(units, 2 * t).argmax(axis=1), _answers(units, 2 * t + 1).argmax(axis=1)) for t in range(tables))
            codes = np.stack([a * axes + b for a, b in pairs], axis=1).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))

    return hashed(vector)


def probed(units: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The likeliest buckets of a table for each query: those whose two axes it is nearest to, by the sum of both."""
    both = _answers(units, 2 * table)[:, :, None] + _answers(units, 2 * table + 1)[:, None, :]
    flat = both.reshape(len(units), -1)
    return np.argpartition(-flat, min(probes, flat.shape[1]) - 1, axis=1)[:, :probes]


def candidates(codes: np.ndarray, units: np.ndarray, probes: int) -> np.ndarray:
    """For each query which rows of a block lie in a probed bucket of any table; ``codes`` has a column per table."""
    found = np.zeros((len(units), len(codes)), bool)
    for table in range(codes.shape[1]):
        order = np.argsort(codes[:, table], kind="stable")
        ranked = codes[order, table]
        wanted = probed(units, table, probes)
        begins, ends = np.searchsorted(ranked, wanted), np.searchsorted(ranked, wanted, "right")
        for query in range(len(units)):
            sizes = ends[query] - begins[query]
            at = np.repeat(begins[query] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            found[query, order[at]] = True
    return found


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: no null, empty or zero vector, no null or non-finite component.

    A negative zero counts as zero. Rows without an id take no part either.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))


def nearest(
    queries: DataFrame, vectors: DataFrame, dims: int, *, k: int = 10, tables: int = TABLES, probes: int = PROBES,
    block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by Euclidean distance, ties to the smaller id.

    Both inputs are (vec_id, vector) as from :func:`usable`; vectors of other lengths than ``dims`` take no part. A query
    never finds its own id, and has k rows, or all other vectors if they are fewer. Probing runs when this is called, to see
    which queries it leaves short.
    """
    fits = F.size("vector") == dims
    place = Window.partitionBy("vector").orderBy("vec_id")
    once = vectors.where(fits).withColumn("_copy", F.row_number().over(place)).where(F.col("_copy") <= k + 1).drop("_copy")
    wanted = queries.where(fits).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("wanted"))
    asked = wanted.groupBy("wanted").agg(F.min("query_id").alias("group_id"))

    def parts(rows: DataFrame, size: int) -> Column:
        return F.greatest(F.ceil(rows.agg(F.count(F.lit(1))).scalar() / size).cast("int"), F.lit(1))

    blocks = parts(vectors, block_rows)

    def all_of(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    block = F.pmod(F.xxhash64("vec_id"), blocks).cast("int")
    by_distance = Window.partitionBy("group_id").orderBy("score", "vec_id")

    def found_by(some: DataFrame, slices: Column, probing: bool) -> DataFrame:
        """(group_id, vec_id, score) of the k + 1 nearest rows in probed buckets, or of all rows."""
        stored = once.withColumn("codes", buckets(F.col("vector"), dims, tables)) if probing else once
        stored = stored.withColumns({"block": block, "slice": all_of(slices)})
        asking = some.withColumns({"block": all_of(blocks), "slice": F.pmod(F.xxhash64("group_id"), slices).cast("int")})
        # Both sides come from the same tables; new names keep their columns apart.
        stored, asking = stored.toDF(*stored.columns), asking.toDF(*asking.columns)
        met = asking.groupBy("block", "slice").cogroup(stored.groupBy("block", "slice"))
        near = met.applyInPandas(rank_group, "group_id long, vec_id long, score double")
        near = near.groupBy("group_id", "vec_id").agg(F.min("score").alias("score"))
        return near.withColumn("_at", F.row_number().over(by_distance)).where(F.col("_at") <= k + 1).drop("_at")

    def rank_group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        groups, ids, scores = [], [], []
        if len(left) and len(right):
            own = right["vec_id"].to_numpy()
            codes = np.stack(right["codes"].to_numpy()) if "codes" in right else None
            matrix, asked_for = np.stack(right["vector"].to_numpy()), np.stack(left["wanted"].to_numpy())
            for begin in range(0, len(left), TOGETHER):
                some = asked_for[begin : begin + TOGETHER]
                hits = np.ones((len(some), len(own)), bool) if codes is None else candidates(codes, _padded_units(some), probes)
                for number, vector in enumerate(some):
                    at = np.flatnonzero(hits[number])
                    gaps = np.sqrt(((matrix[at] - vector) ** 2).sum(axis=1))
                    first = np.lexsort((own[at], gaps))[: k + 1]
                    groups.append(np.full(len(first), left["group_id"].iloc[begin + number]))
                    ids.append(own[at][first])
                    scores.append(gaps[first])
        shape = {"group_id": (groups, np.int64), "vec_id": (ids, np.int64), "score": (scores, np.float64)}
        return pd.DataFrame({n: np.concatenate(v) if v else np.zeros(0, kind) for n, (v, kind) in shape.items()})

    best = checkpointed(found_by(asked, parts(queries, slice_rows), True))
    full = best.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    short = checkpointed(asked.join(full, "group_id", "left_anti"))
    if not short.isEmpty():
        whole = found_by(short, parts(short, slice_rows), False)
        best = best.join(short.select("group_id"), "group_id", "left_anti").unionByName(whole)

    # Each query takes the answer of its vector without itself.
    who = wanted.join(asked, "wanted").select("query_id", "group_id").distinct()
    answers = best.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    mine = who.join(answers, "group_id")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    placed = mine.select("query_id", F.posexplode(others).alias("at", "hit"))
    return placed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def dimensions(vectors: DataFrame) -> int:
    """The commonest length of a vector, the smaller of equally common ones; 1 for an empty table."""
    sizes = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return int(sizes["n"]) if sizes else 1
