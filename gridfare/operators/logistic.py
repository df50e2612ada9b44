"""Ridge logistic regressions for many experiments at once.

An iteration is one pass: each task adds up gradient and curvature of every experiment over its rows, one aggregate merges them,
and the driver takes a Newton step on matrices as wide as the columns. A step is halved until the loss falls.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logistic:
    """Half the squared weights plus ``strength`` times the weighted losses; the intercept is free."""

    strength: float = 1.0
    iterations: int = 50
    tolerance: float = 1e-8


def _design(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return (*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "id", "y", "weight")), x)


def _terms(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of rows, flattened; the last weight is the intercept."""
    full = np.column_stack([x, np.ones(len(x))])
    margin = full @ beta
    chance = 1 / (1 + np.exp(-margin))
    loss = weight @ (np.logaddexp(0, margin) - y * margin)
    curve = (full * (weight * chance * (1 - chance))[:, None]).T @ full
    return np.concatenate([[loss], full.T @ (weight * (chance - y)), curve.ravel()])


def _sums(values: DataFrame, folds: Sequence[int], columns: Sequence[tuple[int, ...]], betas: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Summed terms of the experiments in ``betas``, from one pass over the training rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                fold, _, y, weight, x = _design(batch)
                for number, beta in betas.items():
                    mine = fold == folds[number]
                    if mine.any():
                        found = _terms(x[mine][:, columns[number]], y[mine], weight[mine], beta)
                        held[number] = held[number] + found if number in held else found
        for number, found in held.items():
            size = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([number] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(found)], names=["experiment", "place", "value"])

    parts = values.where("train").mapInArrow(add, "experiment int, place int, value double")
    out = {number: np.zeros(1 + len(beta) + len(beta) ** 2) for number, beta in betas.items()}
    for row in parts.groupBy("experiment", "place").agg(F.sum("value").alias("value")).collect():
        out[row["experiment"]][row["place"]] = row["value"]
    return out


def fit(values: DataFrame, learner: Logistic, folds: Sequence[int], columns: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    """Weights of each experiment, one per (fold, columns), from (fold, id, train, y, weight, x) rows; the intercept is last."""
    betas = {n: np.zeros(len(c) + 1) for n, c in enumerate(columns)}
    steps = {n: np.zeros(len(c) + 1) for n, c in enumerate(columns)}
    best = {n: np.inf for n in betas}
    open_ = set(betas)
    for _ in range(learner.iterations):
        if not open_:
            break
        sums = _sums(values, folds, columns, {n: betas[n] + steps[n] for n in open_})
        for number in sorted(open_):
            beta, size = betas[number] + steps[number], len(betas[number])
            ridge = np.r_[np.ones(size - 1), 0.0]
            loss = learner.strength * sums[number][0] + 0.5 * ridge @ beta**2
            if loss > best[number] + 1e-12 * abs(best[number]):
                steps[number] = steps[number] / 2
                if np.abs(steps[number]).max() < learner.tolerance:
                    open_.discard(number)
                continue
            betas[number], best[number] = beta, loss
            slope = learner.strength * sums[number][1 : 1 + size] + ridge * beta
            curve = learner.strength * sums[number][1 + size :].reshape(size, size) + np.diag(ridge)
            steps[number] = -np.linalg.lstsq(curve, slope, rcond=None)[0]
            if np.abs(steps[number]).max() < learner.tolerance:
                open_.discard(number)
    return [betas[n] for n in range(len(columns))]


def predict(values: DataFrame, numbers: Sequence[int], folds: Sequence[int], columns: Sequence[tuple[int, ...]], betas: Sequence[np.ndarray]) -> DataFrame:
    """(experiment, id, p) of the rows outside the training rows; ``numbers`` are the experiments' own."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, ids, _, _, x = _design(batch)
            for number, own, chosen, beta in zip(numbers, folds, columns, betas):
                mine = fold == own
                if mine.any():
                    p = 1 / (1 + np.exp(-(x[mine][:, chosen] @ beta[:-1] + beta[-1])))
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(p), pa.int32()), pa.array(ids[mine]), pa.array(p)], names=["experiment", "id", "p"])

    return values.where("NOT train").mapInArrow(score, "experiment int, id long, p double")
