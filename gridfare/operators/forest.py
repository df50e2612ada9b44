"""A forest as a pipeline stage that can be saved: fitted by ``trees`` from grouped rows, scored where the rows are."""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfare.operators import trees
from gridfare.operators.trees import Experiment, Learner, Tree
from gridfare.session import scratch_path


class _Named(HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasProbabilityCol, HasSeed):
    """Columns and seed of the estimator and its model."""


class ForestClassifier(Estimator, _Named, DefaultParamsReadable, DefaultParamsWritable):
    """A random forest over labels 0, 1, …; each leaf has the weighted shares of its labels, and trees are averaged."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol="weight", numTrees=20, maxDepth=5, seed=trees.SEED):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(numTrees=20, maxDepth=5, weightCol="weight", seed=trees.SEED)

    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        """All trees together, from rows written once; they come to the driver, at most ``numTrees * 2 ** (maxDepth + 1)`` nodes."""
        label = F.col(self.getLabelCol()).cast("double")
        values = dataset.select(
            F.lit(0).alias("fold"), F.lit(0).cast("long").alias("id"), F.lit(True).alias("train"), label.alias("y"),
            F.coalesce(F.col(self.getWeightCol()).cast("double"), F.lit(0.0)).alias("weight"), vector_to_array(self.getFeaturesCol()).alias("x"),
        ).where("y IS NOT NULL")
        path = scratch_path(dataset.sparkSession, "forest")
        values.write.parquet(path)
        values = dataset.sparkSession.read.parquet(path)
        highest, width = values.agg(F.max("y"), F.max(F.size("x"))).first()
        if highest is None:
            raise ValueError("a forest needs rows")
        classes = max(int(highest) + 1, 2)
        edges = trees.column_edges(values, width)
        learner = Learner("forest", self.getNumTrees(), self.getMaxDepth(), seed=self.getSeed(), classes=classes)
        found = trees.fit(trees.binned(values, edges), [Experiment("forest", "whole", 0, tuple(range(width)), learner)], edges)
        grown = trees.whole_trees(found.collect(), learner)
        return self._copyValues(ForestModel(*_encoded(edges[0], list(grown.values()))))


class ForestModel(Model, _Named, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction``, the label of the largest share."""

    forest = Param(Params._dummy(), "forest", "bin edges and trees", TypeConverters.toString)

    def __init__(self, forest: str | None = None):
        super().__init__()
        if forest is not None:
            self._set(forest=forest)

    @property
    def featureImportances(self) -> DenseVector:
        """How much impurity each column's splits take away, as a share of its tree, averaged over the trees."""
        edges, grown = _decoded(self.getOrDefault(self.forest))
        shares = np.zeros(len(edges))
        for tree in grown:
            inner = tree.column >= 0
            own = np.bincount(tree.column[inner], tree.gain[inner], len(edges))
            shares += own / own.sum() if own.sum() else 0
        return DenseVector(shares / shares.sum() if shares.sum() else shares)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = self.getOrDefault(self.forest)
        held = dataset.sparkSession.sparkContext.broadcast(text)

        @F.arrow_udf("array<double>")
        def share(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            edges, grown = _decoded(held.value)
            classes = grown[0].value.shape[1]
            for batch in batches:
                x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(edges))
                bins = np.stack([np.searchsorted(own, x[:, k], "left") for k, own in enumerate(edges)], axis=1).astype(np.uint8)
                total = np.zeros((len(bins), classes))
                for tree in grown:
                    total += tree.value[tree.leaves(bins)]
                ends = np.arange(len(bins) + 1, dtype=np.int32) * classes
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array((total / len(grown)).reshape(-1)))

        found = dataset.withColumn("_share", share(vector_to_array(self.getFeaturesCol())))
        guess = F.array_position("_share", F.array_max("_share")).cast("double") - 1
        return found.withColumns({self.getProbabilityCol(): array_to_vector("_share"), self.getPredictionCol(): guess}).drop("_share")


def _encoded(edges: list[np.ndarray], grown: list[Tree]) -> tuple[str]:
    """Text of all arrays, one behind the other."""
    file = io.BytesIO()
    np.savez_compressed(
        file, edges=np.concatenate([*edges, np.zeros(0)]), widths=[len(e) for e in edges], sizes=[len(t.node) for t in grown],
        node=np.concatenate([t.node for t in grown]), column=np.concatenate([t.column for t in grown]), cut=np.concatenate([t.cut for t in grown]),
        value=np.concatenate([t.value for t in grown]), gain=np.concatenate([t.gain for t in grown]),
    )
    return (base64.b64encode(file.getvalue()).decode(),)


def _decoded(text: str) -> tuple[list[np.ndarray], list[Tree]]:
    held = np.load(io.BytesIO(base64.b64decode(text)))
    edges = np.split(held["edges"], np.cumsum(held["widths"])[:-1])
    cuts = np.cumsum(held["sizes"])[:-1]
    parts = [np.split(held[c], cuts) for c in ("node", "column", "cut", "value", "gain")]
    return edges, [Tree(*one) for one in zip(*parts)]
