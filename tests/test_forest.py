"""The forest that is a pipeline stage: shares of several labels, importances, saving."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array

from gridfare.operators import models, trees
from gridfare.operators.forest import ForestClassifier, ForestModel


@pytest.fixture(scope="module")
def cells(spark):
    """Three labels told by one column, one that says nothing, missing values; every row occurs 40 times."""
    rng = np.random.default_rng(8)
    rows = [(float(a), None if i % 7 == 0 else float(b), int(np.digitize(a, [-0.5, 0.5])) * 2) for i, (a, b) in enumerate(rng.normal(size=(200, 2)).round(2))]
    return spark.createDataFrame(rows * 40, "a double, b double, label long").repartition(4)


def test_forest_of_several_labels(spark, cells, tmp_path):
    model = models.team_classifier(cells, ["a", "b"], trees=12, depth=5)
    assert isinstance(model.stages[-1], ForestModel)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    rows = [m.transform(cells).select("a", "label", "prediction", vector_to_array("probability").alias("p")).orderBy("a", "label").collect() for m in (model, loaded)]
    assert rows[0] == rows[1] and len(rows[0]) == 8_000
    assert np.mean([r["prediction"] == r["label"] for r in rows[0]]) > 0.97
    assert all(len(r["p"]) == 5 and abs(sum(r["p"]) - 1) < 1e-9 and int(np.argmax(r["p"])) == r["prediction"] for r in rows[0])
    shares = model.stages[-1].featureImportances.toArray()
    assert abs(shares.sum() - 1) < 1e-9 and shares[0] > 0.6
    table = models.feature_importance(spark, model, ["a", "b"]).collect()
    assert [r["feature"] for r in table] == ["a", "b"]


def test_forest_grows_from_different_rows_only(spark, cells, monkeypatch):
    """The rows of a tree are the 200 different ones, not all 8,000."""
    counted = []
    written = trees._grouped
    monkeypatch.setattr(trees, "_grouped", lambda *a: counted.append(written(*a)) or counted[-1])
    model = models.team_classifier(cells, ["a", "b"], trees=2, depth=3)
    assert 100 < counted[0].count() <= 200 and len(model.stages) == 2


def test_two_labels_share_like_the_mean():
    """With classes a leaf has the shares that one slope gives as a mean, and the same splits."""
    rng = np.random.default_rng(9)
    bins, y, weight = rng.integers(0, 64, (600, 3)).astype(np.uint8), rng.integers(0, 2, 600).astype(float), rng.integers(1, 3, 600).astype(float)
    seen, edges = np.ones(600, np.int64), [np.arange(63.0)] * 3
    plain, classes = (trees.Learner("forest", 1, 5, "all", classes=c) for c in (0, 2))
    a, b = (trees.grow(one, 0, bins, trees.statistics(one, seen, y, weight), edges) for one in (plain, classes))
    assert a.node.tolist() == b.node.tolist() and a.column.tolist() == b.column.tolist() and a.cut.tolist() == b.cut.tolist()
    assert np.allclose(a.value, b.value[:, 1]) and np.allclose(b.value.sum(axis=1), 1)


def test_forest_counts_and_depth():
    forest = ForestClassifier(numTrees=7, maxDepth=3)
    assert forest.getNumTrees() == 7 and forest.copy({forest.featuresCol: "reduced"}).getFeaturesCol() == "reduced"
