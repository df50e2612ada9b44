"""Streaming jobs against their batch definitions, and the learners' invariants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gridfare.operators import metrics, models
from gridfare.operators.trees import Learner
from gridfare.plans import catalog
from gridfare.plans import fixtures as fx
from gridfare.streaming import jobs, leases

T0 = dt.datetime(2024, 1, 1, 12)


def _events(spark, *rows):
    typed = [(i, T0 + dt.timedelta(seconds=s), image, user, action, 0) for i, (s, image, user, action) in enumerate(rows)]
    return spark.createDataFrame(typed, "event_id long, ts timestamp, image_id long, user string, action string, count long")


def _seconds(rows):
    return sorted((r["image_id"], r["holder"], (r["granted_at"] - T0).total_seconds(), (r["ended_at"] - T0).total_seconds(), r["reason"]) for r in rows)


CASES = [
    (0, 1, "a", "lock"), (30, 1, "b", "lock"), (100, 1, "a", "heartbeat"), (279, 1, "b", "lock"), (280, 1, "b", "lock"),
    (300, 1, "b", "unlock"), (301, 1, "b", "heartbeat"), (302, 1, "c", "lock"), (303, 1, "d", "unlock"),
    (304, 1, "e", "force_unlock"), (5, 2, "a", "heartbeat"), (10, 2, "a", "lock"), (900, 2, "z", "lock"),
]
LEASES = [
    (1, "a", 0.0, 280.0, "expired"), (1, "b", 280.0, 300.0, "unlock"), (1, "c", 302.0, 304.0, "force_unlock"),
    (2, "a", 10.0, 190.0, "expired"), (2, "z", 900.0, 1080.0, "expired"),
]


def test_leases(spark):
    assert _seconds(leases.lock_leases(_events(spark, *CASES)).collect()) == LEASES


def test_streamed_leases_equal_the_batch(spark, sf, tmp_path):
    events = fx.annotation_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    late = spark.createDataFrame(
        [(10**9, dt.datetime(2025, 1, 1), -1, "u", "lock", 0), (10**9 + 1, dt.datetime(2025, 2, 1), -1, "u", "lock", 0)],
        events.select("event_id", "ts", "image_id", "user", "action", "count").schema,
    )
    source = str(tmp_path / "in")
    whole = events.select("event_id", "ts", "image_id", "user", "action", "count")
    # Files in time order, then two that move the watermark past every lease.
    bounds = [None, "2024-01-08", "2024-01-15", "2024-01-22", None]
    for low, high in zip(bounds, bounds[1:]):
        part = whole if low is None else whole.where(F.col("ts") >= low)
        part = part if high is None else part.where(F.col("ts") < high)
        part.coalesce(1).write.mode("append").parquet(source)
    for when in ("2025-01-01", "2025-02-01"):
        late.where(F.to_date("ts") == when).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    leased = leases.stream_lock_leases(stream, seconds=6 * 3600)
    jobs.run_append(leased, out, str(tmp_path / "state")).awaitTermination()
    found = spark.read.schema(leases.OUTPUT).parquet(out).where("image_id >= 0")
    expected = leases.lock_leases(whole, seconds=6 * 3600)
    assert sorted(found.collect()) == sorted(expected.collect())


def test_debounce(spark):
    rows = [(0, 1, "a", "save"), (1, 1, "a", "save"), (1, 1, "b", "save"), (9, 1, "a", "save"), (9, 1, "a", "lock")]
    saved = jobs.autosave_debounce(_events(spark, *rows), gap="3 seconds").collect()
    assert sorted((r["user"], r["event_id"], r["merged"]) for r in saved) == [("a", 1, 2), ("a", 3, 1), ("b", 2, 1)]


def test_append_mode_closes_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(T0 + dt.timedelta(hours=h), "ok" if h % 2 else "empty") for h in range(24)]
    spark.createDataFrame(rows, "ts timestamp, status string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, status string").parquet(source)
    windows = jobs.fare_rate_windows(stream, lateness="1 hour")
    jobs.run_append(windows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out")).collect()
    assert closed and all(r["attempted"] == 3 for r in closed)


def test_no_player_images_start_at_zero(spark):
    df = spark.createDataFrame([("img_250.jpg", 3), ("img_251.jpg", 3), ("img_287.jpg", None), ("img_288.jpg", None)], "image string, count int")
    assert [r["count"] for r in jobs.no_player_default(df).collect()] == [3, 0, 0, None]


# ---- models ----


def test_areas_of_one_class_are_half(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    assert tuple(metrics.curve_areas(df, "y", "s").first()) == (0.5, 0.5)


def test_areas_against_loops(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 60, 400) / 60
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    row = metrics.curve_areas(df, "y", "s").first()
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    assert row["roc_auc"] == pytest.approx(((pos > neg) + 0.5 * (pos == neg)).mean())
    steps, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = (y[hit] == 1).sum() / (y == 1).sum()
        steps += (recall - last) * (y[hit] == 1).mean()
        last = recall
    assert row["pr_auc"] == pytest.approx(steps)


def test_rounding_is_half_even_and_clipped(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-3.0,), (99.0,)], "p double")
    assert [r["rounded"] for r in metrics.round_and_clip(df, "p", highest=9).collect()] == [0, 2, 2, 0, 9]


def test_pca_keeps_the_fewest_components(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 3)) * [10, 3, 0.1]
    df = spark.createDataFrame([(Vectors.dense(r),) for r in data.tolist()], ["features"])
    assert models.pca_by_variance(df, 0.5)[1] == 1
    assert models.pca_by_variance(df, 0.99)[1] == 2
    assert models.pca_by_variance(df, 0.999999)[1] == 3


def test_ridge_matches_the_normal_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = x @ [2.0, -1.0] + 4 + rng.normal(size=80)
    rows = [(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), y)]
    model = models.count_regressors(80, float(y.std()), alpha=5.0)["ridge"].fit(spark.createDataFrame(rows, ["features", "count"]))
    centred, target = x - x.mean(0), y - y.mean()
    expected = np.linalg.solve(centred.T @ centred + 5.0 * np.eye(2), centred.T @ target)
    assert np.allclose(model.coefficients.toArray(), expected, atol=1e-4)


def test_each_cell_is_scored_once_out_of_fold(spark, sf):
    scored = catalog.QUERIES["oof_predict"](spark, sf)
    assert scored.count() == scored.select("image", "cell_id").distinct().count() == fx.cells(spark, sf).count()
    assert scored.where("p < 0 OR p > 1 OR p IS NULL").count() == 0


def test_a_failed_experiment_is_reported(spark):
    rows = [(f, float(i), i % 2) for f in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "fold_id int, x double, player_present int")
    broken, good = Learner("forest", 2, depth="deep"), models.presence_learners()["logistic"]
    table = models.experiment_grid(df, ["x"], models={"bad": broken, "good": good}, settings={"whole": None}, folds=(1, 2)).collect()
    assert [r["model"] for r in table] == ["good", "bad"] and table[1]["error"] and table[0]["error"] is None


def test_bundle(spark, sf):
    assert catalog.QUERIES["save_bundle"](spark, sf).count() == fx.cells(spark, sf).count()


@pytest.mark.parametrize("name", ["oof_predict", "two_stage_counts", "fit_final"])
def test_learner_queries_fit_the_full_numbers(spark, sf, monkeypatch, name):
    class Reached(Exception):
        pass

    def numbers(found):
        assert found["forest"].getNumTrees() == 150 and found["boosting"].getMaxIter() == 100
        raise Reached

    classifiers = models.presence_classifiers
    monkeypatch.setattr(models, "presence_classifiers", lambda **settings: numbers(classifiers(**settings)))
    with pytest.raises(Reached):
        catalog.QUERIES[name](spark, sf)


@pytest.mark.parametrize("name, chosen, operator", [
    ("presence_classifiers", "presence_learners", "cross_fit"), ("experiment_grid", "presence_learners", "experiment_grid"), ("count_regressors", "count_learners", "cross_fit_counts"),
])
def test_cross_fitted_queries_fit_the_full_numbers(spark, sf, monkeypatch, name, chosen, operator):
    """Whole folds and settings, 150 trees, 100 rounds."""

    class Reached(Exception):
        pass

    def seen(*args, **settings):
        found = next((a for a in args if isinstance(a, dict)), None) or settings.get("models") or getattr(models, chosen)()
        assert {found[n].trees for n in ("forest", "extra_trees")} == {150} and found["boosting"].trees == 100
        assert "folds" not in settings and "settings" not in settings
        raise Reached

    monkeypatch.setattr(models, operator, seen)
    monkeypatch.setattr(models, "oof_counts", lambda *a, **s: None)
    with pytest.raises(Reached):
        catalog.QUERIES[name](spark, sf)


def test_team_query_has_every_fold(spark, sf, monkeypatch):
    assert models.team_classifier.__kwdefaults__["trees"] == 100
    asked = []

    def fitted(train, columns, **settings):
        assert "trees" not in settings
        asked.append(sorted(r[0] for r in train.select("fold_id").distinct().collect()))
        return SQLTransformer(statement="SELECT *, 0D AS prediction FROM __THIS__")

    monkeypatch.setattr(models, "team_classifier", fitted)
    catalog.QUERIES["team_classifier"](spark, sf)
    assert asked == [[f for f in models.FOLDS if f != fold] for fold in models.FOLDS]
