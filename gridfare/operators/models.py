"""The two-stage model: cell presence, probability maps, image counts.

Preparation is computed from training rows only and expressed as pipeline stages, so a saved model carries it.
Loops over folds and experiments run on the driver; each step is a distributed fit or transform.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfare.functions.ranking import exact_quantiles
from gridfare.operators import components as comp
from gridfare.operators import logistic, trees
from gridfare.operators.forest import ForestClassifier
from gridfare.operators.logistic import Logistic
from gridfare.operators.metrics import binary_metrics, count_metrics, curve_areas, round_and_clip
from gridfare.operators.trees import Experiment, Learner
from gridfare.session import checkpointed, scratch_path

FOLDS = (1, 2, 3, 4)
PCA_SETTINGS: dict[str, float | None] = {"whole": None, "share_90": 0.90, "share_95": 0.95, "share_98": 0.98}
METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
COUNT_METRICS = ["mae", "rmse", "exact_acc", "pm1_acc"]
BUNDLE_KEYS = ["model1_pipeline", "model1_threshold", "model2_model", "cell_feature_cols", "count_feature_cols"]
SEED = 42
#: Deepest trees of a forest; Spark wants a bound and allows 30 at most.
FOREST_DEPTH = 10


def image_folds(df: DataFrame, fold: int, *, column: str = "fold_id") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows; an image has one fold, so its cells stay together."""
    return df.where(F.col(column) != fold), df.where(F.col(column) == fold)


def balanced_weights(df: DataFrame, label: str, *, train: DataFrame | None = None, into: str = "weight") -> DataFrame:
    """Add ``n / (classes * n_class)``, counted on the training rows; with two classes that is ``n / (2 * n_class)``.

    The weights are one small map, looked up per row: no join on a label that most rows share.
    """
    counts = (df if train is None else train).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.agg(
        F.collect_list(F.struct(F.col(label), F.col("n"))).alias("c"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")
    )
    weights = pairs.select(
        F.map_from_entries(
            F.transform("c", lambda e: F.struct(e[label], F.col("t") / (F.col("k") * e["n"])))
        )
    ).scalar()
    return df.withColumn("_w", weights).select(*[c for c in df.columns if c != into], F.try_element_at("_w", F.col(label)).alias(into))


def column_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of the training rows; one number per column comes to the driver."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "c", "x")
    found = exact_quantiles(long.where(~F.isnan("x")), ["c"], "x", {"m": 0.5}).collect()
    medians = {row["c"]: float(row["m"]) for row in found}
    return {c: medians.get(c, 0.0) for c in columns}


def impute_median(
    df: DataFrame, columns: Sequence[str], *, train: DataFrame | None = None
) -> DataFrame:
    """Missing values replaced by the training median of their column."""
    medians = column_medians(df if train is None else train, columns)
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) for c, m in medians.items()})


def column_scales(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a zero deviation becomes 1, which leaves only the shift."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"m|{c}"), F.stddev_pop(c).alias(f"s|{c}"))]
    row = train.agg(*aggs).first()
    return {c: (float(row[f"m|{c}"]), float(row[f"s|{c}"]) or 1.0) for c in columns}


def standardise(df: DataFrame, columns: Sequence[str], *, train: DataFrame | None = None) -> DataFrame:
    scales = column_scales(df if train is None else train, columns)
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()})


def preparation(train: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """Median imputation and standardising as a saveable pipeline that adds the vector ``features``."""
    medians = column_medians(train, columns)
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in columns])
    scales = column_scales(filled, columns)
    scaled = ", ".join(
        f"(coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {medians[c]!r}D) - {scales[c][0]!r}D) / {scales[c][1]!r}D AS `_z_{c}`"
        for c in columns
    )
    shape = SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")
    gather = VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol="features")
    drop = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'`_z_{c}`' for c in columns)}) FROM __THIS__")
    return PipelineModel(stages=[shape, gather, drop])


def fitted_pca(prepared: DataFrame, *, features: str = "features", into: str = "reduced"):
    """All components of the training rows."""
    size = len(prepared.select(features).first()[0])
    return PCA(k=size, inputCol=features, outputCol=into).fit(prepared)


def components_for(shares: Sequence[float], target: float) -> int:
    """The fewest components whose explained share exceeds ``target``."""
    reached = 0.0
    for i, share in enumerate(shares):
        reached += share
        if reached > target:
            return i + 1
    return len(shares)


def pca_by_variance(prepared: DataFrame, target: float, *, features: str = "features", into: str = "reduced"):
    """Fitted PCA stages that keep the fewest components whose explained share exceeds ``target``, and that number."""
    fitted = fitted_pca(prepared, features=features, into=f"_{into}")
    keep = components_for(fitted.explainedVariance.toArray(), target)
    cut = VectorSlicer(inputCol=f"_{into}", outputCol=into, indices=list(range(keep)))
    return PipelineModel(stages=[fitted, cut]), keep


def presence_classifiers(
    *, features: str = "features", label: str = "player_present", weight: str = "weight", trees: int = 150, rounds: int = 100,
    depth: int = FOREST_DEPTH,
) -> dict[str, Estimator]:
    """Logistic regression, forest and boosting as estimators to be saved in a pipeline; ``presence_learners`` has extra trees too."""
    common = {"featuresCol": features, "labelCol": label, "weightCol": weight}
    forest = {**common, "numTrees": trees, "maxDepth": depth, "seed": SEED}
    return {
        "logistic": LogisticRegression(**common, maxIter=500, standardization=False),
        "forest": ForestClassifier(**forest),
        "boosting": GBTClassifier(**common, maxIter=rounds, maxDepth=3, stepSize=0.1, seed=SEED),
    }


def fit_presence(
    train: DataFrame,
    estimator: Estimator,
    columns: Sequence[str],
    *,
    label: str = "player_present",
    variance: float | None = None,
    prepared: PipelineModel | None = None,
    strength: float = 1.0,
) -> tuple[PipelineModel, int | None]:
    """Preparation, optional PCA and a classifier, all from the training rows.

    ``prepared`` hands in the preparation when several models share their training rows. A logistic regression has a
    ridge penalty: half the squared weights against ``strength`` times the summed weighted losses. Spark averages the
    losses, and balanced weights add up to the number of rows, so its parameter is one over ``strength`` times that.
    """
    held = train.select(*columns, label).persist()
    try:
        return _fit_presence(held, estimator, columns, label, variance, prepared, strength)
    finally:
        held.unpersist()


def _fit_presence(
    held: DataFrame, estimator: Estimator, columns: Sequence[str], label: str, variance: float | None, prepared: PipelineModel | None, strength: float
) -> tuple[PipelineModel, int | None]:
    prep = prepared or preparation(held, columns)
    stages: list[Transformer] = [prep]
    ready, kept = prep.transform(held), None
    features = "features"
    if variance is not None:
        reduce_, kept = pca_by_variance(ready, variance)
        stages.append(reduce_)
        ready, features = reduce_.transform(ready), "reduced"
    weighted = balanced_weights(ready, label, train=held).select(features, label, "weight").persist()
    settings = {estimator.featuresCol: features}
    try:
        if isinstance(estimator, LogisticRegression):
            settings[estimator.regParam] = 1.0 / (strength * max(weighted.count(), 1))
        model = estimator.copy(settings).fit(weighted)
    finally:
        weighted.unpersist()
    return PipelineModel(stages=[*stages, model]), kept


def positive_probability(scored: DataFrame, *, into: str = "p") -> DataFrame:
    return scored.withColumn(into, vector_to_array("probability")[1])


def oof_predict(
    cells: DataFrame,
    estimator: Estimator,
    columns: Sequence[str],
    *,
    keep: Sequence[str],
    label: str = "player_present",
    variance: float | None = None,
    folds: Sequence[int] = FOLDS,
    materialise: bool = True,
    prepared: Mapping[int, PipelineModel] | None = None,
) -> DataFrame:
    """Every row scored by the model of the folds it is not in.

    Training passes over its rows many times, so they are written once to the shared folder unless the caller has.
    ``prepared`` has the preparation of each fold when several calls share them.
    """
    needed = list(dict.fromkeys([*columns, *keep, label, "fold_id"]))
    data = checkpointed(cells.select(*needed)) if materialise else cells
    scored = []
    for fold in folds:
        train, valid = image_folds(data, fold)
        ready = (prepared or {}).get(fold)
        model, _ = fit_presence(train, estimator, columns, label=label, variance=variance, prepared=ready)
        scored.append(positive_probability(model.transform(valid)).select(*keep, "p"))
    return reduce(DataFrame.unionByName, scored)


def presence_learners(*, trees: int = 150, rounds: int = 100, depth: int = FOREST_DEPTH) -> dict[str, Learner | Logistic]:
    """Logistic regression, forest, extra trees and boosting, for all folds and settings at once."""
    return {
        "logistic": Logistic(),
        "forest": Learner("forest", trees, depth),
        "extra_trees": Learner("extra_trees", trees, depth),
        "boosting": Learner("boosting", rounds, 3, share="all"),
    }


class FoldValues(NamedTuple):
    """Rows for every held-out fold: (fold, id, train, y, weight, x), written once.

    ``x`` has the prepared columns and, behind them, all principal components; ``kept`` has how many a fold and setting use.
    """

    rows: DataFrame
    width: int
    kept: dict[tuple[int, str], tuple[int, ...]]


def fold_values(
    data: DataFrame, columns: Sequence[str], label: str, folds: Sequence[int], settings: Mapping[str, float | None]
) -> FoldValues:
    """Preparation, components and balanced weights of each fold, from its training rows; ``data`` has ``id`` and ``fold_id``."""
    size, kept, parts = len(columns), {}, []
    for fold in folds:
        train, _ = image_folds(data, fold)
        prep = preparation(train, columns)
        ready = prep.transform(data)
        x = vector_to_array("features")
        if any(target is not None for target in settings.values()):
            reduce_ = fitted_pca(prep.transform(train))
            ready = reduce_.transform(ready)
            x = F.concat(x, vector_to_array("reduced"))
        for setting, target in settings.items():
            chosen = range(size) if target is None else range(size, size + components_for(reduce_.explainedVariance.toArray(), target))
            kept[fold, setting] = tuple(chosen)
        weighted = balanced_weights(ready, label, train=train)
        parts.append(
            weighted.select(
                F.lit(fold).alias("fold"), "id", (F.col("fold_id") != fold).alias("train"), F.col(label).cast("double").alias("y"),
                F.coalesce("weight", F.lit(0.0)).alias("weight"), x.alias("x"),
            )
        )
    width = size * (1 + any(target is not None for target in settings.values()))
    return FoldValues(_written(reduce(DataFrame.unionByName, parts), "fold-values"), width, kept)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fit_experiments(values: FoldValues, experiments: Sequence[Experiment]) -> DataFrame:
    """(experiment, id, p) of every row, from the model of the folds that it is not in.

    Experiments that differ in name only, as settings that keep the same components do, are fitted once.
    """
    same: dict[tuple, list[int]] = {}
    for n, e in enumerate(experiments):
        same.setdefault((e.fold, e.columns, e.learner), []).append(n)
    firsts = [experiments[numbers[0]] for numbers in same.values()]
    scored = []
    grown = [(n, e) for n, e in enumerate(firsts) if isinstance(e.learner, Learner)]
    if grown:
        edges = trees.column_edges(values.rows, values.width)
        rows = _written(trees.binned(values.rows, edges), "binned")
        own = [e for _, e in grown]
        numbers = F.array(*[F.lit(n) for n, _ in grown])
        found = trees.predict(rows, trees.fit(rows, own, edges), own)
        scored.append(found.withColumn("experiment", F.element_at(numbers, F.col("experiment") + 1)))
    for learner in dict.fromkeys(e.learner for e in firsts if isinstance(e.learner, Logistic)):
        numbers, folds, chosen = zip(*((n, e.fold, e.columns) for n, e in enumerate(firsts) if e.learner == learner))
        betas = logistic.fit(values.rows, learner, folds, chosen)
        scored.append(logistic.predict(values.rows, numbers, folds, chosen, betas))
    everyone = F.array(*[F.array(*map(F.lit, numbers)) for numbers in same.values()])
    return reduce(DataFrame.unionByName, scored).withColumn("experiment", F.explode(F.element_at(everyone, F.col("experiment") + 1)))


def cross_fit(
    cells: DataFrame,
    columns: Sequence[str],
    models: Mapping[str, Learner | Logistic],
    *,
    settings: Mapping[str, float | None] | None = None,
    keep: Sequence[str] = (),
    label: str = "player_present",
    folds: Sequence[int] = FOLDS,
) -> DataFrame:
    """(model, pca, label, fold_id, kept columns…, p): every row scored by each model and setting of the folds it is not in.

    All experiments share their preparation and their passes over the rows.
    """
    settings = {"whole": None} if settings is None else settings
    needed = list(dict.fromkeys([*columns, *keep, label, "fold_id"]))
    data = _written(cells.select(*needed).withColumn("id", F.monotonically_increasing_id()), "cells")
    values = fold_values(data, columns, label, folds, settings)
    experiments = [
        Experiment(name, setting, fold, values.kept[fold, setting], learner)
        for name, learner in models.items() for setting in settings for fold in folds
    ]
    names = F.array(*[F.struct(F.lit(e.model).alias("model"), F.lit(e.setting).alias("pca")) for e in experiments])
    scored = _written(fit_experiments(values, experiments), "scored")
    named = scored.withColumn("_e", F.element_at(names, F.col("experiment") + 1)).select("_e.model", "_e.pca", "id", "p")
    return named.join(data.select("id", *dict.fromkeys([*keep, label, "fold_id"])), "id").drop("id")


def fold_metrics(scored: DataFrame, label: str = "player_present") -> DataFrame:
    """Metrics of ``cross_fit`` rows per model, setting and fold."""
    keys = ["model", "pca", "fold_id"]
    return binary_metrics(scored, label, "p", keys=keys).join(curve_areas(scored, label, "p", keys=keys), keys)


def experiment_grid(
    cells: DataFrame,
    columns: Sequence[str],
    *,
    models: Mapping[str, Learner | Logistic] | None = None,
    settings: Mapping[str, float | None] = PCA_SETTINGS,
    label: str = "player_present",
    folds: Sequence[int] = FOLDS,
) -> DataFrame:
    """Mean out-of-fold metrics per model and PCA setting, best F1 first. A failed experiment is a row with its error.

    All experiments run together; only if that fails does each run alone, so that one cannot take the others with it.
    """
    spark = cells.sparkSession
    chosen = presence_learners() if models is None else models

    def run(some: Mapping[str, Learner | Logistic], own: Mapping[str, float | None]) -> list[tuple]:
        scored = cross_fit(cells, columns, some, settings=own, label=label, folds=folds)
        means = fold_metrics(scored, label).groupBy("model", "pca").agg(*[F.avg(m).alias(m) for m in METRICS])
        return [(*row, None) for row in means.collect()]

    try:
        rows = run(chosen, settings)
    except Exception:  # noqa: BLE001 - found out one by one below
        rows = []
        for name, learner in chosen.items():
            for setting, target in settings.items():
                try:
                    rows += run({name: learner}, {setting: target})
                except Exception as problem:  # noqa: BLE001 - the grid goes on and reports it
                    rows.append((name, setting, *[None] * len(METRICS), str(problem)))
    shape = "model string, pca string, " + ", ".join(f"{m} double" for m in METRICS) + ", error string"
    return spark.createDataFrame(rows, shape).orderBy(F.desc_nulls_last("f1"), "model", "pca")


# ---- counts ----


def count_regressors(
    n: int, deviation: float, *, trees: int = 150, rounds: int = 100, alpha: float = 1.0, depth: int = FOREST_DEPTH
) -> dict[str, Estimator]:
    """Ridge, forest and boosting as estimators for ``n`` training rows whose counts have this population deviation.

    Ridge penalises the raw sum of squares. Spark averages the loss and scales the label first, so the strength that
    means the same is ``alpha * deviation / n``.
    """
    common = {"featuresCol": "features", "labelCol": "count"}
    forest = {**common, "numTrees": trees, "maxDepth": depth, "seed": SEED}
    return {
        "ridge": LinearRegression(**common, regParam=alpha * deviation / max(n, 1), elasticNetParam=0.0, standardization=False),
        "forest": RandomForestRegressor(**forest),
        "boosting": GBTRegressor(**common, maxIter=rounds, maxDepth=3, stepSize=0.1, seed=SEED),
    }


def count_vector(columns: Sequence[str]) -> PipelineModel:
    """Missing features as 0, gathered into ``features``."""
    filled = ", ".join(f"coalesce(CAST(`{c}` AS DOUBLE), 0D) AS `_c_{c}`" for c in columns)
    shape = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    gather = VectorAssembler(inputCols=[f"_c_{c}" for c in columns], outputCol="features")
    drop = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'`_c_{c}`' for c in columns)}) FROM __THIS__")
    return PipelineModel(stages=[shape, gather, drop])


def oof_counts(
    table: DataFrame,
    make: Callable[[int, float], Estimator],
    columns: Sequence[str],
    *,
    folds: Sequence[int] = FOLDS,
    key: str = "image",
) -> DataFrame:
    """Out-of-fold counts, rounded half to even and clipped to the highest training count of the fold."""
    ready = checkpointed(count_vector(columns).transform(table).select(key, "count", "fold_id", "features"))
    parts = []
    for fold in folds:
        train, valid = image_folds(ready, fold)
        n, deviation, highest = train.agg(F.count(F.lit(1)), F.stddev_pop("count"), F.max("count")).first()
        scored = make(n, float(deviation or 0.0)).fit(train).transform(valid)
        clipped = round_and_clip(scored, "prediction", highest=int(highest or 0), into="predicted")
        parts.append(clipped.select(key, "count", "fold_id", "predicted"))
    return reduce(DataFrame.unionByName, parts)


def count_learners(*, trees: int = 150, rounds: int = 100, depth: int = FOREST_DEPTH) -> dict[str, Learner]:
    """Forest, extra trees and boosting for counts, for all folds at once."""
    return {
        "forest": Learner("forest", trees, depth, share="all", regression=True),
        "extra_trees": Learner("extra_trees", trees, depth, share="all", regression=True),
        "boosting": Learner("boosting", rounds, 3, share="all", regression=True),
    }


def cross_fit_counts(
    table: DataFrame, models: Mapping[str, Learner], columns: Sequence[str], *, folds: Sequence[int] = FOLDS, key: str = "image"
) -> DataFrame:
    """(model, key, count, fold_id, predicted): out-of-fold counts of all models, rounded and clipped like ``oof_counts``."""
    filled = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    known = table.select(key, "count", "fold_id", filled.alias("x"), F.monotonically_increasing_id().alias("id"))
    data = _written(known, "counts")
    folded = data.withColumn("fold", F.explode(F.array(*map(F.lit, folds)))).select(
        "fold", "id", (F.col("fold_id") != F.col("fold")).alias("train"), F.col("count").cast("double").alias("y"), F.lit(1.0).alias("weight"), "x"
    )
    values = FoldValues(_written(folded, "fold-values"), len(columns), {})
    experiments = [Experiment(name, "whole", fold, tuple(range(len(columns))), learner) for name, learner in models.items() for fold in folds]
    names, of_fold = (F.array(*map(F.lit, column)) for column in zip(*((e.model, e.fold) for e in experiments)))
    scored = fit_experiments(values, experiments)
    highest = values.rows.where("train").groupBy("fold").agg(F.max("y").cast("long").alias("highest"))
    named = scored.select(F.element_at(names, F.col("experiment") + 1).alias("model"), F.element_at(of_fold, F.col("experiment") + 1).alias("fold"), "id", "p")
    clipped = round_and_clip(named.join(highest, "fold"), "p", highest=F.col("highest"), into="predicted")
    return clipped.select("model", "id", "predicted").join(data.select("id", key, "count", "fold_id"), "id").drop("id")


def two_stage_counts(
    cells: DataFrame,
    classifier: Estimator,
    make: Callable[[int, float], Estimator],
    columns: Sequence[str],
    *,
    keys: Sequence[str] = ("image", "count", "fold_id"),
    label: str = "player_present",
    folds: Sequence[int] = FOLDS,
) -> DataFrame:
    """Counts from the cells: out-of-fold presence, one map per image, its features, out-of-fold counts."""
    presence = oof_predict(cells, classifier, columns, keep=[*keys, "cell_id"], label=label, folds=folds)
    table = comp.count_feature_table(comp.assemble_map(presence, keys), keys)
    return oof_counts(table, make, comp.count_feature_columns(), folds=folds, key=keys[0])


def ablations(
    planes: DataFrame,
    make: Callable[[int, float], Estimator],
    *,
    values: str = "map",
    keys: Sequence[str] = ("image", "count", "fold_id"),
    folds: Sequence[int] = FOLDS,
) -> DataFrame:
    """Count metrics with parts of the map or of the features left out, best mean absolute error first."""
    statistics, places = comp.STAT_FEATURES, comp.OCCUPANCY_FEATURES
    every = comp.count_feature_columns()
    shapes = every[len(statistics) + len(places) :]
    whole = checkpointed(comp.count_feature_table(planes, keys, values=values))

    def rows_only(first: int, last: int) -> DataFrame:
        return comp.count_feature_table(comp.subset_map(planes, first, last, values=values), keys, values=values)

    runs = {
        "everything": (whole, every),
        "map rows 0 to 3": (rows_only(0, 3), every),
        "map rows 1 to 6": (rows_only(1, 6), every),
        "without places": (whole, [*statistics, *shapes]),
        "without components": (whole, [*statistics, *places]),
        "components alone": (whole, shapes),
    }
    results = []
    for label, (table, chosen) in runs.items():
        per_fold = count_metrics(oof_counts(table, make, chosen, folds=folds), "count", "predicted", keys=["fold_id"])
        means = per_fold.agg(*[F.avg(m).alias(m) for m in COUNT_METRICS])
        results.append(means.select(F.lit(label).alias("label"), *COUNT_METRICS))
    return reduce(DataFrame.unionByName, results).orderBy("mae", "label")


def fit_final(
    cells: DataFrame,
    cell_columns: Sequence[str],
    classifier: Estimator,
    table: DataFrame,
    regressor: Estimator,
    *,
    variance: float | None = None,
    label: str = "player_present",
) -> tuple[PipelineModel, PipelineModel]:
    """Both stages refitted on all rows."""
    first, _ = fit_presence(cells, classifier, cell_columns, label=label, variance=variance)
    vector = count_vector(comp.count_feature_columns())
    second = PipelineModel(stages=[vector, regressor.fit(vector.transform(table))])
    return first, second


def save_bundle(
    spark: SparkSession,
    path: str,
    presence: PipelineModel,
    counts: PipelineModel,
    *,
    threshold: float,
    cell_columns: Sequence[str],
    **notes: object,
) -> None:
    """Both models and a one-row JSON of settings under one folder."""
    presence.write().overwrite().save(f"{path}/model1_pipeline")
    counts.write().overwrite().save(f"{path}/model2_model")
    settings = {
        "model1_threshold": threshold,
        "cell_feature_cols": list(cell_columns),
        "count_feature_cols": comp.count_feature_columns(),
        **notes,
    }
    spark.createDataFrame([(json.dumps(settings),)], "value string").write.mode("overwrite").text(f"{path}/settings")


def load_bundle(spark: SparkSession, path: str) -> dict[str, object]:
    """The saved models and settings; a bundle without its required entries is an error."""
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    bundle: dict[str, object] = {
        "model1_pipeline": PipelineModel.load(f"{path}/model1_pipeline"),
        "model2_model": PipelineModel.load(f"{path}/model2_model"),
        **settings,
    }
    missing = [k for k in BUNDLE_KEYS if k not in bundle]
    if missing:
        raise ValueError(f"bundle lacks {missing}")
    return bundle


def feature_importance(spark: SparkSession, model: Transformer, columns: Sequence[str], *, n: int = 20) -> DataFrame:
    """The most important features of a tree model, or the largest absolute coefficients of a linear one."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(c, abs(float(w))) for c, w in zip(columns, weights.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def team_classifier(
    train: DataFrame, columns: Sequence[str], *, label: str = "label", trees: int = 100, depth: int = FOREST_DEPTH
) -> PipelineModel:
    """Forest over the eleven labels with balanced weights."""
    forest = ForestClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED
    )
    return fit_presence(train, forest, columns, label=label)[0]

