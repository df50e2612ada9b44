"""Metric and two-stage model queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfare.functions.columns import r6
from gridfare.operators import components as comp
from gridfare.operators import metrics, models
from gridfare.operators import planes as pl
from gridfare.plans import fixtures as fx
from gridfare.plans.grid_queries import CELLS
from gridfare.plans.plane_queries import CELL, RGB
from gridfare.plans.registry import query, sql_r6
from gridfare.session import checkpointed, scratch_path

SCORED = """scored AS (SELECT doc_id, quality, toxic, n_chars % 100 / 100::DOUBLE AS score
  FROM labels JOIN documents USING (doc_id))"""


def _counts_sql(t: str, truth: str = "quality") -> str:
    return f"""count(*) FILTER ({truth} = 1 AND score >= {t}) AS tp, count(*) FILTER ({truth} <> 1 AND score >= {t}) AS fp,
    count(*) FILTER ({truth} = 1 AND score < {t}) AS fn, count(*) FILTER ({truth} <> 1 AND score < {t}) AS tn"""


_RATES = f"""{sql_r6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy,
  {sql_r6('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {sql_r6('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall,
  {sql_r6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1"""
_RATE_NAMES = ("accuracy", "precision", "recall", "f1")


def _round(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# ---- metrics ----

query(
    "binary_metrics",
    f"WITH {SCORED}, c AS (SELECT {_counts_sql('0.5')} FROM scored) SELECT tp, fp, fn, tn, {_RATES} FROM c",
)(
    lambda spark, sf: _round(metrics.binary_metrics(fx.scored_labels(spark, sf), "quality", "score"), _RATE_NAMES)
)
_WALK = f"""{SCORED}, s AS (SELECT score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg
    FROM scored GROUP BY 1),
  w AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
    FROM s WINDOW d AS (ORDER BY score DESC))"""
query(
    "roc_auc",
    f"""WITH {SCORED} SELECT {sql_r6('avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)')}
    AS roc_auc FROM scored a, scored b WHERE a.quality = 1 AND b.quality <> 1""",
)(lambda spark, sf: _round(metrics.roc_auc(fx.scored_labels(spark, sf), "quality", "score"), ["roc_auc"]))
query("pr_auc", f"WITH {_WALK} SELECT {sql_r6('sum(pos * tp / (tp + fp)) / max(p)')} AS pr_auc FROM w")(
    lambda spark, sf: _round(metrics.pr_auc(fx.scored_labels(spark, sf), "quality", "score"), ["pr_auc"])
)
query(
    "confusion_matrix",
    f"""WITH {SCORED} SELECT quality AS actual, count(*) FILTER (toxic = 0) AS predicted_0,
    count(*) FILTER (toxic = 1) AS predicted_1 FROM scored GROUP BY 1""",
)(lambda spark, sf: metrics.confusion_matrix(fx.scored_labels(spark, sf), "quality", "toxic"))
_SWEEP = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, {_counts_sql(str(t))} FROM scored" for t in metrics.THRESHOLDS)
query(
    "threshold_sweep",
    f"""WITH {SCORED}, c AS ({_SWEEP}), r AS (SELECT *, {_RATES}, 2 * tp / (2 * tp + fp + fn) AS raw FROM c)
    SELECT threshold, tp, fp, fn, tn, accuracy, precision, recall, f1,
      row_number() OVER (ORDER BY raw DESC, threshold) = 1 AS best FROM r""",
)(
    lambda spark, sf: _round(metrics.threshold_sweep(fx.scored_labels(spark, sf), "quality", "score"), _RATE_NAMES)
)


def _predicted(spark, sf):
    """Orders as images: a count and a fractional prediction of it, many on a half."""
    return fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey % 21 AS actual", "(o_custkey % 21) + (o_orderkey % 9 - 4) / 2D AS predicted"
    )


_PRED = """p AS (SELECT o_orderkey, o_custkey % 21 AS actual, (o_custkey % 21) + (o_orderkey % 9 - 4) / 2::DOUBLE AS predicted
  FROM orders), r AS (SELECT *, greatest(0, least(round_even(predicted, 0), 20))::BIGINT AS rounded FROM p)"""
query("round_and_clip", f"WITH {_PRED} SELECT o_orderkey, actual, predicted, rounded FROM r")(
    lambda spark, sf: metrics.round_and_clip(_predicted(spark, sf), "predicted", highest=20)
)
query(
    "count_metrics",
    f"""WITH {_PRED} SELECT {sql_r6('avg(abs(rounded - actual))')} AS mae,
    {sql_r6('sqrt(avg((rounded - actual) ** 2))')} AS rmse, {sql_r6('avg((rounded = actual)::INT)')} AS exact_acc,
    {sql_r6('avg((abs(rounded - actual) <= 1)::INT)')} AS pm1_acc FROM r""",
)(
    lambda spark, sf: _round(
        metrics.count_metrics(
            metrics.round_and_clip(_predicted(spark, sf), "predicted", highest=20), "actual", "rounded"
        ),
        models.COUNT_METRICS,
    )
)
query("residuals", f"WITH {_PRED} SELECT rounded - actual AS error, count(*) AS n FROM r GROUP BY 1")(
    lambda spark, sf: metrics.residuals(
        metrics.round_and_clip(_predicted(spark, sf), "predicted", highest=20), "actual", "rounded"
    )
)
_GUESS = "CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END"
query(
    "multiclass_report",
    f"""WITH e AS (SELECT event_type AS a, {_GUESS} AS g FROM events), k AS (SELECT DISTINCT a AS c FROM e),
    m AS (SELECT c AS class, count(*) FILTER (a = c AND g = c) AS tp, count(*) FILTER (a = c) AS support,
      count(*) FILTER (g = c) AS guessed FROM k, e GROUP BY 1),
    r AS (SELECT class, tp / guessed AS p, tp / support AS q, 2 * tp / (support + guessed) AS f, support, tp FROM m)
    SELECT class, {sql_r6('p')} AS precision, {sql_r6('q')} AS recall, {sql_r6('f')} AS f1, support FROM r
    UNION ALL SELECT 'macro avg', {sql_r6('avg(p)')}, {sql_r6('avg(q)')}, {sql_r6('avg(f)')}, sum(support)::BIGINT FROM r
    UNION ALL SELECT 'accuracy', {sql_r6('sum(tp) / sum(support)')}, {sql_r6('sum(tp) / sum(support)')},
      {sql_r6('sum(tp) / sum(support)')}, sum(support)::BIGINT FROM r""",
)(
    lambda spark, sf: _round(
        metrics.multiclass_report(
            fx.table(spark, sf, "events").selectExpr(
                "event_type", "IF(event_id % 3 = 0, 'view', event_type) AS guess"
            ),
            "event_type",
            "guess",
        ),
        ["precision", "recall", "f1"],
    )
)
query(
    "prediction_outcome",
    f"""WITH {CELLS}, g AS (SELECT image, cell_id, label, CASE WHEN v > 0.3 THEN 0 ELSE label END AS guess FROM cells)
    SELECT image, cell_id, label, guess, (label = guess)::BIGINT AS correct,
      CASE WHEN label = guess THEN 'correct' ELSE guess || ' instead of ' || label END AS outcome FROM g""",
)(
    lambda spark, sf: metrics.prediction_outcome(
        fx.cells(spark, sf).selectExpr("image", "cell_id", "label", "IF(v > 0.3D, 0L, label) AS guess"), "label", "guess"
    )
)


@query(
    "false_negatives",
    f"""WITH {RGB} SELECT team AS label, least(floor(h * 32), 31)::BIGINT AS hue_bin, count(*) AS pixels FROM pixels
    WHERE team > 0 AND (cell_row + cell_col) % 2 = 0 GROUP BY 1, 2""",
)
def _false_negatives(spark, sf):
    pixels = pl.assign_cell(pl.explode_pixels(fx.colour_planes(spark, sf), ["r", "g", "b"]), **CELL)
    guessed = pixels.withColumn("guess", F.when((F.col("cell_row") + F.col("cell_col")) % 2 == 0, 0).otherwise(F.col("team")))
    return metrics.false_negatives(guessed, "team", "guess")


# ---- folds and preparation ----


@query(
    "image_folds",
    f"""WITH {CELLS} SELECT image, cell_id, CASE WHEN fold_id = 2 THEN 'valid' ELSE 'train' END AS side FROM cells""",
)
def _folds(spark, sf):
    train, valid = models.image_folds(fx.cells(spark, sf).select("image", "cell_id", "fold_id"), 2)
    sides = [d.select("image", "cell_id", F.lit(n).alias("side")) for n, d in (("train", train), ("valid", valid))]
    return sides[0].unionByName(sides[1])


query(
    "balanced_weights",
    f"""SELECT doc_id, quality, {sql_r6('count(*) OVER () / (2 * count(*) OVER (PARTITION BY quality))')} AS weight FROM labels""",
)(
    lambda spark, sf: _round(
        models.balanced_weights(fx.table(spark, sf, "labels").select("doc_id", "quality"), "quality"), ["weight"]
    )
)
_HOLES = """o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 100)::DOUBLE END AS cust FROM orders)"""


def _holes(spark, sf):
    return fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "o_orderstatus",
        "IF(o_orderkey % 7 <> 0, o_totalprice, NULL) AS price",
        "IF(o_orderkey % 5 <> 0, CAST(o_custkey % 100 AS DOUBLE), NULL) AS cust",
    )


@query(
    "impute_median",
    f"""WITH {_HOLES}, m AS (SELECT median(price) AS mp, median(cust) AS mc FROM o WHERE o_orderstatus <> 'P')
    SELECT o_orderkey, {sql_r6('coalesce(price, mp)')} AS price, {sql_r6('coalesce(cust, mc)')} AS cust FROM o, m""",
)
def _impute(spark, sf):
    rows = _holes(spark, sf)
    filled = models.impute_median(rows, ["price", "cust"], train=rows.where("o_orderstatus <> 'P'"))
    return _round(filled.drop("o_orderstatus"), ["price", "cust"])


@query(
    "standardise",
    """WITH t AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderstatus <> 'P')
    SELECT o_orderkey, """
    + f"{sql_r6('(o_totalprice - m) / s')} AS o_totalprice, 0::DOUBLE AS fixed FROM orders, t",
)
def _standardise(spark, sf):
    rows = fx.table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "3D AS fixed")
    scaled = models.standardise(rows, ["o_totalprice", "fixed"], train=rows.where("o_orderstatus <> 'P'"))
    return _round(scaled.drop("o_orderstatus"), ["o_totalprice", "fixed"])


# ---- learners, with the library's default trees and rounds. Values of a learner have no SQL; what must hold for any learner has: which rows it answers for, supports, ranges. Each oracle states that.

_SHARES = "(VALUES (0.90::DOUBLE), (0.95::DOUBLE), (0.98::DOUBLE)) s(target)"
_MODELS = ["boosting", "extra_trees", "forest", "logistic"]


def _names(names, column):
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + f") {column}({column})"


def _presence(spark, sf):
    return fx.cell_features(spark, sf)


def _inside(value, low, high):
    return F.coalesce(F.col(value).between(low, high), F.lit(False)).alias("in_range")


@query("pca_by_variance", f"SELECT target, TRUE AS in_range FROM {_SHARES}")
def _pca(spark, sf):
    """Components kept for each target, from the 64 plane values: some, never more than there are, never fewer for more."""
    planes = fx.planes(spark, sf).select(*[F.col("v")[i].alias(f"f_{i}") for i in range(64)])
    names = [f"f_{i}" for i in range(64)]
    ready = models.preparation(planes, names).transform(planes)
    kept = [models.pca_by_variance(ready, t)[1] for t in (0.90, 0.95, 0.98)]
    rows = [(t, 1 <= k <= 64 and k >= max(kept[:i], default=0)) for i, (t, k) in enumerate(zip((0.90, 0.95, 0.98), kept))]
    return spark.createDataFrame(rows, "target double, in_range boolean")


@query(
    "presence_classifiers",
    f"""WITH {CELLS} SELECT model, fold_id, count(*) AS n, count(*) FILTER (label > 0) AS positives, TRUE AS in_range
    FROM cells, {_names(_MODELS, 'model')} GROUP BY 1, 2""",
)
def _classifiers(spark, sf):
    """All models on all folds."""
    scored = models.cross_fit(_presence(spark, sf), fx.CELL_FEATURES, models.presence_learners())
    found = metrics.binary_metrics(scored, "player_present", "p", keys=["model", "fold_id"])
    n = (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n")
    return found.select("model", "fold_id", n, (F.col("tp") + F.col("fn")).alias("positives"), _inside("f1", 0, 1))


@query("oof_predict", f"WITH {CELLS} SELECT image, cell_id, fold_id, TRUE AS in_range FROM cells")
def _oof(spark, sf):
    estimator = models.presence_classifiers()["logistic"]
    scored = models.oof_predict(_presence(spark, sf), estimator, fx.CELL_FEATURES, keep=["image", "cell_id", "fold_id"])
    return scored.select("image", "cell_id", "fold_id", _inside("p", 0, 1))


@query(
    "experiment_grid",
    f"""SELECT model, pca, NULL::VARCHAR AS error, TRUE AS in_range
    FROM {_names(_MODELS, 'model')}, {_names(models.PCA_SETTINGS, 'pca')}""",
)
def _grid(spark, sf):
    found = models.experiment_grid(_presence(spark, sf), fx.CELL_FEATURES)
    sound = reduce(lambda a, b: a & b, [F.col(m).between(0, 1) for m in models.METRICS])
    return found.select("model", "pca", "error", F.coalesce(sound, F.lit(False)).alias("in_range"))


def _table(spark, sf):
    return comp.count_feature_table(fx.map_planes(spark, sf), ["image", "count", "fold_id"])


_COUNTED = f"WITH {CELLS}, i AS (SELECT image, min(count)::BIGINT AS count, min(fold_id) AS fold_id FROM cells GROUP BY 1)"


@query(
    "count_regressors",
    f"""{_COUNTED} SELECT model, image, count, fold_id, TRUE AS in_range
    FROM i, {_names(['boosting', 'extra_trees', 'forest', 'ridge'], 'model')}""",
)
def _regressors(spark, sf):
    table, columns = _table(spark, sf), comp.count_feature_columns()
    ridge = models.oof_counts(table, lambda n, s: models.count_regressors(n, s)["ridge"], columns)
    grown = models.cross_fit_counts(table, models.count_learners(), columns)
    both = grown.unionByName(ridge.withColumn("model", F.lit("ridge")))
    return both.select("model", "image", "count", "fold_id", _inside("predicted", 0, 20))


@query("two_stage_counts", f"{_COUNTED} SELECT image, count, fold_id, TRUE AS in_range FROM i")
def _two_stages(spark, sf):
    classifier = models.presence_classifiers()["logistic"]
    found = models.two_stage_counts(
        _presence(spark, sf), classifier, lambda n, s: models.count_regressors(n, s)["ridge"], fx.CELL_FEATURES
    )
    return found.select("image", "count", "fold_id", _inside("predicted", 0, 20))


@query(
    "ablations",
    "SELECT label, TRUE AS in_range FROM "
    + _names(
        ["everything", "map rows 0 to 3", "map rows 1 to 6", "without places", "without components", "components alone"], "label"
    ),
)
def _ablations(spark, sf):
    found = models.ablations(fx.map_planes(spark, sf), lambda n, s: models.count_regressors(n, s)["ridge"])
    sound = F.col("mae").between(0, F.col("rmse")) & F.col("exact_acc").between(0, F.col("pm1_acc")) & (F.col("pm1_acc") <= 1)
    return found.select("label", F.coalesce(sound, F.lit(False)).alias("in_range"))


def _final(spark, sf):
    classifier = models.presence_classifiers()["forest"]
    table = _table(spark, sf)
    n, deviation = table.agg(F.count(F.lit(1)), F.stddev_pop("count")).first()
    ridge = models.count_regressors(n, deviation)["ridge"]
    return models.fit_final(_presence(spark, sf), fx.CELL_FEATURES, classifier, table, ridge)


@query("fit_final", f"{_COUNTED} SELECT image, count, TRUE AS in_range FROM i")
def _fit_final(spark, sf):
    _, counts = _final(spark, sf)
    scored = metrics.round_and_clip(counts.transform(_table(spark, sf)), "prediction", highest=20, into="predicted")
    return scored.select("image", "count", _inside("predicted", 0, 20))


@query("save_bundle", f"WITH {CELLS} SELECT image, cell_id, TRUE AS in_range FROM cells")
def _bundle(spark, sf):
    presence, counts = _final(spark, sf)
    path = scratch_path(spark, "bundle")
    models.save_bundle(spark, path, presence, counts, threshold=0.5, cell_columns=fx.CELL_FEATURES, model1_name="forest")
    loaded = models.load_bundle(spark, path)
    scored = models.positive_probability(loaded["model1_pipeline"].transform(_presence(spark, sf)))
    return scored.select("image", "cell_id", _inside("p", 0, 1))


@query("feature_importance", "SELECT feature, TRUE AS in_range FROM " + _names(fx.CELL_FEATURES, "feature"))
def _importance(spark, sf):
    presence, _ = _final(spark, sf)
    found = models.feature_importance(spark, presence, fx.CELL_FEATURES)
    return found.select("feature", _inside("importance", 0, 1))


@query(
    "team_classifier",
    f"""WITH {CELLS} SELECT fold_id, label::VARCHAR AS class, count(*) AS support, TRUE AS in_range FROM cells GROUP BY 1, 2""",
)
def _teams(spark, sf):
    """A forest for each fold, on the rows of the others."""
    cells = checkpointed(_presence(spark, sf))
    reports = []
    for fold in models.FOLDS:
        train, valid = models.image_folds(cells, fold)
        model = models.team_classifier(train, fx.CELL_FEATURES)
        scored = model.transform(valid).withColumn("guess", F.col("prediction").cast("long"))
        report = metrics.multiclass_report(scored, "label", "guess").where("class RLIKE '^[0-9]+$' AND support > 0")
        reports.append(report.select(F.lit(fold).cast("long").alias("fold_id"), "class", "support", _inside("f1", 0, 1)))
    return reduce(DataFrame.unionByName, reports)
