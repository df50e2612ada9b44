"""Classification and count metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfare.functions.columns import count_if, flag, half_even, ratio
from gridfare.functions.ranking import running_sums
from gridfare.operators.planes import BINS, to_hsv

THRESHOLDS = (0.30, 0.40, 0.50, 0.60, 0.70)


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1, each 0 when undefined."""
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def _cells(truth: str, guess: Column) -> dict[str, Column]:
    actual = F.col(truth) == 1
    return {
        "tp": count_if(actual & guess),
        "fp": count_if(~actual & guess),
        "fn": count_if(actual & ~guess),
        "tn": count_if(~actual & ~guess),
    }


def binary_metrics(
    df: DataFrame, truth: str, score: str, *, threshold: float = 0.5, keys: Sequence[str] = ()
) -> DataFrame:
    """Metrics of ``score >= threshold`` against a 0/1 truth, per group when keys are given."""
    counts = df.groupBy(*keys).agg(*[c.alias(n) for n, c in _cells(truth, F.col(score) >= threshold).items()])
    return counts.withColumns(_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def curve_areas(
    df: DataFrame, truth: str, score: str, *, keys: Sequence[str] = ()
) -> DataFrame:
    """Area under the ROC curve (trapezoid) and average precision; 0.5 for a single class.

    Rows are reduced to distinct scores; hits are then accumulated from the highest score down.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, score).agg(
        count_if(F.col(truth) == 1).alias("_pos"), count_if(F.col(truth) != 1).alias("_neg")
    )
    sums = {"_tp": F.col("_pos"), "_fp": F.col("_neg")}
    walked = running_sums(counts, keys, [score], sums, descending=True)
    precision = F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    totals = walked.groupBy(*keys).agg(
        F.sum("_pos").alias("_p"),
        F.sum("_neg").alias("_n"),
        F.sum(F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2)).alias("_area"),
        F.sum(F.col("_pos") * precision).alias("_steps"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return totals.select(
        *keys,
        F.when(both, F.col("_area") / (F.col("_p") * F.col("_n"))).otherwise(0.5).alias("roc_auc"),
        F.when(both, F.col("_steps") / F.col("_p")).otherwise(0.5).alias("pr_auc"),
    )


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    return curve_areas(df, truth, score).select("roc_auc")


def pr_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Average precision: the sum of recall steps times precision."""
    return curve_areas(df, truth, score).select("pr_auc")


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Counts by actual class, one column per predicted class, zero filled."""
    counts = df.groupBy(F.col(actual).alias("actual")).pivot(predicted, list(classes)).agg(F.count(F.lit(1)))
    return counts.select("actual", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"predicted_{c}") for c in classes])


def threshold_sweep(
    df: DataFrame, truth: str, score: str, *, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Metrics at each threshold from one pass, the best F1 marked, the first one on ties."""
    aggs = [
        c.alias(f"{n}{i}")
        for i, t in enumerate(thresholds)
        for n, c in _cells(truth, F.col(score) >= t).items()
    ]
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn")])
            for i, t in enumerate(thresholds)
        ]
    )
    swept = df.agg(*aggs).select(F.inline(rows)).withColumns(_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))
    best = swept.agg(F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold")))).scalar()
    return swept.withColumn("best", F.col("threshold") == best)


def round_and_clip(df: DataFrame, predicted: str, *, highest: int | Column, into: str = "rounded") -> DataFrame:
    """Predicted counts rounded half to even and kept within 0 and the highest training count."""
    top = F.lit(highest) if isinstance(highest, int) else highest
    return df.withColumn(into, F.greatest(F.lit(0), F.least(half_even(F.col(predicted)), top)).cast("long"))


def count_metrics(df: DataFrame, actual: str, predicted: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error, root mean square error, exact share and share within one."""
    miss = F.abs(F.col(predicted) - F.col(actual))
    return df.groupBy(*keys).agg(
        F.avg(miss).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(F.when(miss == 0, 1).otherwise(0)).alias("exact_acc"),
        F.avg(F.when(miss <= 1, 1).otherwise(0)).alias("pm1_acc"),
    )


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """How often each error (predicted minus actual) occurs."""
    error = (F.col(predicted) - F.col(actual)).alias("error")
    return df.groupBy(error).agg(F.count(F.lit(1)).alias("n"))


def multiclass_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro averages and overall accuracy.

    Everything after the first count works on at most classes squared rows.
    """
    counts = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(none)

    def side(c: str, *figures: Column) -> Column:
        return F.struct(F.col(c).alias("c"), *[f.alias(n) for f, n in zip(figures, ("tp", "support", "g"))])

    sides = counts.select(F.inline(F.array(side("a", hit, F.col("n"), none), side("p", none, none, F.col("n")))))
    per = sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("g").alias("guessed"))
    tp, support, guessed = F.col("tp"), F.col("support"), F.col("guessed")
    classes = per.select(
        F.col("c").cast("string").alias("class"),
        ratio(tp, guessed).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, support + guessed).alias("f1"),
        "support",
        "tp",
    )
    macro = classes.agg(
        F.lit("macro avg").alias("class"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.sum("support").alias("support"),
    )
    share = ratio(F.sum("tp"), F.sum("support"))
    accuracy = classes.agg(
        F.lit("accuracy").alias("class"),
        share.alias("precision"),
        share.alias("recall"),
        share.alias("f1"),
        F.sum("support").alias("support"),
    )
    return classes.drop("tp").unionByName(macro).unionByName(accuracy)


def prediction_outcome(
    df: DataFrame, actual: str, predicted: str, *, image: str = "image", images: int | None = None
) -> DataFrame:
    """Correct or wrong for every cell; ``images`` takes a stable sample of so many images."""
    shown = df
    if images is not None:
        shown = df.join(df.select(image).distinct().orderBy(F.md5(image), image).limit(images), image, "left_semi")
    right = F.col(actual) == F.col(predicted)
    text = F.when(right, F.lit("correct")).otherwise(F.concat_ws(" instead of ", F.col(predicted), F.col(actual)))
    return shown.select("*", flag(right).alias("correct"), text.alias("outcome"))


def false_negatives(pixels: DataFrame, actual: str, predicted: str, *, bins: int = BINS) -> DataFrame:
    """Hue histogram of cells that hold a team but were predicted empty, per team."""
    missed = to_hsv(pixels.where((F.col(actual) > 0) & (F.col(predicted) == 0)))
    place = F.least(F.floor(F.col("h") * bins), F.lit(bins - 1)).cast("long")
    return missed.groupBy(F.col(actual).alias("label"), place.alias("hue_bin")).agg(F.count(F.lit(1)).alias("pixels"))
