"""Joining feature tables and reporting where they disagree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfare.functions.columns import count_if
from gridfare.operators.grid import assign_fold, image_number, rebase_indices

KEY = ["image", "cell_row", "cell_col"]


def drop_image_number(df: DataFrame, *, keep: bool = False) -> DataFrame:
    return df if keep else df.drop("image_num")


def merge_features(
    colour: DataFrame,
    texture: DataFrame,
    edge: DataFrame,
    annotations: DataFrame,
    *,
    key: Sequence[str] = KEY,
    texture_one_based: bool = True,
    keep_image_number: bool = False,
) -> DataFrame:
    """Colour rows with their texture and edge features, the image's count, and the fold.

    All cell tables join on the same key, so one partitioning serves both joins; only new columns come across.
    """
    texture = rebase_indices(texture, one_based=texture_one_based)
    merged = colour
    for other in (texture, edge):
        fresh = [c for c in other.columns if c in key or c not in merged.columns]
        merged = merged.join(other.select(*fresh), list(key), "left")
    counts = annotations.groupBy("image").agg(F.min("count").alias("count"))
    merged = merged.join(counts, "image", "left")
    return drop_image_number(assign_fold(image_number(merged)), keep=keep_image_number)


def merge_match_report(
    base: DataFrame, others: Mapping[str, DataFrame], *, key: Sequence[str] = KEY, strict: bool = False
) -> DataFrame:
    """Keys of ``base`` with no match in each other table; in strict mode the first miss is an error."""
    keys = base.select(*key).distinct()
    misses = [
        keys.join(other.select(*key), list(key), "left_anti").withColumn("missing_in", F.lit(name))
        for name, other in others.items()
    ]
    report = reduce(DataFrame.unionByName, misses)
    if strict and not report.isEmpty():
        raise ValueError(f"unmatched rows, first: {report.first()}")
    return report


def _stacked(tables: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    parts = [t.select(*columns, F.lit(name).alias("_source")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def merge_conflicts(
    tables: Mapping[str, DataFrame], fields: Sequence[str], *, key: Sequence[str] = KEY
) -> DataFrame:
    """One row per key and metadata field whose values differ between inputs, null counting as a value.

    Inputs are stacked and grouped rather than joined, so copies of a key never multiply.
    """
    text = [F.col(f).cast("string").alias(f) for f in fields]
    stacked = _stacked({n: t.select(*key, *text) for n, t in tables.items()}, [*key, *fields])
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in fields:
        aggs += [F.min(f).alias(f"_lo_{f}"), F.max(f).alias(f"_hi_{f}"), F.count(f).alias(f"_k_{f}")]
    grouped = stacked.groupBy(*key).agg(*aggs)
    verdicts = [
        F.struct(
            F.lit(f).alias("field"),
            F.col(f"_lo_{f}").alias("low"),
            F.col(f"_hi_{f}").alias("high"),
            (F.col("_n") - F.col(f"_k_{f}")).alias("nulls"),
            F.col(f"_k_{f}").alias("known"),
        )
        for f in fields
    ]
    rows = grouped.select(*key, F.inline(F.array(*verdicts)))
    return rows.where("low <> high OR (nulls > 0 AND known > 0)").drop("known")


def label_audit(tables: Mapping[str, DataFrame], *, label: str = "label", key: Sequence[str] = KEY) -> DataFrame:
    """Per pair of tables: keys with equal labels, with different labels, and on one side only."""
    names = list(tables)
    side_by_side = _stacked(tables, [*key, label]).groupBy(*key).agg(
        *[F.max(F.when(F.col("_source") == n, F.col(label))).alias(n) for n in names]
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    counts = []
    for a, b in pairs:
        left, right = F.col(a), F.col(b)
        counts += [
            count_if(left == right).alias(f"{a}|{b}|same"),
            count_if(left != right).alias(f"{a}|{b}|different"),
            count_if(left.isNotNull() & right.isNull()).alias(f"{a}|{b}|left_only"),
            count_if(left.isNull() & right.isNotNull()).alias(f"{a}|{b}|right_only"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("left_table"),
                F.lit(b).alias("right_table"),
                *[F.col(f"`{a}|{b}|{m}`").alias(m) for m in ("same", "different", "left_only", "right_only")],
            )
            for a, b in pairs
        ]
    )
    return side_by_side.agg(*counts).select(F.inline(rows))
