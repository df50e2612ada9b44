"""Exploratory aggregates over cells, images and features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfare.functions.columns import count_if, ratio
from gridfare.functions.ranking import exact_quantiles, positions
from gridfare.operators.grid import bin_region, melt_features
from gridfare.schemas import GRID, TEAMS

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns])


def _long(one_row: DataFrame, columns: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """A single row of ``measure|column`` aggregates, turned to one row per column."""
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{m}|{c}`").alias(m) for m in measures]) for c in columns
    ]
    return one_row.select(F.inline(F.array(*rows)))


def min_max_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum and range per column."""
    aggs = [a for c in columns for a in (F.min(c).alias(f"min|{c}"), F.max(c).alias(f"max|{c}"))]
    rows = _long(_doubles(df, columns).agg(*aggs), columns, ["min", "max"])
    return rows.withColumn("range", F.col("max") - F.col("min"))


def images_per_fold(cells: DataFrame, *, image: str = "image") -> DataFrame:
    return cells.groupBy("fold_id").agg(F.countDistinct(image).alias("images"))


def image_stats(cells: DataFrame, *, image: str = "image") -> DataFrame:
    """Count, fold and number of player cells of each image."""
    return cells.groupBy(image).agg(
        F.min("count").alias("count"), F.min("fold_id").alias("fold_id"), F.sum("player_present").alias("player_cells")
    )


def occupancy_heatmap(cells: DataFrame) -> DataFrame:
    """Mean presence by row, one column per grid column, gaps 0."""
    pivoted = cells.groupBy("cell_row").pivot("cell_col", list(range(GRID))).agg(F.avg("player_present"))
    named = pivoted.select("cell_row", *[F.col(str(c)).alias(f"col_{c}") for c in range(GRID)])
    return named.fillna(0.0)


def occupancy_by_axis(cells: DataFrame) -> DataFrame:
    """Mean presence by row, column, region and fold, in one pass."""
    axes = ["cell_row", "cell_col", "region", "fold_id"]
    typed = bin_region(cells).select(*[F.col(a).cast("string").alias(a) for a in axes], "player_present")
    sets = typed.groupingSets([[a] for a in axes], *axes).agg(
        F.avg("player_present").alias("mean_presence"), F.count(F.lit(1)).alias("cells"), F.grouping_id().alias("gid")
    )
    axis = F.when(F.col("gid") == 7, "row").when(F.col("gid") == 11, "col").when(F.col("gid") == 13, "region")
    return sets.select(
        axis.otherwise("fold").alias("axis"), F.coalesce(*axes).alias("value"), "mean_presence", "cells"
    )


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of each value, and the smallest count over the largest."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.struct(F.sum("n").alias("t"), F.min("n").alias("lo"), F.max("n").alias("hi"))).scalar()
    return counts.withColumn("_e", ends).select(
        "value", "n", (F.col("n") / F.col("_e.t")).alias("share"), (F.col("_e.lo") / F.col("_e.hi")).alias("minority_ratio")
    )


def count_cell_corr(images: DataFrame, a: str = "count", b: str = "player_cells") -> DataFrame:
    return images.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations below the diagonal of all features, in long form; null where a spread is zero.

    Each pair ignores rows where either side is null. One scan: every task multiplies its rows into matrices of counts,
    sums and products, whose size is the square of the number of columns whatever the input.
    """
    chosen = list(columns)
    later, earlier = (np.array(x, dtype=np.int64) for x in zip(*[(j, i) for i, j in combinations(range(len(chosen)), 2)]))
    figures = ["n", "xs", "ys", "xxs", "yys", "xys"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(figures), len(later)))
        for batch in batches:
            known = np.stack([np.asarray(c.is_valid()) for c in batch.columns], axis=1).astype(float)
            x = np.stack([np.asarray(c.fill_null(0.0)) for c in batch.columns], axis=1)
            n, s, squares, products = known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x
            parts = [n[later, earlier], s[later, earlier], s[earlier, later], squares[later, earlier], squares[earlier, later]]
            total += np.stack([*parts, products[later, earlier]])
        yield pa.record_batch([pa.array(later), pa.array(earlier), *map(pa.array, total)], names=["i", "j", *figures])

    shape = "i long, j long, " + ", ".join(f"{f} double" for f in figures)
    found = _doubles(df, chosen).mapInArrow(sums, shape).groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in figures])
    x_spread = F.col("xxs") - F.col("xs") * F.col("xs") / F.col("n")
    y_spread = F.col("yys") - F.col("ys") * F.col("ys") / F.col("n")
    together = F.col("xys") - F.col("xs") * F.col("ys") / F.col("n")
    names = F.array(*map(F.lit, chosen))
    corr = F.when((F.col("n") > 1) & (x_spread > 0) & (y_spread > 0), together / F.sqrt(x_spread * y_spread))
    return found.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), corr.alias("corr"))


def skewness_report(df: DataFrame, columns: Sequence[str], *, limit: float = 2.0) -> DataFrame:
    """Skew, missing values and range of every column, the most right-skewed first; skew is the population figure."""
    measures = {"skew": F.skewness, "min": F.min, "max": F.max}
    aggs = [fn(c).alias(f"{m}|{c}") for c in columns for m, fn in measures.items()]
    aggs += [count_if(F.col(c).isNull()).alias(f"missing|{c}") for c in columns]
    rows = _long(_doubles(df, columns).agg(*aggs), columns, ["skew", "missing", "min", "max"])
    return rows.orderBy(F.desc_nulls_last("skew"), "column").withColumns(
        {"range": F.col("max") - F.col("min"), "high": F.coalesce(F.abs("skew") > limit, F.lit(False))}
    )


def most_skewed(report: DataFrame, *, n: int = 10) -> DataFrame:
    """The top of the report among the columns whose skew is high."""
    return report.where("high").orderBy(F.desc("skew"), "column").limit(n)


def describe_counts(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum."""
    basics = df.agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    middles = exact_quantiles(df, [], column, QUARTILES)
    found = middles.select(F.struct(*QUARTILES)).scalar()
    return basics.withColumn("_q", found).select(*basics.columns, *[F.col(f"_q.{q}").alias(q) for q in QUARTILES])


def fold_boxplot(df: DataFrame, by: str, value: str) -> DataFrame:
    """Extremes and exact quartiles per fold or other small key."""
    ends = df.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return ends.join(exact_quantiles(df, [by], value, QUARTILES), by)


def count_histogram(df: DataFrame, column: str, *, bins: int = 15) -> DataFrame:
    """Equal-width bins from the minimum to the maximum; the last bin is closed and empty bins are kept."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    scalars = df.where(F.col(column).isNotNull()).select(column, ends.select(F.struct("lo", "hi")).scalar().alias("e"))
    placed = scalars.select(column, "e.lo", "e.hi")
    place = F.when(width == 0, 0).otherwise(F.floor((F.col(column) - F.col("lo")) / width))
    counts = placed.groupBy(F.least(place, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = ends.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    frame = edges.select(
        F.col("bin").cast("long").alias("bin"),
        (F.col("lo") + F.col("bin") * F.col("w")).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("right"),
    )
    return frame.join(counts, "bin", "left").fillna(0, ["n"])


def class_distributions(
    df: DataFrame, features: Sequence[str], *, by: str
) -> DataFrame:
    """Extremes and quartiles of each feature within each class."""
    melted = melt_features(df, features, by=by)
    keys = [by, "feature"]
    ends = melted.groupBy(*keys).agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return ends.join(exact_quantiles(melted, keys, "value", QUARTILES), keys)


def team_presence(cells: DataFrame, *, image: str = "image") -> DataFrame:
    """Images in which each team appears."""
    return cells.where("label <> 0").groupBy("label").agg(F.countDistinct(image).alias("images"))


def team_heatmaps(cells: DataFrame) -> DataFrame:
    """How often each team is in each cell."""
    return cells.where("label <> 0").groupBy("label", "cell_row", "cell_col").agg(F.count(F.lit(1)).alias("n"))


def _teams_seen(cells: DataFrame, image: str) -> DataFrame:
    teams = [t for t in TEAMS if t]
    return cells.groupBy(image).agg(
        *[F.max(F.when(F.col("label") == t, 1).otherwise(0)).cast("long").alias(f"t{t}") for t in teams]
    )


def team_cooccurrence(cells: DataFrame, *, image: str = "image") -> DataFrame:
    """Images with each pair of teams, plus images with a single team and with none.

    Ten presence flags per image replace the self join, so nothing is emitted per pair and image.
    """
    teams = [t for t in TEAMS if t]
    seen = _teams_seen(cells, image)
    n_teams = reduce(lambda a, b: a + b, [F.col(f"t{t}") for t in teams])
    pairs = list(combinations(teams, 2))
    sums = [F.sum(F.col(f"t{a}") * F.col(f"t{b}")).alias(f"{a}|{b}") for a, b in pairs]
    sums += [count_if(n_teams == 1).alias("single"), count_if(n_teams == 0).alias("none")]

    def row(kind: str, a: int | None, b: int | None, value: Column) -> Column:
        left, right = F.lit(a).cast("long"), F.lit(b).cast("long")
        return F.struct(F.lit(kind).alias("kind"), left.alias("team_a"), right.alias("team_b"), value.alias("images"))

    rows = [row("pair", a, b, F.col(f"`{a}|{b}`")) for a, b in pairs]
    rows += [row("single", None, None, F.col("single")), row("none", None, None, F.col("none"))]
    return seen.agg(*sums).select(F.inline(F.array(*rows))).where("kind <> 'pair' OR images > 0")


def split_alignment(cells: DataFrame, *, image: str = "image") -> DataFrame:
    """Share of each team and of each image count in training and test data, and the difference."""
    per_image = cells.groupBy(image, "split").agg(F.min("count").alias("count"))
    teams = cells.where("label <> 0").select(F.lit("team").alias("kind"), F.col("label").alias("value"), "split")
    counts = per_image.select(F.lit("count").alias("kind"), F.col("count").alias("value"), "split")
    both = teams.unionByName(counts).groupBy("kind", "value").agg(
        count_if(F.col("split") == "Train").alias("train"), count_if(F.col("split") == "Test").alias("test")
    )
    kinds = Window.partitionBy("kind")
    shares = both.select(
        "kind",
        F.col("value").cast("long").alias("value"),
        ratio(F.col("train"), F.sum("train").over(kinds)).alias("train_share"),
        ratio(F.col("test"), F.sum("test").over(kinds)).alias("test_share"),
    )
    return shares.withColumn("difference", F.col("train_share") - F.col("test_share"))


def split_summary(cells: DataFrame, *, image: str = "image") -> DataFrame:
    """Images, rows and percent of rows by split, with the total."""
    per_image = cells.groupBy(image, "split").agg(F.count(F.lit(1)).alias("n"))
    rolled = per_image.rollup("split").agg(F.count(F.lit(1)).alias("images"), F.sum("n").alias("n_rows"))
    top = F.max("n_rows").over(Window.partitionBy(F.lit(0)))
    return rolled.select(
        F.coalesce("split", F.lit("Total")).alias("split"), "images", "n_rows", (F.col("n_rows") / top * 100).alias("percent")
    )


def hotspot(cells: DataFrame) -> DataFrame:
    """The row and the column with the highest mean presence, the first on ties."""
    sets = cells.groupingSets([["cell_row"], ["cell_col"]], "cell_row", "cell_col").agg(
        F.sum("player_present").alias("s"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")
    )
    axis = F.when(F.col("gid") == 1, "row").otherwise("col")
    ranked = sets.select(
        axis.alias("axis"), F.coalesce("cell_row", "cell_col").alias("at"), (F.col("s") / F.col("n")).alias("presence")
    )
    best = ranked.groupBy("axis").agg(
        F.min_by(F.struct("at", "presence"), F.struct(-F.col("presence"), F.col("at"))).alias("b")
    )
    return best.select("axis", F.col("b.at").alias("at"), F.col("b.presence").alias("presence"))


def image_activity(events: DataFrame) -> DataFrame:
    """Per image: who saved last, and whether anyone did."""
    save = F.col("action") == "save"
    return events.groupBy("image_id").agg(
        F.max_by("user", F.when(save, F.struct("ts", "event_id"))).alias("annotator"), F.max(F.when(save, 1)).alias("done")
    )


def progress_totals(images: DataFrame) -> DataFrame:
    """Images done per annotator (the last to save counts) and, as ``ALL``, done out of total."""
    rolled = images.withColumn("annotator", F.when(F.col("done") == 1, F.col("annotator"))).rollup("annotator").agg(
        F.count("done").alias("n_done"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")
    )
    return rolled.where("gid = 1 OR annotator IS NOT NULL").select(
        F.when(F.col("gid") == 1, "ALL").otherwise(F.col("annotator")).alias("annotator"),
        F.col("n_done").alias("done"),
        F.when(F.col("gid") == 1, F.col("n")).alias("total"),
    )


def annotation_progress(events: DataFrame) -> DataFrame:
    return progress_totals(image_activity(events))


def count_extremes(images: DataFrame, *, key: str = "image", count: str = "count", n: int = 5) -> DataFrame:
    """The image with the lowest, the middle and the highest count, and the ``n`` highest."""
    placed = positions(images.select(key, count), [], [count, key])
    tagged = placed.withColumn("_n", images.agg(F.count(F.lit(1))).scalar())
    kind = F.array_compact(
        F.array(
            F.when(F.col("pos") == 1, "low"),
            F.when(F.col("pos") == F.floor(F.col("_n") / 2) + 1, "middle"),
            F.when(F.col("pos") == F.col("_n"), "high"),
        )
    )
    spots = tagged.select(F.explode(kind).alias("kind"), key, count)
    top = images.orderBy(F.desc(count), key).limit(n).select(F.lit("top").alias("kind"), key, count)
    return spots.unionByName(top)
