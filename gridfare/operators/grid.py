"""Projections and reshaping between wide annotations, long cells and 8x8 grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfare.functions.columns import col, flag
from gridfare.functions.columns import image_number as number_in
from gridfare.schemas import CELL_HEIGHT, CELL_NAMES, CELL_WIDTH, CELLS, FOLD_LIMITS, GRID, NO_PLAYER_RANGE, TEAMS


def unpivot_cells(wide: DataFrame, *, ids: Sequence[str] = ("image", "split", "count")) -> DataFrame:
    """One row per cell of each image, with its name and number."""
    keys = [c for c in ids if c in wide.columns]
    long = wide.unpivot(keys, CELL_NAMES, "cell_name", "label")
    return long.withColumn("cell_num", F.substring("cell_name", 2, 2).cast("long"))


def cell_coordinates(cells: DataFrame, *, number: str = "cell_num") -> DataFrame:
    """Zero-based row, column and cell id from the 1-based cell number."""
    at = F.col(number) - 1
    return cells.withColumns(
        {
            "cell_id": at.cast("long"),
            "cell_row": F.floor(at / GRID).cast("long"),
            "cell_col": (at % GRID).cast("long"),
        }
    )


def cell_bounds(cells: DataFrame, *, width: int = CELL_WIDTH, height: int = CELL_HEIGHT) -> DataFrame:
    """Pixel bounds of a cell; the upper bounds are exclusive."""
    left, top = F.col("cell_col") * width, F.col("cell_row") * height
    return cells.withColumns({"x_min": left, "y_min": top, "x_max": left + width, "y_max": top + height})


def cell_position_features(cells: DataFrame) -> DataFrame:
    """Row, column and cell centre scaled to 0-1."""
    row, column = F.col("cell_row"), F.col("cell_col")
    return cells.withColumns(
        {
            "f_row_norm": row / (GRID - 1),
            "f_col_norm": column / (GRID - 1),
            "f_center_x": (column + 0.5) / GRID,
            "f_center_y": (row + 0.5) / GRID,
        }
    )


def player_present(cells: DataFrame) -> DataFrame:
    return cells.withColumn("player_present", flag(F.col("label") > 0))


def one_hot_row_col(cells: DataFrame) -> DataFrame:
    """Sixteen indicators, all present whatever values occur."""
    hot = {f"f_row_{i}": flag(F.col("cell_row") == i) for i in range(GRID)}
    hot |= {f"f_col_{i}": flag(F.col("cell_col") == i) for i in range(GRID)}
    return cells.withColumns(hot)


def image_number(df: DataFrame, *, image: str = "image") -> DataFrame:
    return df.withColumn("image_num", number_in(F.col(image)))


def assign_fold(df: DataFrame, *, limits: Sequence[int] = FOLD_LIMITS, number: str = "image_num") -> DataFrame:
    """Folds 1.. by image number; each limit is the last number of its fold."""
    fold = F.lit(len(limits) + 1)
    for i in range(len(limits) - 1, -1, -1):
        fold = F.when(F.col(number) <= limits[i], i + 1).otherwise(fold)
    return df.withColumn("fold_id", F.when(F.col(number).isNotNull(), fold).cast("long"))


def team_names(df: DataFrame, *, label: str = "label") -> DataFrame:
    """Team name of a label; an unknown label stays, with no name. The dictionary has eleven fixed entries."""
    pairs = [F.lit(x) for item in TEAMS.items() for x in item]
    return df.withColumn("team", F.try_element_at(F.create_map(*pairs), F.col(label).cast("int")))


def rebase_indices(df: DataFrame, *, one_based: bool = True) -> DataFrame:
    """Rows and columns counted from 1 to counted from 0, when the flag says so."""
    if not one_based:
        return df
    return df.withColumns({"cell_row": F.col("cell_row") - 1, "cell_col": F.col("cell_col") - 1})


def to_matrix(flat: str | Column, *, width: int = GRID, height: int = GRID) -> Column:
    """Row-major array to an array of rows."""
    rows = F.sequence(F.lit(0), F.lit(height - 1))
    return F.transform(rows, lambda r: F.slice(col(flat), r * width + 1, width))


def grid_matrix(df: DataFrame, flat: str, *, into: str = "matrix") -> DataFrame:
    return df.withColumn(into, to_matrix(flat))


def cell_slots(cells: DataFrame, keys: Sequence[str], value: str | Column, *, index: str = "cell_id") -> DataFrame:
    """One row per image with its 64 values in cell order, missing cells null.

    The slots are fixed-size aggregates, so cells combine before the shuffle and a repeated cell costs nothing.
    """
    slots = [F.max(F.when(F.col(index) == i, col(value))).alias(f"_s{i}") for i in range(CELLS)]
    packed = F.array(*[F.col(f"_s{i}") for i in range(CELLS)]).alias("values")
    return cells.groupBy(*keys).agg(*slots).select(*keys, packed)


def dominant_label(cells: DataFrame, *, image: str = "image") -> DataFrame:
    """Most frequent label of an image, the lowest on ties."""
    counts = cells.groupBy(image, "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(image).agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), F.col("label"))).alias("b"))
    return best.select(image, F.col("b.label").alias("label"), F.col("b.n").alias("cells"))


def image_group(df: DataFrame, *, number: str = "image_num") -> DataFrame:
    """``batch_1``, ``no_player`` or ``batch_2`` by image number."""
    first, last = NO_PLAYER_RANGE
    group = F.when(F.col(number) < first, "batch_1").when(F.col(number) <= last, "no_player").otherwise("batch_2")
    return df.withColumn("image_group", group)


def feature_columns(df: DataFrame, *, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that start with ``f`` or ``tex_``, in schema order, without the excluded ones."""
    chosen = []
    for field in df.schema:
        named = field.name.startswith(("f", "tex_")) and field.name not in exclude
        if named and isinstance(field.dataType, T.NumericType):
            chosen.append(field.name)
    return chosen


def melt_features(df: DataFrame, features: Sequence[str], *, by: str) -> DataFrame:
    """Selected features as (class, feature, value) rows."""
    typed = df.select(by, *[F.col(f).cast("double").alias(f) for f in features])
    return typed.unpivot([by], list(features), "feature", "value")


def bin_region(cells: DataFrame, *, row: str = "cell_row") -> DataFrame:
    """``upper`` rows 0-1, ``middle`` rows 2-5, ``lower`` rows 6-7."""
    region = F.when(F.col(row) <= 1, "upper").when(F.col(row) <= 5, "middle").otherwise("lower")
    return cells.withColumn("region", region)


def prepared_cells(wide: DataFrame) -> DataFrame:
    """The usual chain from wide annotations to cells with coordinates, presence, number and fold."""
    return assign_fold(image_number(player_present(cell_coordinates(unpivot_cells(wide)))))
