"""Structure and consistency checks on cell and image tables. Each returns the offending rows or figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfare.functions.columns import any_of, count_if
from gridfare.operators.grid import cell_slots
from gridfare.schemas import CELLS, GRID

# The columns a combined feature table must have.
REQUIRED_COLUMNS = [
    "image", "cell_row", "cell_col", "cell_id", "f_center_x", "f_center_y", "fold_id", "label", "player_present",
    "count",
]


def check_required_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> list[str]:
    """Required columns the table lacks."""
    return [c for c in required if c not in df.columns]


def check_binary_domain(df: DataFrame, column: str) -> DataFrame:
    """Values other than 0 and 1, with their counts; nulls are allowed."""
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(0, 1))
    return bad.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def check_cells_per_image(cells: DataFrame, *, image: str = "image", expected: int = CELLS) -> DataFrame:
    counts = cells.groupBy(image).agg(F.count(F.lit(1)).alias("cells"))
    return counts.where(F.col("cells") != expected)


def _varying(df: DataFrame, key: str, column: str) -> DataFrame:
    ends = df.groupBy(key).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return ends.where("low <> high")


def check_single_fold(cells: DataFrame, *, image: str = "image", fold: str = "fold_id") -> DataFrame:
    """Images found in more than one fold, with the lowest and highest."""
    return _varying(cells, image, fold)


def check_constant_count(cells: DataFrame, *, image: str = "image", count: str = "count") -> DataFrame:
    """Images whose rows disagree about the count, with the lowest and highest."""
    return _varying(cells, image, count)


def count_grid_agreement(cells: DataFrame, *, image: str = "image") -> DataFrame:
    """Images whose count is zero although cells are active, or the other way round."""
    figures = cells.groupBy(image).agg(F.max("count").alias("count"), count_if(F.col("label") > 0).alias("active"))
    return figures.where((F.col("count") == 0) != (F.col("active") == 0))


def check_image_size(images: DataFrame, *, width: int = 800, height: int = 600) -> DataFrame:
    """Images of any other size, an unknown one included."""
    good = (F.col("width") == width) & (F.col("height") == height)
    return images.where(~F.coalesce(good, F.lit(False)))


def edge_row_labels(cells: DataFrame) -> DataFrame:
    """Labelled cells of the top row, for review."""
    return cells.where((F.col("cell_row") == 0) & (F.col("label") > 0))


def isolated_cells(cells: DataFrame, *, image: str = "image") -> DataFrame:
    """Labelled cells with no equal label among their eight neighbours.

    The grid is gathered once per image and neighbours are looked up inside it: no self join.
    """
    grids = cell_slots(cells, [image], "label")
    rows = grids.select(image, "values", F.posexplode("values").alias("cell_id", "label")).where("label > 0")
    row, column = F.floor(F.col("cell_id") / GRID), F.col("cell_id") % GRID
    same = []
    for dy, dx in [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y, x) != (0, 0)]:
        inside = (row + dy).between(0, GRID - 1) & (column + dx).between(0, GRID - 1)
        neighbour = F.get("values", (F.col("cell_id") + dy * GRID + dx).cast("int"))
        same.append(inside & F.coalesce(neighbour == F.col("label"), F.lit(False)))
    lone = rows.where(~any_of(same))
    return lone.select(image, row.cast("long").alias("cell_row"), column.cast("long").alias("cell_col"), "label")


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls and NaNs per column, all in one pass."""
    floating = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    sums = []
    for c in df.columns:
        gone = F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull()
        sums.append(count_if(gone).alias(c))
    return df.agg(*sums).unpivot([], df.columns, "column", "missing")


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many rows repeat an earlier one in full. Rows are compared by digest, so long texts are not shuffled."""
    digest = F.sha2(F.to_json(F.struct(*(columns or df.columns))), 256)
    groups = df.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        count_if(F.col("n") > 1).alias("repeated_groups"),
    )

