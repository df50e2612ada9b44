"""Connected components of probability maps and the per-image features made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfare.functions import kernels
from gridfare.functions.columns import bound, total
from gridfare.operators.grid import cell_slots
from gridfare.schemas import CELLS, GRID

THRESHOLDS = (0.30, 0.50, 0.70)
# Map statistics, occupancy and component features, in file order.
STAT_FEATURES = [f"f_{s}_player_prob" for s in ("sum", "mean", "max", "std")]
OCCUPANCY_FEATURES = (
    [f"f_row_{r}_occ" for r in range(GRID)]
    + [f"f_col_{c}_occ" for c in range(GRID)]
    + ["f_upper_half_occ", "f_lower_half_occ", "f_middle_rows_occ"]
)
COMPONENT_FEATURES = ["occ_cells", "component_count", "largest_component", "second_largest_component",
                      "mean_component_size"]


def threshold_name(t: float) -> str:
    return f"t{int(t * 100):03d}"


def assemble_map(cells: DataFrame, keys: Sequence[str], *, value: str = "p", into: str = "map") -> DataFrame:
    """Cell probabilities gathered into one 64-long map per image."""
    packed = cell_slots(cells, keys, value)
    return packed.select(*keys, F.col("values").alias(into), F.lit(GRID).alias("height"), F.lit(GRID).alias("width"))


def _labels(m):
    return kernels.components(m > 0)


def grid_components(planes: DataFrame, *, values: str, above: float, into: str = "component") -> DataFrame:
    """8-connected components of ``value > above``: 1 + the lowest flat index of the component, else 0.

    A component never leaves its image, so an image is labelled where it already is, without a shuffle.
    """
    mask = F.transform(values, lambda p: F.when(p > above, 1.0).otherwise(0.0))
    run = kernels.plane_udf(_labels, "bigint")
    return planes.withColumn(into, run(mask, F.col("height"), F.col("width")))


def component_stats(
    planes: DataFrame, keys: Sequence[str], *, values: str = "map", thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Per threshold: occupied cells, components, the largest, the second largest and the mean size.

    A map is one record, so sizes are counted inside it: there is no shuffle.
    """
    names = [threshold_name(t) for t in thresholds]
    run = kernels.threshold_labels_udf(names, [float(t) for t in thresholds])
    marked = planes.withColumn("_labels", run(F.col(values), F.col("height"), F.col("width")))
    sized = marked.withColumns({f"_s_{n}": _component_sizes(F.col(f"_labels.{n}")) for n in names})
    out = []
    for n in names:
        sizes = F.col(f"_s_{n}")
        occupied = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)
        count = F.size(sizes).cast("long")
        figures = [
            occupied,
            count,
            F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)).cast("long"),
            F.coalesce(F.get(sizes, F.lit(1)), F.lit(0)).cast("long"),
            F.when(count > 0, occupied / count).otherwise(0.0),
        ]
        out += [v.alias(f"f_{f}_{n}") for f, v in zip(COMPONENT_FEATURES, figures)]
    return sized.select(*keys, *out)


def _component_sizes(labels: Column) -> Column:
    """Component sizes of one label plane, largest first."""
    found = F.array_distinct(F.filter(labels, lambda x: x > 0))
    sizes = F.transform(found, lambda d: F.size(F.filter(labels, lambda x: x == d)).cast("long"))
    return F.sort_array(sizes, asc=False)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def map_stats(planes: DataFrame, *, values: str = "map") -> DataFrame:
    """Sum, mean, maximum and population deviation of a map, inside its row."""
    size = F.size(values)
    mean = _sum(F.col(values)) / size
    spread = bound(
        mean, lambda m: F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, p: s + (p - m) * (p - m)) / F.size(values))
    )
    return planes.withColumns(dict(zip(STAT_FEATURES, [_sum(F.col(values)), mean, F.array_max(values), spread])))


def map_occupancy(planes: DataFrame, *, values: str = "map", above: float = 0.5) -> DataFrame:
    """Cells over the threshold by row, by column, in each half and in the middle rows."""
    on = [F.when(F.get(values, F.lit(i)) > above, 1).otherwise(0).cast("long") for i in range(CELLS)]
    rows = [total(on[r * GRID : (r + 1) * GRID]) for r in range(GRID)]
    columns = [total(on[c::GRID]) for c in range(GRID)]
    areas = [total(rows[:4]), total(rows[4:]), total(rows[1:7])]
    return planes.withColumns(dict(zip(OCCUPANCY_FEATURES, rows + columns + areas)))


def subset_map(planes: DataFrame, first: int, last: int, *, values: str = "map") -> DataFrame:
    """The map with every row outside ``first``..``last`` set to zero."""
    low, high = first * GRID, (last + 1) * GRID - 1
    kept = F.transform(values, lambda p, i: F.when(i.between(low, high), p).otherwise(0.0))
    return planes.withColumn(values, kept)


def count_feature_table(planes: DataFrame, keys: Sequence[str], *, values: str = "map") -> DataFrame:
    """The 38 map features of each image beside its keys (image, count, fold)."""
    flat = map_occupancy(map_stats(planes, values=values), values=values)
    return component_stats(flat, [*keys, *STAT_FEATURES, *OCCUPANCY_FEATURES], values=values)


def count_feature_columns(thresholds: Sequence[float] = THRESHOLDS) -> list[str]:
    names = [threshold_name(t) for t in thresholds]
    return STAT_FEATURES + OCCUPANCY_FEATURES + [f"f_{f}_{n}" for n in names for f in COMPONENT_FEATURES]


def label_totals(marked: DataFrame, keys: Sequence[str], *, labels: str = "component") -> DataFrame:
    """Size of every component."""
    rows = marked.select(*keys, F.explode(labels).alias("label")).where("label > 0")
    return rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("cells"))
