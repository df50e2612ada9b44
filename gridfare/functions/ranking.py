"""Positions, running sums and exact quantiles that stay whole when one group is very large.

A window over a whole group puts the group in one task. For positions rows are dealt out by ranges of the whole order, of
which Spark draws the borders from a sample, and numbered there. Running sums are for counted values: a group is cut into
blocks by a function of the first order column that never decreases with it, so no pass over the data is needed to choose
the cuts. Values are ordered inside (group, block), and shifted by the totals of the group's earlier blocks, which are one
small row each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from gridfare.session import scratch_path

#: Blocks per unit of the logarithm of a number, and leading characters that make a block of texts.
BLOCKS_PER_LOG, BLOCK_CHARS = 4096, 12


def order_block(df: DataFrame, name: str) -> Column:
    """The block of an order column: equal values share one, larger values never have a smaller one; null stays null."""
    kind, value = df.schema[name].dataType, df[name]
    if isinstance(kind, StringType):
        return F.substring(value, 1, BLOCK_CHARS)
    if isinstance(kind, DateType):
        value = F.unix_date(value)
    elif isinstance(kind, TimestampNTZType):
        value = value.cast("timestamp")
    elif not isinstance(kind, (NumericType, BooleanType, TimestampType)):
        return F.lit(0)
    x = value.cast("double")
    step = (F.signum(x) * F.floor(F.log1p(F.abs(x)) * BLOCKS_PER_LOG)).cast("long")
    # Not-a-number sorts after all numbers; infinity casts to the largest long but one block below it.
    return F.when(F.isnan(x), F.lit(2**63 - 1)).when(value.isNotNull(), F.least(step, F.lit(2**63 - 2)))


def _group(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


_MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    *,
    stats: Mapping[str, tuple[str, Column]] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums within ``keys``; ``order`` must be unique inside a group.

    ``descending`` turns the first order column around. ``stats`` adds figures of the whole group, each a way to merge
    (``sum``, ``min`` or ``max``) and a column; they come from the block totals.
    """
    stats = stats or {}
    rows = df.withColumns({"_block": order_block(df, order[0]), **{f"_add_{name}": value for name, value in sums.items()}})

    def turned(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    inside = Window.partitionBy(*keys, "_block").orderBy(turned(order[0]), *order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({name: F.sum(f"_add_{name}").over(inside) for name in sums})
    totals = rows.groupBy(*keys, "_block").agg(
        *[F.sum(f"_add_{name}").alias(f"_sum_{name}") for name in sums],
        *[_MERGES[how](value).alias(f"_part_{name}") for name, (how, value) in stats.items()],
    )
    before = _group(keys).orderBy(turned("_block")).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *[F.col(key).alias(f"_key_{place}") for place, key in enumerate(keys)],
        F.col("_block").alias("_at"),
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_off_{name}") for name in sums],
        *[_MERGES[how](f"_part_{name}").over(_group(keys)).alias(f"_all_{name}") for name, (how, _) in stats.items()],
    )
    here = F.col("_block").eqNullSafe(F.col("_at"))
    for place, key in enumerate(keys):
        here = here & F.col(key).eqNullSafe(F.col(f"_key_{place}"))
    joined = local.join(shifts, here)
    return joined.select(
        *[F.col(c) for c in df.columns if c not in sums and c not in stats],
        *[(F.col(name) + F.col(f"_off_{name}")).alias(name) for name in sums],
        *[F.col(f"_all_{name}").alias(name) for name in stats],
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, into: str = "pos") -> DataFrame:
    """Add the 1-based position of each row within ``keys``; ``order`` should be unique inside a group.

    Rows are dealt out by ranges of keys and order and sorted there, so neither one large group, nor equal beginnings of texts,
    nor one popular first value meets in one task. They are written once with their number inside their range; a group's rows
    lie side by side in each range, and what its earlier ranges hold is added, a row per range and group.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    path = scratch_path(spark, "positions")
    dealt.withColumn("_line", F.monotonically_increasing_id()).write.parquet(path)
    lines = spark.read.parquet(path).withColumn("_range", F.shiftright("_line", 33))
    parts = lines.groupBy(*keys, "_range").agg(F.min("_line").alias("_begin"), F.count(F.lit(1)).alias("_held"))
    before = _group(keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        *[F.col(key).alias(f"_key_{place}") for place, key in enumerate(keys)],
        F.col("_range").alias("_at"), "_begin", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"),
    )
    here = F.col("_range") == F.col("_at")
    for place, key in enumerate(keys):
        here = here & F.col(key).eqNullSafe(F.col(f"_key_{place}"))
    place = (F.col("_line") - F.col("_begin") + F.col("_before") + 1).alias(into)
    return lines.join(shifts, here).select(*[F.col(c) for c in df.columns if c != into], place)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    weight: str | None = None,
    stats: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs``.

    Values are counted first, so what is ordered is distinct values, and no group is held in memory. ``weight`` names a
    column of counts when the caller has done that already; ``stats`` then adds figures of the group, as in ``running_sums``.
    """
    known = df.where(F.col(value).isNotNull())
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    seen = known.groupBy(*keys, value).agg(rows.alias("_c"))
    stats = stats or {}
    located = running_sums(seen, keys, [value], {"_upto": F.col("_c")}, stats={"_n": ("sum", F.col("_c")), **stats})

    def at(index: Column) -> Column:
        inside = (F.col("_upto") > index) & (F.col("_upto") - F.col("_c") <= index)
        return F.max(F.when(inside, F.col(value)))

    aggs = []
    for name, prob in probs.items():
        place = F.lit(prob) * (F.col("_n") - 1)
        aggs += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}")]
    ends = located.groupBy(*keys, "_n", *stats).agg(*aggs)
    out = []
    for name, prob in probs.items():
        place = F.lit(prob) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return ends.select(*keys, *stats, *out)
