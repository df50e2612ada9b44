"""Search planning: the route universe, its rotation over days, and the tasks of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfare.functions.columns import col
from gridfare.functions.ranking import positions
from gridfare.schemas import BATCHES, DISPLAY_ZONE, HORIZONS, ROTATION_EPOCH


def route_universe(airports: DataFrame, *, code: str = "code") -> DataFrame:
    """All ordered pairs of distinct codes, with their index in sorted order.

    The output is quadratic in the codes by definition. Codes are numbered by ranges of their order; a pair is made from its
    index by arithmetic, so tasks hold equal shares of the indices, and looks up its two codes by number.
    """
    spark = airports.sparkSession
    codes = airports.select(F.col(code).alias("code")).where("code is not null").distinct()
    numbered = positions(codes, [], ["code"], into="place")
    n = numbered.count()
    pairs = spark.range(n * (n - 1)).select(
        F.col("id").alias("route_idx"), F.expr(f"id div {max(n - 1, 1)}").alias("i"), (F.col("id") % F.lit(max(n - 1, 1))).alias("_j")
    )
    ends = pairs.select("route_idx", "i", (F.col("_j") + F.when(F.col("_j") >= F.col("i"), 1).otherwise(0)).alias("j"))
    origins = numbered.select((F.col("place") - 1).alias("i"), F.col("code").alias("origin"))
    targets = numbered.select((F.col("place") - 1).alias("j"), F.col("code").alias("destination"))
    whole = ends.join(origins, "i").join(targets, "j")
    return whole.select("origin", "destination", "route_idx", F.lit(n * (n - 1)).cast("long").alias("n_routes"))


def _split(position: Column, size: Column, parts: int) -> tuple[Column, Column, Column]:
    """(part, position in part, part size) for contiguous equal parts; the last one takes the remainder."""
    if parts < 1:
        raise ValueError("the number of parts must be at least 1")
    each = F.floor(size / parts)
    part = F.when(each == 0, parts - 1).otherwise(F.least(F.floor(position / each), F.lit(parts - 1)))
    length = F.when(part == parts - 1, size - each * (parts - 1)).otherwise(each)
    return part.cast("long"), (position - part * each).cast("long"), length.cast("long")


def assign_batches(routes: DataFrame, *, batches: int = BATCHES) -> DataFrame:
    """Every route with its batch index and its place there."""
    part, place, size = _split(F.col("route_idx"), F.col("n_routes"), batches)
    return routes.select("*", part.alias("batch"), place.alias("batch_pos"), size.alias("batch_size"))


def batch_of_routes(routes: DataFrame, *, index: int, batches: int = BATCHES) -> DataFrame:
    """Contiguous batch ``index`` (0-based) of ``batches``."""
    if not 0 <= index < batches:
        raise ValueError(f"batch index {index} is outside 0..{batches - 1}")
    return assign_batches(routes, batches=batches).where(F.col("batch") == index)


def slice_of_batch(batch: DataFrame, *, part: int, parts: int) -> DataFrame:
    """Slice ``part`` (1-based) of ``parts`` of one batch, under the same remainder rule."""
    if not 1 <= part <= parts:
        raise ValueError(f"slice {part} is outside 1..{parts}")
    index, place, _ = _split(F.col("batch_pos"), F.col("batch_size"), parts)
    cut = batch.select("*", (index + 1).alias("slice"), place.alias("slice_pos"))
    return cut.where(F.col("slice") == part)


def rotation_index(df: DataFrame, day: str | Column, *, batches: int = BATCHES) -> DataFrame:
    """Batch index and cycle of a UTC day; a pure function of the date."""
    if batches < 1:
        raise ValueError("batches must be at least 1")
    days = F.datediff(col(day), F.lit(ROTATION_EPOCH).cast("date"))
    return df.select(
        "*",
        F.pmod(days, F.lit(batches)).cast("long").alias("batch_index"),
        F.floor(days / batches).cast("long").alias("cycle"),
    )


def search_tasks(
    routes: DataFrame, now: str | Column, *, horizons: Sequence[int] = HORIZONS, zone: str = DISPLAY_ZONE
) -> DataFrame:
    """Routes times horizons, with the departure date counted from the local date of ``now``."""
    local = F.from_utc_timestamp(col(now), zone)
    each = F.posexplode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon_pos", "days_out")
    return routes.select("*", each).withColumn("target_date", F.date_add(F.to_date(local), F.col("days_out")))


def parse_route_spec(df: DataFrame, *, spec: str = "spec") -> DataFrame:
    """One row per route in specs such as ``BOM:DEL,DEL:BOM``; ``problem`` is set for bad parts and empty specs."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    rows = df.select("*", F.posexplode_outer(parts).alias("part_pos", "part"))
    at = F.locate(":", F.col("part"))
    origin = F.upper(F.trim(F.expr("substring(part, 1, locate(':', part) - 1)")))
    destination = F.upper(F.trim(F.expr("substring(part, locate(':', part) + 1)")))
    problem = (
        F.when(F.col("part").isNull(), "no routes")
        .when(at == 0, "expected ORIGIN:DEST")
        .when((origin == "") | (destination == ""), "empty side")
    )
    good = problem.isNull()
    return rows.select(
        *df.columns,
        F.col("part_pos").cast("long").alias("part_pos"),
        F.when(good, origin).alias("origin"),
        F.when(good, destination).alias("destination"),
        problem.alias("problem"),
    )


def cap_tasks(
    tasks: DataFrame,
    *,
    max_routes: int | None = None,
    max_horizons: int | None = None,
    routes: Sequence[tuple[str, str]] | None = None,
    horizons: Sequence[int] | None = None,
) -> DataFrame:
    """The first routes of the batch and the first horizons; an explicit list wins over a count."""
    keep = tasks
    if routes is not None:
        wanted = [f"{o}>{d}" for o, d in routes]
        keep = keep.where(F.concat_ws(">", "origin", "destination").isin(wanted))
    elif max_routes and max_routes > 0:
        keep = keep.where(F.col("batch_pos") < max_routes)
    if horizons is not None:
        keep = keep.where(F.col("days_out").isin([int(h) for h in horizons]))
    elif max_horizons and max_horizons > 0:
        keep = keep.where(F.col("horizon_pos") < max_horizons)
    return keep


def route_coverage(routes: DataFrame, run_days: DataFrame, *, day: str = "day", batches: int = BATCHES) -> DataFrame:
    """Routes not covered exactly once in a rotation window, from the days on which a run took place.

    All windows from the first to the last run count, also those without any run. Runs are counted per window and batch,
    so only the faulty pairs meet the route table, whose rows they multiply by definition.
    """
    turns = rotation_index(run_days, day, batches=batches)
    times = turns.groupBy("cycle", "batch_index").agg(F.count(F.lit(1)).alias("times"))
    ends = times.agg(F.min("cycle").alias("first"), F.max("cycle").alias("last")).where("first IS NOT NULL")
    windows = ends.select(F.explode(F.sequence("first", "last")).alias("cycle"))
    wanted = windows.select("cycle", F.explode(F.array(*[F.lit(b).cast("long") for b in range(batches)])).alias("batch"))
    ran = times.withColumnRenamed("batch_index", "batch")
    filled = wanted.join(ran, ["cycle", "batch"], "left").fillna(0, ["times"]).where("times <> 1")
    batched = assign_batches(routes, batches=batches)
    return filled.join(batched, "batch").select("cycle", "origin", "destination", F.col("times").cast("long"))
