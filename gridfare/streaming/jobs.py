"""Structured Streaming jobs. Every job shares its definition with a batch operator on the same columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridfare.functions.columns import count_if, image_number, ratio
from gridfare.functions.ranking import positions
from gridfare.operators.explore import image_activity, progress_totals
from gridfare.operators.fares import explode_pages, fare_rows, normalise_itineraries
from gridfare.operators.quality import valid_rows, validate_fares
from gridfare.schemas import NO_PLAYER_RANGE, STALE_HOURS

# ---- sinks ----


def run_complete(
    aggregated: DataFrame,
    path: str,
    checkpoint: str,
    *,
    summarise: Callable[[DataFrame], DataFrame] = lambda df: df,
    mode: str = "complete",
) -> StreamingQuery:
    """Start a job that rewrites ``path`` with the (summarised) state after every batch, until the input is read.

    The whole table is replaced, so a batch that is tried again leaves the same result.
    """

    def store(batch: DataFrame, _: int) -> None:
        summarise(batch).write.mode("overwrite").parquet(path)

    writer = aggregated.writeStream.outputMode(mode).foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start an append job into parquet; the file sink's own log makes it exactly once."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- fares ----


def page_fares(pages: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """Validated fare rows of one batch of result pages, with the columns of the pages that ``keep`` names.

    ``pages``: search_id, origin, destination, days_out, now and the page text ``body``.
    """
    tasks = pages.drop("body")
    entries = explode_pages(pages.select("search_id", "body")).withColumnRenamed("entry_pos", "rank")
    return validate_fares(fare_rows(tasks, normalise_itineraries(entries), keep=keep))


def stream_fares(pages: DataFrame, path: str, checkpoint: str, *, lateness: str = "1 day") -> StreamingQuery:
    """Result pages to monthly fare files.

    A search read twice within the watermark is dropped. Each batch owns a folder per month and overwrites it when
    it is tried again, so the files hold every row once.
    """
    timed = pages.withColumn("now", F.col("now").cast("timestamp"))
    once = timed.withWatermark("now", lateness).dropDuplicatesWithinWatermark(["search_id"])

    def store(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        rows = valid_rows(page_fares(held, keep=["now"]))
        dated = rows.withColumns({"year_month": F.date_format("now", "yyyy_MM"), "batch_id": F.lit(batch_id)})
        writer = dated.drop("now").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("year_month", "batch_id").parquet(path)
        held.unpersist()

    writer = once.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def fare_rate_windows(attempts: DataFrame, *, ts: str = "ts", every: str = "3 hours", lateness: str | None = None) -> DataFrame:
    """Attempts, successes and fare rate per tumbling window; a watermark lets finished windows be appended."""
    timed = attempts.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, lateness) if lateness else timed
    counted = timed.groupBy(F.window(ts, every).alias("w")).agg(
        F.count(F.lit(1)).alias("attempted"), count_if(F.col("status") == "ok").alias("with_fares")
    )
    return counted.select(
        F.col("w.start").alias("window_start"),
        "attempted",
        "with_fares",
        ratio(F.col("with_fares"), F.col("attempted")).alias("fare_rate"),
    )


def hourly_activity(events: DataFrame, *, ts: str = "ts") -> DataFrame:
    """First and last event of every hour that has any."""
    hour = F.window(ts, "1 hour")
    return events.groupBy(hour.alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def _epoch(name: str) -> Column:
    return F.col(name).cast("timestamp").cast("double")


def stale_alert(hours: DataFrame, *, stale_hours: float = STALE_HOURS) -> DataFrame:
    """Silences longer than the limit, from :func:`hourly_activity`.

    A silence lies between two neighbouring active hours. Hours are numbered by ranges of time, and each looks up the one
    before it, so no task holds all of them. The first hour has none.
    """
    numbered = positions(hours.select("first_ts", "last_ts"), [], ["first_ts"], into="place")
    before = numbered.select((F.col("place") + 1).alias("place"), F.col("last_ts").alias("silent_from"))
    gaps = numbered.select("place", F.col("first_ts").alias("silent_until")).join(before, "place")
    length = (_epoch("silent_until") - _epoch("silent_from")) / 3600
    return gaps.select("silent_from", "silent_until", length.alias("hours")).where(F.col("hours") > stale_hours)


# ---- annotations ----


def autosave_debounce(events: DataFrame, *, gap: str = "800 milliseconds", lateness: str | None = None) -> DataFrame:
    """The last save of each burst of saves by one user on one image."""
    saves = events.where("action = 'save'").withColumn("ts", F.col("ts").cast("timestamp"))
    timed = saves.withWatermark("ts", lateness) if lateness else saves
    burst = F.session_window("ts", gap)
    last = timed.groupBy("image_id", "user", burst.alias("w")).agg(
        F.max_by(F.struct("ts", "event_id", "count"), F.struct("ts", "event_id")).alias("s"),
        F.count(F.lit(1)).alias("merged"),
    )
    return last.select(
        "image_id", "user", F.col("s.ts").alias("ts"), F.col("s.event_id").alias("event_id"),
        F.col("s.count").alias("count"), "merged",
    )


def current_annotations(events: DataFrame) -> DataFrame:
    """The latest save of every image."""
    saves = events.where("action = 'save'")
    latest = F.max_by(F.struct("user", "count", "ts", "event_id"), F.struct("ts", "event_id")).alias("s")
    return saves.groupBy("image_id").agg(latest).select("image_id", "s.*")


def live_progress(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Done and total images, and done per annotator, rewritten after every batch."""
    return run_complete(image_activity(events), path, checkpoint, summarise=progress_totals)


def no_player_default(images: DataFrame, *, image: str = "image", count: str = "count") -> DataFrame:
    """Images of the no-player range arrive with count 0, whatever they carried."""
    inside = image_number(F.col(image)).between(*NO_PLAYER_RANGE)
    return images.withColumn(count, F.when(inside, F.lit(0).cast(images.schema[count].dataType)).otherwise(F.col(count)))
