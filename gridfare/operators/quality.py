"""Fare validation, run gates and audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfare.functions.columns import any_of, count_if, ratio
from gridfare.functions.ranking import exact_quantiles
from gridfare.schemas import (
    DATA_SOURCES,
    EXIT_GATE,
    EXIT_OK,
    FARE_COLUMNS,
    FLIGHT_CATEGORIES,
    HORIZONS,
    MAX_PRICE,
    MIN_PRICE,
    MIN_SUCCESS_RATE,
    PRICED_CATEGORIES,
    SCHEMA_VERSION,
    STALE_HOURS,
)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _day_count(fares: DataFrame) -> Column:
    """Days to departure as an integer, null when it is not one. Text must be digits; a number is truncated."""
    if isinstance(fares.schema["Days_to_Departure"].dataType, T.StringType):
        digits = F.trim("Days_to_Departure")
        return F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("long"))
    return F.col("Days_to_Departure").try_cast("long")


def reject_reason(fares: DataFrame, *, min_price: float = MIN_PRICE, max_price: float = MAX_PRICE) -> Column:
    """The first rule a row breaks, null for a good row."""
    if [c for c in FARE_COLUMNS if c not in fares.columns]:
        return F.lit("missing_fields")
    origin, destination = _text("Source_City"), _text("Destination_City")
    days = _day_count(fares)
    leaves = _text("Departure_Date")
    category, price_text = _text("Flight_Category"), F.trim(_text("Price_INR"))
    price = price_text.try_cast("double")
    priced = category.isin(PRICED_CATEGORIES)
    code = r"^[A-Z]{3}$"
    rules = [
        (~_text("Schema_Version").eqNullSafe(str(SCHEMA_VERSION)), "schema_version"),
        (~(origin.rlike(code) & destination.rlike(code)), "route_not_iata"),
        (origin == destination, "same_city"),
        (days.isNull(), "days_not_int"),
        (days < 0, "days_negative"),
        (
            ~leaves.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") | F.try_to_timestamp(leaves, F.lit("yyyy-M-d")).isNull(),
            "departure_date",
        ),
        (~category.isin(FLIGHT_CATEGORIES), "category"),
        (~_text("Data_Source").isin(DATA_SOURCES), "data_source"),
        (priced & (price_text == ""), "price_empty"),
        (priced & price.isNull(), "price_not_numeric"),
        (priced & ~((price >= min_price) & (price <= max_price)), "price_out_of_band"),
        ((category == "NoFlights") & (price_text != ""), "price_on_no_flights"),
    ]
    # One chain, not a coalesce of conditions: a filter on the result then stays a single walk through the rules.
    return reduce(lambda chain, rule: chain.when(*rule), rules[1:], F.when(*rules[0]))


def validate_fares(fares: DataFrame, *, min_price: float = MIN_PRICE, max_price: float = MAX_PRICE) -> DataFrame:
    """Every row with ``reject_reason``; null means it may be written."""
    return fares.withColumn("reject_reason", reject_reason(fares, min_price=min_price, max_price=max_price))


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.where("reject_reason is null").drop("reject_reason")


def rejected_rows(validated: DataFrame) -> DataFrame:
    return validated.where("reject_reason is not null")


def reject_summary(validated: DataFrame) -> DataFrame:
    """Dropped rows by reason; good rows form the null group, whose count of reasons is 0."""
    counts = validated.groupBy("reject_reason").agg(F.count("reject_reason").alias("rows_dropped"))
    return counts.where("rows_dropped > 0")


def run_summary(tasks: DataFrame, validated: DataFrame, *, run: str = "run_id", search: str = "search_id") -> DataFrame:
    """One row of counters per run.

    ``tasks`` carries ``outcome`` (``fares``, ``empty``, ``timeout``, ``error``). The fare rate counts searches
    before validation; ``valid_fare_rate`` counts those that kept a priced row.
    """
    good = F.col("reject_reason").isNull()
    per_search = validated.groupBy(search).agg(
        count_if(good).alias("_written"),
        count_if(~good).alias("_dropped"),
        F.max(F.when(F.col("Flight_Category").isin(PRICED_CATEGORIES), 1)).alias("_priced"),
        F.max(F.when(good & F.col("Flight_Category").isin(PRICED_CATEGORIES), 1)).alias("_valid"),
    )
    failed = F.col("outcome").isin("timeout", "error")
    counted = tasks.join(per_search, search, "left").groupBy(run).agg(
        F.count(F.lit(1)).alias("attempted"),
        count_if(~failed & (F.col("_priced") == 1)).alias("with_fares"),
        count_if(~failed & F.col("_priced").isNull()).alias("no_flights"),
        count_if(failed).alias("errored"),
        F.coalesce(F.sum(F.when(~failed, F.col("_written"))), F.lit(0)).alias("rows_written"),
        F.coalesce(F.sum(F.when(~failed, F.col("_dropped"))), F.lit(0)).alias("rows_dropped"),
        count_if(~failed & (F.col("_valid") == 1)).alias("_with_valid"),
    )
    return counted.select(
        *[c for c in counted.columns if c != "_with_valid"],
        ratio(F.col("with_fares"), F.col("attempted")).alias("fare_rate"),
        ratio(F.col("_with_valid"), F.col("attempted")).alias("valid_fare_rate"),
    )


def attempt_outcome(log: DataFrame, keys: Sequence[str], *, status: str = "status", attempt: str = "attempt") -> DataFrame:
    """``fares`` when any attempt succeeded, otherwise the status of the last attempt."""
    grouped = log.groupBy(*keys).agg(
        F.bool_or(F.col(status) == "ok").alias("_ok"),
        F.max_by(status, attempt).alias("_last"),
        F.count(F.lit(1)).alias("attempts"),
    )
    return grouped.select(*keys, "attempts", F.when(F.col("_ok"), "fares").otherwise(F.col("_last")).alias("outcome"))


def quality_gate(summary: DataFrame, *, min_rate: float = MIN_SUCCESS_RATE) -> DataFrame:
    """Whether a run may pass: something was attempted and the fare rate reaches the minimum."""
    return summary.withColumn("passed", (F.col("attempted") > 0) & (F.col("fare_rate") >= min_rate))


def publish_decision(
    summary: DataFrame, *, min_rate: float = MIN_SUCCESS_RATE, keep_below_gate: bool = True
) -> DataFrame:
    """``publish``, ``publish_degraded`` or ``reject``, with the exit code."""
    gated = quality_gate(summary, min_rate=min_rate)
    kept = F.lit(keep_below_gate) & (F.col("rows_written") > 0)
    decision = F.when(F.col("passed"), "publish").when(kept, "publish_degraded").otherwise("reject")
    code = F.when(decision == "reject", EXIT_GATE).otherwise(EXIT_OK).cast("long")
    return gated.select("*", decision.alias("decision"), code.alias("exit_code"))


def canary_check(results: DataFrame, keys: Sequence[str], *, origin: str, destination: str) -> DataFrame:
    """Per window: was there any priced result on the probe route, and the cheapest."""
    probe = (F.col("origin") == origin) & (F.col("destination") == destination)
    return results.groupBy(*keys).agg(
        count_if(probe).alias("probe_results"),
        (count_if(probe & (F.col("price") > 0)) > 0).alias("canary_ok"),
        F.min(F.when(probe & (F.col("price") > 0), F.col("price"))).alias("cheapest"),
    )


def legacy_filter(fares: DataFrame, *, min_price: float = MIN_PRICE, max_price: float = MAX_PRICE) -> DataFrame:
    """Version 4 and later, or a legacy price inside the band; a missing price counts as 0."""
    price = F.coalesce(F.col("Price_INR"), F.lit(0))
    return fares.where((F.col("Schema_Version") >= SCHEMA_VERSION) | price.between(min_price, max_price))


def plausibility_audit(fares: DataFrame, *, min_price: float = MIN_PRICE, max_price: float = MAX_PRICE) -> DataFrame:
    """Plausible and implausible priced rows by category and source, with totals and the bogus share."""
    plausible = F.col("Price_INR").between(min_price, max_price)
    cube = fares.where("Price_INR is not null").cube("Flight_Category", "Data_Source").agg(
        count_if(plausible).alias("plausible"), count_if(~plausible).alias("implausible")
    )
    total_rows = F.col("plausible") + F.col("implausible")
    return cube.select(
        F.coalesce("Flight_Category", F.lit("ALL")).alias("Flight_Category"),
        F.coalesce("Data_Source", F.lit("ALL")).alias("Data_Source"),
        "plausible",
        "implausible",
        ratio(F.col("implausible"), total_rows).alias("bogus_share"),
    )


#: The columns whose values a profile counts, and the values that each may have.
PROFILED = {
    "Schema_Version": tuple(str(v) for v in range(1, SCHEMA_VERSION + 1)),
    "Flight_Category": FLIGHT_CATEGORIES,
    "Data_Source": DATA_SOURCES,
    "Days_to_Departure": tuple(str(h) for h in HORIZONS),
}


def dataset_profile(fares: DataFrame) -> DataFrame:
    """(field, value, n_rows, expected): rows, routes and time span, and how often each value of the small domains occurs.

    Every value is counted as it is; ``expected`` tells whether its domain has it. A null value is a value of its own and never
    expected. Routes are counted in ``n_rows`` of the field ``routes``, the field ``rows`` counts all rows, and ``first_scrape``
    and ``last_scrape`` have the times as values.
    """
    size = fares.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("Source_City", "Destination_City").alias("routes"),
        F.min("Scrape_Timestamp").alias("first"), F.max("Scrape_Timestamp").alias("last"),
    )
    nothing, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    whole = [("rows", nothing, F.col("rows")), ("routes", nothing, F.col("routes")), ("first_scrape", F.col("first"), none), ("last_scrape", F.col("last"), none)]
    spans = F.array(*[F.struct(F.lit(field).alias("field"), value.alias("value"), n.alias("n_rows"), F.lit(True).alias("expected")) for field, value, n in whole])
    long = fares.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in PROFILED])).alias("v")).select("v.*")
    counted = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    expected = F.lit(False)
    for field, domain in PROFILED.items():
        expected = F.when(F.col("field") == field, F.col("value").isin(*domain)).otherwise(expected)
    return counted.withColumn("expected", F.coalesce(expected, F.lit(False))).unionByName(size.select(F.inline(spans)))


def integrity_counts(fares: DataFrame) -> DataFrame:
    """Rows by month, by version and by category, and distinct routes, in one pass."""
    month = F.substring("Scrape_Timestamp", 1, 7)
    base = fares.select(
        month.alias("month"),
        F.col("Schema_Version").cast("string").alias("version"),
        F.col("Flight_Category").alias("category"),
        F.concat_ws(">", "Source_City", "Destination_City").alias("route"),
    )
    # Routes are few; counting per route first keeps the distinct count cheap and mergeable.
    seen = base.groupBy("month", "version", "category", "route").agg(F.count(F.lit(1)).alias("n"))
    sets = seen.groupingSets([["month"], ["version"], ["category"]], "month", "version", "category").agg(
        F.sum("n").alias("n_rows"), F.countDistinct("route").alias("routes"), F.grouping_id().alias("gid")
    )
    by = F.when(F.col("gid") == 3, "month").when(F.col("gid") == 5, "version").otherwise("category")
    return sets.select(by.alias("by"), F.coalesce("month", "version", "category").alias("value"), "n_rows", "routes")


def lead_time_bands(fares: DataFrame) -> DataFrame:
    """Fare statistics by horizon, departure weekday, booking weekday and category."""
    keys = ["Days_to_Departure", "Day_of_Week", "Booking_Day_Of_Week", "Flight_Category"]
    # Counted per price once; all figures come from one pass over the counts.
    counts = fares.where("Price_INR is not null").groupBy(*keys, "Price_INR").agg(F.count(F.lit(1)).alias("_rows"))
    price, rows = F.col("Price_INR"), F.col("_c")
    basics = {"n": ("sum", rows), "_total": ("sum", price * rows), "min_price": ("min", price), "max_price": ("max", price)}
    bands = exact_quantiles(counts, keys, "Price_INR", {"q25": 0.25, "median_price": 0.5, "q75": 0.75}, weight="_rows", stats=basics)
    return bands.select(*keys, "n", (F.col("_total") / F.col("n")).alias("mean_price"), "min_price", "max_price", "q25", "median_price", "q75")


# ---- run health ----


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), when))


def _found(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("message", pattern, 1), F.lit(""))


def _run_figures(logs: DataFrame) -> DataFrame:
    error = F.when(any_of([F.col("message").contains(w) for w in ("ERROR", "FAILED", "gate trip", "TIMEOUT")])
                   | (F.col("level") == "ERROR"), F.col("message"))
    order = F.struct("ts", "message")
    return logs.groupBy("run_id").agg(
        F.max("ts").alias("last_ts"),
        _last(_found(r"^=== .*end rc=(\d+)"), order).alias("exit_code"),
        _last(_found(r"rows_written=(\d+)"), order).alias("rows_written"),
        _last(_found(r"fare_rate=([0-9.]+)"), order).alias("fare_rate"),
        _last(_found(r"budget_hit=(True|False)"), order).alias("budget_hit"),
        _last(error, order).alias("last_error"),
        F.max(F.when(F.col("message").rlike(r"^=== .*end rc=[1-9]"), 1)).alias("_failed"),
    )


def recent_runs(logs: DataFrame, *, n: int = 5) -> DataFrame:
    """The last runs with what their logs say last about exit code, rows, rate and budget."""
    figures = _run_figures(logs).select("run_id", "last_ts", "exit_code", "rows_written", "fare_rate", "budget_hit")
    return figures.orderBy(F.desc("last_ts"), F.desc("run_id")).limit(n)


def failed_runs(logs: DataFrame, as_of: str | Column, *, days: int = 7) -> DataFrame:
    """Runs active in the last days that ended with a non-zero code, with their last error line."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    since = now - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = _run_figures(logs).where((F.col("last_ts") > since) & (F.col("last_ts") <= now) & (F.col("_failed") == 1))
    return recent.select("run_id", F.coalesce("last_error", F.lit("<no error message>")).alias("last_error"))


def freshness(df: DataFrame, ts: str, as_of: str | Column, *, stale_hours: int = STALE_HOURS) -> DataFrame:
    """Whole hours since the newest row, and whether that is too old."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    newest = df.agg(F.max(ts).alias("newest"))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("newest")) / 3600)
    return newest.select("newest", age.alias("age_hours"), (age > stale_hours).alias("stale"))


def rows_with_logs(rows: DataFrame, logs: DataFrame, *, run: str = "run_id") -> DataFrame:
    """Every data row beside the log figures of its run.

    Lines are reduced to one row per run first, so a long run never multiplies rows by lines.
    """
    per_run = logs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("log_lines"),
        count_if(F.col("level") == "ERROR").alias("error_lines"),
        F.max_by("message", F.struct("ts", "message")).alias("last_message"),
    )
    return rows.join(per_run.withColumnRenamed("run_id", run), run)
