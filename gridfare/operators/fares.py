"""Itinerary normalisation and the Best / Cheapest / Median / NoFlights rows of a search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from gridfare.functions.columns import col, flag, half_even
from gridfare.functions.ranking import running_sums
from gridfare.schemas import (
    CABIN,
    CURRENCY,
    DISPLAY_ZONE,
    ENTRY_SCHEMA,
    FARE_COLUMNS,
    FARE_SCHEMA,
    LEG_SCHEMA,
    SCHEMA_VERSION,
    SOURCE,
)

#: Priced results of a search that are ordered in one task.
SEARCH_ROWS = 1 << 16

# ---- result pages ----


def _has_all(names: Column, schema: StructType) -> Column:
    return F.size(F.array_intersect(names, F.array(*[F.lit(f) for f in schema.fieldNames()]))) == len(schema.fieldNames())


def _read_entries(body: str) -> Column:
    """Readable entries of a page as (entry_pos, e).

    An entry needs all of its fields, and so do its carbon record and every leg; any of them may be null, but for the legs and
    the carbon record themselves. A null price is an unpriced result. Fields that are there are told from those that are null by
    the names in the text.
    """

    def parse(raw: Column, pos: Column) -> Column:
        return F.struct(
            pos.alias("entry_pos"),
            F.from_json(raw, ENTRY_SCHEMA).alias("e"),
            F.json_object_keys(raw).alias("names"),
            F.from_json(raw, "legs array<string>, carbon string").alias("parts"),
        )

    def readable(item: Column) -> Column:
        whole = item["e"]["legs"].isNotNull() & item["e"]["carbon"].isNotNull() & _has_all(item["names"], ENTRY_SCHEMA)
        carbon = _has_all(F.json_object_keys(item["parts"]["carbon"]), ENTRY_SCHEMA["carbon"].dataType)
        legs = F.forall(item["parts"]["legs"], lambda leg: F.coalesce(_has_all(F.json_object_keys(leg), LEG_SCHEMA), F.lit(False)))
        return F.coalesce(whole & carbon & legs, F.lit(False))

    found = F.filter(F.transform(body, parse), readable)
    return F.transform(found, lambda item: F.struct(item["entry_pos"].alias("entry_pos"), item["e"].alias("e")))


def _page_entries(pages: DataFrame, body: str) -> DataFrame:
    parsed = F.from_json(F.col(body), "not_found boolean, entries array<string>")
    entries = F.when(F.coalesce(parsed["not_found"], F.lit(False)), None).otherwise(parsed["entries"])
    kept = [c for c in pages.columns if c != body]
    return pages.select(*kept, F.coalesce(entries, F.array().cast("array<string>")).alias("_entries"))


def explode_pages(pages: DataFrame, *, body: str = "body") -> DataFrame:
    """One row per readable itinerary; a bad entry is skipped and the rest of its page kept."""
    listed = _page_entries(pages, body)
    kept = [c for c in listed.columns if c != "_entries"]
    rows = listed.select(*kept, F.inline(_read_entries("_entries")))
    return rows.select(*kept, "entry_pos", "e.*")


def page_counts(pages: DataFrame, *, body: str = "body") -> DataFrame:
    """Entries kept and skipped on each page; a not-found page and a null list count as empty."""
    listed = _page_entries(pages, body)
    kept = [c for c in listed.columns if c != "_entries"]
    counted = listed.select(*kept, F.size("_entries").alias("_n"), F.size(_read_entries("_entries")).alias("_k"))
    return counted.select(*kept, F.col("_k").cast("long").alias("kept"), (F.col("_n") - F.col("_k")).cast("long").alias("skipped"))


# ---- fields of one itinerary ----


def partial_datetime(date: str | Column, time: str | Column) -> Column:
    """Local clock time from ``[y, m, d]`` and ``[h, m]``.

    The date must be whole and the hour known; a missing minute is 0; anything impossible is null.
    """
    date, time = col(date), col(time)
    minute = F.coalesce(F.get(time, F.lit(1)), F.lit(0))
    parts = [F.get(date, F.lit(i)) for i in range(3)] + [F.get(time, F.lit(0)), minute]
    return F.try_make_timestamp_ntz(*parts, F.lit(0).cast("decimal(8,6)"))


def positive_price(df: DataFrame, *, price: str = "price") -> DataFrame:
    """Price truncated to an integer, kept only when it is above zero."""
    return df.withColumn(price, F.when(F.col(price) > 0, F.col(price).cast("long")))


def stops_and_legs(df: DataFrame, *, legs: str = "legs", airlines: str = "airlines") -> DataFrame:
    """Stops, first departure, last arrival, first aircraft and primary airline."""
    count = F.coalesce(F.when(F.size(legs) >= 0, F.size(legs)), F.lit(0))
    first, last = F.try_element_at(legs, F.lit(1)), F.try_element_at(legs, F.lit(-1))
    return df.withColumns(
        {
            "stops": F.greatest(count - 1, F.lit(0)).cast("long"),
            "departure_dt": partial_datetime(first["dep_date"], first["dep_time"]),
            "arrival_dt": partial_datetime(last["arr_date"], last["arr_time"]),
            "aircraft": F.coalesce(first["plane_type"], F.lit("")),
            "airline": F.coalesce(F.try_element_at(airlines, F.lit(1)), F.lit("")),
        }
    )


def first_layover(df: DataFrame, *, legs: str = "legs") -> DataFrame:
    """Connecting airport after leg one and the minutes there, never negative, null when unknown."""
    one, two = F.try_element_at(legs, F.lit(1)), F.try_element_at(legs, F.lit(2))
    arrive = partial_datetime(one["arr_date"], one["arr_time"])
    leave = partial_datetime(two["dep_date"], two["dep_time"])
    wait = F.timestamp_diff("MINUTE", arrive, leave)
    connected = F.size(legs) >= 2
    return df.withColumns(
        {
            "layover_city": F.when(connected, F.coalesce(one["to_code"], F.lit(""))).otherwise(""),
            "layover_duration_mins": F.when(connected & wait.isNotNull(), F.greatest(wait, F.lit(0)).cast("long")),
        }
    )


def leg_duration(df: DataFrame, *, legs: str = "legs") -> DataFrame:
    """Sum of leg minutes; null when there are no minutes at all."""
    minutes = F.transform(legs, lambda leg: F.coalesce(leg["duration"], F.lit(0)).cast("long"))
    summed = F.aggregate(minutes, F.lit(0).cast("long"), lambda a, b: a + b)
    known = F.exists(minutes, lambda m: m != 0)
    return df.withColumn("duration_mins", F.when(known, summed))


def co2_fields(df: DataFrame, *, emission: str = "co2_g", typical: str = "co2_typical_g") -> DataFrame:
    """Percent difference from the typical emission and kilograms, both rounded half to even."""
    grams, usual = F.col(emission), F.col(typical)
    return df.withColumns(
        {
            "co2_delta_pct": F.when(usual != 0, half_even((grams - usual) / usual * 100)),
            "co2_kg": half_even(grams / 1000),
        }
    )


def normalise_itineraries(entries: DataFrame) -> DataFrame:
    """Exploded page entries to flat itineraries."""
    carbon = entries.withColumns({"co2_g": F.col("carbon.emission"), "co2_typical_g": F.col("carbon.typical_on_route")})
    flat = co2_fields(leg_duration(first_layover(stops_and_legs(positive_price(carbon)))))
    return flat.withColumns({"flight_number": F.lit(""), "self_transfer": F.lit(False)}).drop("legs", "carbon")


# ---- context of one search ----


def run_id(now: str | Column) -> Column:
    """UTC stamp ``yyyyMMddTHHmmssZ``; the session time zone must be UTC."""
    return F.date_format(col(now), "yyyyMMdd'T'HHmmss'Z'")


def booking_context(
    df: DataFrame,
    now: str | Column,
    days_out: str | Column,
    *,
    zone: str = DISPLAY_ZONE,
    currency: str = CURRENCY,
    cabin: str = CABIN,
) -> DataFrame:
    """Local scrape time, departure date, weekday names, weekend flag and the run's constants."""
    local = F.from_utc_timestamp(col(now), zone)
    leaves = F.date_add(F.to_date(local), col(days_out).cast("int"))
    return df.withColumns(
        {
            "Schema_Version": F.lit(SCHEMA_VERSION).cast("long"),
            "Scrape_Timestamp": F.date_format(local, "yyyy-MM-dd HH:mm:ss"),
            "Days_to_Departure": col(days_out).cast("long"),
            "Departure_Date": F.date_format(leaves, "yyyy-MM-dd"),
            "Day_of_Week": F.date_format(leaves, "EEEE"),
            "Booking_Day_Of_Week": F.date_format(local, "EEEE"),
            "Is_Weekend_Departure": flag(F.weekday(leaves) >= 5),
            "Currency": F.lit(currency),
            "Cabin_Class": F.lit(cabin),
            "Run_Id": run_id(now),
        }
    )


def clock_fields(df: DataFrame, moment: str | Column, *, prefix: str) -> DataFrame:
    """``h:mm AM`` without a leading zero, ISO text and hour of a clock time."""
    at = col(moment)
    return df.withColumns(
        {
            f"{prefix}_Time": F.date_format(at, "h:mm a"),
            f"{prefix}_ISO": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"),
            f"{prefix}_Hour": F.hour(at).cast("long"),
        }
    )


def overnight_flag(departs: str | Column, arrives: str | Column) -> Column:
    """1 when arrival falls on a later date, 0 otherwise or when either is missing."""
    return flag(F.to_date(col(arrives)) > F.to_date(col(departs)))


# ---- picks ----


def num_results(tasks: DataFrame, results: DataFrame, *, search: str = "search_id") -> DataFrame:
    """Priced results of each search, 0 for a search with none."""
    priced = results.groupBy(search).agg(F.count("price").alias("num_results"))
    return tasks.join(priced, search, "left").fillna(0, ["num_results"])


def _payload(df: DataFrame, search: str) -> list[str]:
    return [c for c in df.columns if c != search]


def pick_best(results: DataFrame, *, search: str = "search_id", rank: str = "rank") -> DataFrame:
    """The first priced result; an aggregate, so it combines before the shuffle."""
    row = F.struct(*_payload(results, search))
    picked = results.where("price is not null").groupBy(search).agg(F.min_by(row, F.col(rank)).alias("_p"))
    return picked.select(search, "_p.*")


def pick_cheapest(results: DataFrame, *, search: str = "search_id", rank: str = "rank") -> DataFrame:
    """The lowest price, earliest result on ties."""
    row = F.struct(*_payload(results, search))
    picked = results.where("price is not null").groupBy(search).agg(
        F.min_by(row, F.struct(F.col("price"), F.col(rank))).alias("_p")
    )
    return picked.select(search, "_p.*")


def _ranked(results: DataFrame, search: str, rank: str, most: int) -> DataFrame:
    """Priced results with their place by price, and the figures of their search.

    A search of at most ``most`` priced results is ordered as a whole, a larger one in price blocks that spread over tasks. The large
    ones are as many as the rows divided by ``most`` at the utmost, and without any their part does not run.
    """
    priced = results.where("price is not null")
    large = F.broadcast(priced.groupBy(search).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(search))
    whole = Window.partitionBy(search)
    small = priced.join(large, search, "left_anti").withColumns(
        {
            "_pos": F.row_number().over(whole.orderBy("price", rank)).cast("long"),
            "num_results": F.count(F.lit(1)).over(whole),
            "_first": F.min(rank).over(whole),
            "_low": F.min("price").over(whole),
        }
    )
    stats = {"num_results": ("sum", F.lit(1)), "_first": ("min", F.col(rank)), "_low": ("min", F.col("price"))}
    spread = priced.join(large, search, "left_semi")
    return small.unionByName(running_sums(spread, [search], ["price", rank], {"_pos": F.lit(1).cast("long")}, stats=stats))


def _is_median() -> Column:
    return (F.col("_pos") == F.floor(F.col("num_results") / 2) + 1) & (F.col("price") != F.col("_low"))


def pick_median(
    results: DataFrame, *, search: str = "search_id", rank: str = "rank", most: int = SEARCH_ROWS
) -> DataFrame:
    """The middle of the stable price order (upper middle when even), unless it costs the same as the cheapest."""
    return _ranked(results, search, rank, most).where(_is_median()).select(*results.columns)


def fare_categories(
    tasks: DataFrame,
    results: DataFrame,
    *,
    search: str = "search_id",
    rank: str = "rank",
    most: int = SEARCH_ROWS,
) -> DataFrame:
    """Best, Cheapest and Median rows of every search, or its NoFlights row.

    A search of more than ``most`` priced results is ordered inside price blocks, so that a search of any size spreads over tasks;
    a result that serves several categories is exploded, not read again.
    """
    names = F.array_compact(
        F.array(
            F.when(F.col(rank) == F.col("_first"), "Best"),
            F.when(F.col("_pos") == 1, "Cheapest"),
            F.when(_is_median(), "Median"),
        )
    )
    chosen = _ranked(results, search, rank, most).withColumn("flight_category", F.explode(names))
    chosen = chosen.drop("_pos", "_first", "_low")
    return tasks.join(chosen, search, "left").fillna({"flight_category": "NoFlights", "num_results": 0})


def fare_rows(tasks: DataFrame, itineraries: DataFrame, *, now: str = "now", keep: Sequence[str] = ()) -> DataFrame:
    """Tasks and their itineraries to full version-4 rows, in file order; ``keep`` names columns of the tasks to carry along.

    ``tasks``: search_id, origin, destination, days_out and the scrape time. ``itineraries``: search_id, rank and
    the columns of :func:`normalise_itineraries`.
    """
    picked = fare_categories(tasks, itineraries)
    dressed = clock_fields(clock_fields(picked, "departure_dt", prefix="Departure"), "arrival_dt", prefix="Arrival")
    dressed = booking_context(dressed, now, "days_out")
    priced = F.col("flight_category") != "NoFlights"
    named = dressed.withColumns(
        {
            "Is_Overnight": overnight_flag("departure_dt", "arrival_dt"),
            "Source_City": F.col("origin"),
            "Destination_City": F.col("destination"),
            "Airline": F.nullif("airline", F.lit("")),
            "Flight_Number": F.nullif("flight_number", F.lit("")),
            "Aircraft": F.nullif("aircraft", F.lit("")),
            "Total_Duration_Mins": F.col("duration_mins"),
            "Number_of_Stops": F.col("stops"),
            "Layover_City": F.nullif("layover_city", F.lit("")),
            "Layover_Duration_Mins": F.col("layover_duration_mins"),
            "Self_Transfer": F.when(priced, flag(F.col("self_transfer"))),
            "CO2_Emissions_Kg": F.col("co2_kg"),
            "CO2_Delta_Pct": F.col("co2_delta_pct"),
            "Num_Results": F.col("num_results"),
            "Data_Source": F.lit(SOURCE),
            "Flight_Category": F.col("flight_category"),
            "Price_INR": F.col("price"),
            "Carbon_Typical_g": F.col("co2_typical_g"),
        }
    )
    return named.select("search_id", *keep, *[F.col(c).cast(FARE_SCHEMA[c].dataType).alias(c) for c in FARE_COLUMNS])
