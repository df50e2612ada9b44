"""Fare planning, normalisation, picks, validation and gates on hand-written cases."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfare.operators import fares, quality, routes
from gridfare.plans import fixtures
from gridfare.schemas import FARE_COLUMNS
from gridfare.sources.fares import append_fares_monthly, read_fares_all_months
from gridfare.sources.logs import read_run_logs

CODES = [f"A{chr(65 + i)}X" for i in range(15)]


def _universe(spark):
    return routes.route_universe(spark.createDataFrame([(c,) for c in [*CODES, CODES[0]]], "code string"))


# ---- planning ----


def test_universe_is_all_ordered_pairs(spark):
    rows = _universe(spark).orderBy("route_idx").collect()
    expected = [(a, b) for a in CODES for b in CODES if a != b]
    assert [(r["origin"], r["destination"]) for r in rows] == expected
    assert [r["route_idx"] for r in rows] == list(range(210))


def test_batches_and_slices_partition_the_universe(spark):
    universe = _universe(spark)
    seen = []
    for index in range(3):
        batch = routes.batch_of_routes(universe, index=index, batches=3)
        assert batch.count() == 70
        slices = [routes.slice_of_batch(batch, part=i, parts=8).count() for i in range(1, 9)]
        assert slices == [8] * 7 + [14]
        seen += [r["route_idx"] for r in batch.collect()]
    assert sorted(seen) == list(range(210))


def test_coverage_reports_windows_without_any_run(spark):
    ran = ["2025-12-30", "2025-12-31", "2026-01-01", "2026-01-05", "2026-01-06", "2026-01-07"]
    days = spark.createDataFrame([(d,) for d in ran], "day string").select(F.to_date("day").alias("day"))
    three = routes.route_universe(spark.createDataFrame([("AAA",), ("BBB",), ("CCC",)], "code string"))
    first = routes.rotation_index(days, "day").agg(F.min("cycle")).first()[0]
    found = routes.route_coverage(three, days)
    empty = {r["cycle"] for r in found.groupBy("cycle").agg(F.sum("times").alias("t"), F.count("*").alias("n")).where("t = 0 AND n = 6").collect()}
    assert empty == {first + 1}


def test_more_batches_than_routes_leaves_all_to_the_last(spark):
    few = routes.route_universe(spark.createDataFrame([("AAA",), ("BBB",)], "code string"))
    assert routes.batch_of_routes(few, index=0, batches=5).count() == 0
    assert routes.batch_of_routes(few, index=4, batches=5).count() == 2


@pytest.mark.parametrize("call", [{"index": 3, "batches": 3}, {"index": -1, "batches": 3}, {"index": 0, "batches": 0}])
def test_batch_arguments(spark, call):
    with pytest.raises(ValueError):
        routes.batch_of_routes(_universe(spark), **call)


def test_slice_arguments(spark):
    batch = routes.batch_of_routes(_universe(spark), index=0)
    for part, parts in ((0, 3), (4, 3), (1, 0)):
        with pytest.raises(ValueError):
            routes.slice_of_batch(batch, part=part, parts=parts)


def test_rotation(spark):
    days = [(dt.date(2000, 1, 1) + dt.timedelta(days=i),) for i in range(-1, 7)]
    rows = routes.rotation_index(spark.createDataFrame(days, "d date"), "d").orderBy("d").collect()
    assert [r["batch_index"] for r in rows] == [2, 0, 1, 2, 0, 1, 2, 0]
    assert [r["cycle"] for r in rows] == [-1, 0, 0, 0, 1, 1, 1, 2]


def test_full_rotation_covers_every_route_once(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(9)], "day date")
    start = (dt.date(2024, 1, 1) - dt.date(2000, 1, 1)).days % 3
    whole = days.where(F.col("day") >= dt.date(2024, 1, 1) + dt.timedelta(days=(3 - start) % 3))
    whole = whole.where(F.col("day") < dt.date(2024, 1, 1) + dt.timedelta(days=(3 - start) % 3 + 6))
    assert routes.route_coverage(_universe(spark), whole).count() == 0


def test_route_specs(spark):
    specs = [("BOM:DEL, del:bom ",), ("BOM",), (":DEL",), (" , ",)]
    rows = routes.parse_route_spec(spark.createDataFrame(specs, "spec string")).collect()
    good = [(r["origin"], r["destination"]) for r in rows if r["problem"] is None]
    assert good == [("BOM", "DEL"), ("DEL", "BOM")]
    assert {r["problem"] for r in rows} == {None, "expected ORIGIN:DEST", "empty side", "no routes"}


def test_explicit_lists_win_over_caps(spark):
    batch = routes.batch_of_routes(_universe(spark), index=0)
    tasks = routes.search_tasks(batch, F.lit("2026-06-18 21:00:00").cast("timestamp"))
    assert tasks.count() == 420
    assert routes.cap_tasks(tasks, max_routes=1, max_horizons=1).count() == 1
    chosen = routes.cap_tasks(tasks, max_routes=1, routes=[(CODES[0], CODES[3])], horizons=[30], max_horizons=1)
    assert [(r["origin"], r["destination"], r["days_out"]) for r in chosen.collect()] == [(CODES[0], CODES[3], 30)]


# ---- normalisation ----


@pytest.mark.parametrize(
    ("date", "time", "expected"),
    [
        ([2026, 6, 20], [17, 45], dt.datetime(2026, 6, 20, 17, 45)),
        ([2026, 6, 20], [17], dt.datetime(2026, 6, 20, 17)),
        ([2026, 6, 20], [9, None], dt.datetime(2026, 6, 20, 9)),
        ([2026, 6, 20], [None, 5], None),
        ([2026, 6, 20], [], None),
        ([2026, 6], [9, 0], None),
        ([2026, None, 20], [9, 0], None),
        ([2026, 2, 30], [9, 0], None),
        ([2026, 6, 20], [25, 0], None),
        (None, [9, 0], None),
        ([2026, 6, 20], None, None),
    ],
)
def test_partial_datetime(spark, date, time, expected):
    df = spark.createDataFrame([(date, time)], "d array<int>, t array<int>")
    assert df.select(fares.partial_datetime("d", "t")).first()[0] == expected


def _leg(**kw):
    leg = {"from_code": "BOM", "from_name": "", "to_code": "HYD", "to_name": "", "dep_date": [2026, 6, 20],
           "dep_time": [7, 0], "arr_date": [2026, 6, 20], "arr_time": [8, 25], "duration": 85, "plane_type": "A320"}
    return leg | kw


def _entry(price=7804, legs=None, carbon=(100000, 103000)):
    legs = [_leg(), _leg(from_code="HYD", to_code="DEL", dep_time=[9], arr_date=[2026, 6, 21], arr_time=[1, 5], duration=130)] if legs is None else legs
    return {"price": price, "type": "x", "airlines": ["IndiGo", "AI"], "legs": legs,
            "carbon": {"typical_on_route": carbon[0], "emission": carbon[1]}}


def _pages(spark, *bodies):
    return spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "search_id long, body string")


def test_itinerary_fields(spark):
    entries = fares.explode_pages(_pages(spark, {"entries": [_entry()]}))
    row = fares.normalise_itineraries(entries).first()
    assert (row["price"], row["stops"], row["airline"], row["aircraft"]) == (7804, 1, "IndiGo", "A320")
    assert (row["layover_city"], row["layover_duration_mins"], row["duration_mins"]) == ("HYD", 35, 215)
    assert (row["co2_delta_pct"], row["co2_kg"]) == (3, 103)
    assert row["arrival_dt"] == dt.datetime(2026, 6, 21, 1, 5)


@pytest.mark.parametrize(("price", "expected"), [(0, None), (-5, None), (7804.9, 7804), (None, None)])
def test_price(spark, price, expected):
    df = spark.createDataFrame([(price,)], "price double") if price is None or isinstance(price, float) else spark.createDataFrame([(price,)], "price long")
    assert fares.positive_price(df).first()["price"] == expected


def test_no_legs_and_no_minutes(spark):
    entries = fares.explode_pages(_pages(spark, {"entries": [_entry(legs=[]), _entry(legs=[_leg(duration=None)])]}))
    none, unknown = fares.normalise_itineraries(entries).orderBy("entry_pos").collect()
    assert (none["stops"], none["departure_dt"], none["duration_mins"], none["aircraft"]) == (0, None, None, "")
    assert (unknown["stops"], unknown["duration_mins"]) == (0, None)


def test_a_negative_layover_is_zero(spark):
    legs = [_leg(), _leg(dep_time=[8, 0])]
    row = fares.normalise_itineraries(fares.explode_pages(_pages(spark, {"entries": [_entry(legs=legs)]}))).first()
    assert row["layover_duration_mins"] == 0


def test_half_even_percent(spark):
    df = spark.createDataFrame([(100500, 100000), (102500, 100000), (97500, 100000), (1, 0), (None, 5)], "co2_g long, co2_typical_g long")
    rows = fares.co2_fields(df).collect()
    assert [r["co2_delta_pct"] for r in rows] == [0, 2, -2, None, None]
    assert [r["co2_kg"] for r in rows] == [100, 102, 98, 0, None]


def test_tolerant_pages(spark):
    pages = _pages(spark, {"entries": [_entry(), {"price": 3}]}, {"not_found": True}, {"entries": None}, {"entries": []})
    kept = fares.explode_pages(pages).collect()
    assert [(r["search_id"], r["price"]) for r in kept] == [(0, 7804)]
    counts = fares.page_counts(pages).orderBy("search_id").collect()
    assert [(r["kept"], r["skipped"]) for r in counts] == [(1, 1), (0, 0), (0, 0), (0, 0)]


def _without(record, name):
    return {k: v for k, v in record.items() if k != name}


def test_entries_that_lack_a_field_are_skipped(spark):
    """A null field is kept, a missing one is not, in the entry, in its carbon record and in every leg."""
    entry, leg = _entry(), _leg()
    lacking = [_without(entry, name) for name in entry] + [entry | {"carbon": _without(entry["carbon"], name)} for name in entry["carbon"]]
    lacking += [_entry(legs=[leg, _without(leg, name)]) for name in leg] + [_entry(legs=[{"from_code": "DEL"}]), _entry(legs=[None]), entry | {"legs": None}, entry | {"carbon": None}]
    nulls = [_entry(legs=[{name: None for name in leg}]), entry | {"carbon": dict.fromkeys(entry["carbon"])}, entry | {"price": None, "airlines": None}]
    pages = _pages(spark, {"entries": [entry, *lacking, *nulls]})
    assert sorted(r["entry_pos"] for r in fares.explode_pages(pages).collect()) == [0, *range(1 + len(lacking), 1 + len(lacking) + len(nulls))]
    row = fares.page_counts(pages).first()
    assert (row["kept"], row["skipped"]) == (1 + len(nulls), len(lacking))


# ---- picks ----


def test_picks_of_large_searches_equal_sorting(spark):
    """Many results in one block, equal prices, a block border at the middle, and searches of every small size."""
    random = np.random.default_rng(6)
    prices = {1: random.integers(1, 10**6, 3_000), 2: np.full(500, 77), 3: random.integers(10_000, 10_003, 901), 4: [5, 5, 9, 9], 5: [1, 2]}
    prices |= {10 + n: random.integers(1, 6, n) for n in range(1, 9)}
    rows = [(s, int(r), int(p)) for s, own in prices.items() for r, p in zip(random.permutation(len(own)), own)] + [(1, 10**6, None), (9, 0, None)]
    results = spark.createDataFrame(rows, "search_id long, rank long, price long").repartition(4)
    tasks = spark.createDataFrame([(s,) for s in [*prices, 9]], "search_id long")
    got = {(r["search_id"], r["flight_category"]): (r["rank"], r["price"], r["num_results"]) for r in fares.fare_categories(tasks, results).collect()}
    expected = {(9, "NoFlights"): (None, None, 0)}
    for search in prices:
        own = sorted((p, r) for s, r, p in rows if s == search and p is not None)
        expected[search, "Best"] = (*min((r, p) for p, r in own), len(own))
        expected[search, "Cheapest"] = (own[0][1], own[0][0], len(own))
        middle = own[len(own) // 2]
        if middle[0] != own[0][0]:
            expected[search, "Median"] = (middle[1], middle[0], len(own))
    assert got == expected
    medians = {(r["search_id"], "Median"): (r["rank"], r["price"]) for r in fares.pick_median(results).collect()}
    assert medians == {k: v[:2] for k, v in expected.items() if k[1] == "Median"}


def test_searches_in_blocks_equal_whole_ones(spark):
    """A search above the limit is ordered in price blocks, one below it in one window; both give the same rows (F10, F14)."""
    random = np.random.default_rng(7)
    rows = [(int(s), k, None if p == 3 else int(p)) for k, (s, p) in enumerate(zip(random.integers(0, 40, 900) // 7, random.integers(1, 60, 900)))]
    results = spark.createDataFrame([*rows, (None, 1, 5), (None, 2, 9)], "search_id long, rank long, price long").repartition(4)
    tasks = spark.createDataFrame([(s,) for s in range(8)], "search_id long")
    found = [sorted(fares.fare_categories(tasks, results, most=most).collect(), key=str) for most in (0, 160, 10**6)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 8
    medians = [sorted(fares.pick_median(results, most=most).collect(), key=str) for most in (1, 160, 10**6)]
    assert medians[0] == medians[1] == medians[2]


def test_legs_are_compiled_and_tasks_grow_with_the_table(spark, tmp_path):
    """Legs of a page entry are written out, and a larger table is dealt out to more tasks (F10, F13)."""
    line = "id AS l_orderkey, id * 3 AS l_partkey, id * 5 AS l_suppkey, CAST(id % 8 AS INT) AS l_linenumber, 5D AS l_quantity, 9.5D AS l_extendedprice, timestamp_ntz '2024-05-06 23:50:00' AS l_shipdate"
    spark.range(4000).selectExpr(line.split(", ")[0], *line.split(", ")[1:]).write.parquet(f"{tmp_path}/lineitem.parquet")
    legs = fixtures.entries(spark, str(tmp_path))
    plan = legs._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(named_struct" not in plan
    assert [r["n"] for r in legs.selectExpr("size(legs) AS n", "rank").orderBy("rank.l_partkey").take(8)] == [0, 1, 2, 3, 0, 1, 2, 3]
    assert fixtures.parts(spark, str(tmp_path), "lineitem", 100) == 40 and fixtures.parts(spark, str(tmp_path), "lineitem", 10**6) == 8


def _picked(spark, prices, **kw):
    tasks = spark.createDataFrame([(1,)], "search_id long")
    results = spark.createDataFrame([(1, i, p) for i, p in enumerate(prices)], "search_id long, rank long, price long")
    rows = fares.fare_categories(tasks, results, **kw).collect()
    return {r["flight_category"]: (r["price"], r["rank"], r["num_results"]) for r in rows}


@pytest.mark.parametrize(
    ("prices", "expected"),
    [
        ([7876, 9000, 11000], {"Best": (7876, 0, 3), "Cheapest": (7876, 0, 3), "Median": (9000, 1, 3)}),
        ([7876, 7876], {"Best": (7876, 0, 2), "Cheapest": (7876, 0, 2)}),
        ([None, 9000, 8000, 9000], {"Best": (9000, 1, 3), "Cheapest": (8000, 2, 3), "Median": (9000, 1, 3)}),
        ([5, 4, 3, 2], {"Best": (5, 0, 4), "Cheapest": (2, 3, 4), "Median": (4, 1, 4)}),
        ([None, None], {"NoFlights": (None, None, 0)}),
        ([], {"NoFlights": (None, None, 0)}),
    ],
)
def test_categories(spark, prices, expected):
    assert _picked(spark, prices) == expected


def test_zone_roll_over(spark):
    now = F.lit("2026-06-18 21:00:00").cast("timestamp")
    row = fares.booking_context(spark.range(1), now, F.lit(1)).first()
    assert row["Scrape_Timestamp"] == "2026-06-19 02:30:00"
    assert (row["Departure_Date"], row["Booking_Day_Of_Week"], row["Day_of_Week"]) == ("2026-06-20", "Friday", "Saturday")
    assert (row["Is_Weekend_Departure"], row["Run_Id"]) == (1, "20260618T210000Z")


def test_whole_rows_validate_and_round_trip(spark, tmp_path):
    pages = _pages(spark, {"entries": [_entry(7876), _entry(9000), _entry(11000)]}, {"entries": [_entry(69)]}, {"not_found": True})
    now = F.lit("2026-06-18 21:00:00").cast("timestamp")
    tasks = pages.select("search_id", F.lit("BOM").alias("origin"), F.lit("DEL").alias("destination"), F.lit(7).alias("days_out"), now.alias("now"))
    items = fares.normalise_itineraries(fares.explode_pages(pages)).withColumnRenamed("entry_pos", "rank")
    rows = fares.fare_rows(tasks, items)
    assert rows.columns == ["search_id", *FARE_COLUMNS]
    checked = quality.validate_fares(rows)
    assert {r["reject_reason"]: r["rows_dropped"] for r in quality.reject_summary(checked).collect()} == {"price_out_of_band": 2}
    outcomes = tasks.select("search_id", F.lit("r").alias("run_id"), F.lit("done").alias("outcome"))
    summary = quality.run_summary(outcomes, checked).first()
    assert (summary["attempted"], summary["with_fares"], summary["no_flights"], summary["rows_written"], summary["rows_dropped"]) == (3, 2, 1, 4, 2)
    assert summary["fare_rate"] == pytest.approx(2 / 3) and summary["valid_fare_rate"] == pytest.approx(1 / 3)

    path = str(tmp_path / "fares")
    append_fares_monthly(quality.valid_rows(checked), path, now)
    append_fares_monthly(quality.valid_rows(checked), path, F.lit("2026-07-01 00:00:00").cast("timestamp"))
    back = read_fares_all_months(spark, path)
    assert {r["year_month"] for r in back.select("year_month").distinct().collect()} == {"2026_06", "2026_07"}
    assert back.count() == 8
    empty = back.where("Flight_Category = 'NoFlights'").first()
    assert empty["Price_INR"] is None and empty["Airline"] is None and empty["Num_Results"] == 0
    first = next(p for p in (tmp_path / "fares" / "year_month=2026_06").iterdir() if p.suffix == ".csv")
    assert first.read_text().splitlines()[0] == ",".join(FARE_COLUMNS)


# ---- validation ----


def _fare(**kw):
    row = dict.fromkeys(FARE_COLUMNS) | {
        "Schema_Version": "4", "Source_City": "BOM", "Destination_City": "DEL", "Days_to_Departure": "7",
        "Departure_Date": "2026-06-05", "Flight_Category": "Best", "Data_Source": "fast-flights", "Price_INR": "7876",
    }
    return row | kw


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"Schema_Version": "3"}, "schema_version"),
        ({"Source_City": "bom"}, "route_not_iata"),
        ({"Source_City": None}, "route_not_iata"),
        ({"Destination_City": "BOM"}, "same_city"),
        ({"Days_to_Departure": "x"}, "days_not_int"),
        ({"Days_to_Departure": "7.0"}, "days_not_int"),
        ({"Days_to_Departure": " 7 "}, None),
        ({"Days_to_Departure": "-1"}, "days_negative"),
        ({"Departure_Date": "2026-6-5"}, None),
        ({"Departure_Date": "2026-02-30"}, "departure_date"),
        ({"Departure_Date": "05/06/2026"}, "departure_date"),
        ({"Flight_Category": "Other"}, "category"),
        ({"Data_Source": "web"}, "data_source"),
        ({"Price_INR": ""}, "price_empty"),
        ({"Price_INR": None}, "price_empty"),
        ({"Price_INR": "abc"}, "price_not_numeric"),
        ({"Price_INR": "NaN"}, "price_out_of_band"),
        ({"Price_INR": "69"}, "price_out_of_band"),
        ({"Price_INR": "999"}, "price_out_of_band"),
        ({"Price_INR": "1000"}, None),
        ({"Price_INR": "200000"}, None),
        ({"Price_INR": "200001"}, "price_out_of_band"),
        ({"Flight_Category": "NoFlights"}, "price_on_no_flights"),
        ({"Flight_Category": "NoFlights", "Price_INR": " "}, None),
        ({"Flight_Category": "Other", "Data_Source": "web"}, "category"),
    ],
)
def test_rules(spark, change, reason):
    row = _fare(**change)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    assert quality.validate_fares(df).first()["reject_reason"] == reason


def test_missing_header_rejects_all(spark):
    row = _fare()
    del row["Run_Id"]
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    assert quality.validate_fares(df).first()["reject_reason"] == "missing_fields"


def test_typed_days_are_truncated(spark):
    row = _fare()
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    assert quality.validate_fares(df.withColumn("Days_to_Departure", F.lit(7.9))).first()["reject_reason"] is None


# ---- gates ----


def _summary(spark, *rows):
    return spark.createDataFrame(rows, "run_id string, attempted long, rows_written long, fare_rate double")


def test_gate(spark):
    runs = _summary(spark, ("a", 10, 9, 0.7), ("b", 0, 0, 0.0), ("c", 10, 0, 0.1), ("d", 10, 3, 0.1))
    assert {r["run_id"]: r["passed"] for r in quality.quality_gate(runs, min_rate=0.6).collect()} == {
        "a": True, "b": False, "c": False, "d": False,
    }
    assert not quality.quality_gate(runs.where("run_id = 'a'"), min_rate=0.8).first()["passed"]
    kept = {r["run_id"]: (r["decision"], r["exit_code"]) for r in quality.publish_decision(runs).collect()}
    assert kept == {"a": ("publish", 0), "b": ("reject", 3), "c": ("reject", 3), "d": ("publish_degraded", 0)}
    strict = quality.publish_decision(runs.where("run_id = 'd'"), keep_below_gate=False).first()
    assert (strict["decision"], strict["exit_code"]) == ("reject", 3)


def test_attempts(spark):
    log = [("a", 1, "timeout"), ("a", 2, "ok"), ("b", 1, "empty"), ("b", 2, "error"), ("c", 1, "error"), ("c", 2, "empty")]
    df = spark.createDataFrame(log, "k string, attempt int, status string")
    assert {r["k"]: r["outcome"] for r in quality.attempt_outcome(df, ["k"]).collect()} == {
        "a": "fares", "b": "error", "c": "empty",
    }


def test_log_lines(spark, tmp_path):
    (tmp_path / "run.log").write_text(
        "[2026-06-18T03:00:00.123Z] [INFO ] [pipeline    ] [run=20260618T030000Z] rows_written=12 fare_rate=71.5\n"
        "noise\n"
        "[2026-06-18T03:01:00.000Z] [ERROR] [cli         ] [run=20260618T030000Z] search FAILED\n"
        "[2026-06-18T03:02:00.000Z] [INFO ] [cron        ] [run=20260618T030000Z] === cron_run.sh end rc=3\n"
    )
    logs = read_run_logs(spark, str(tmp_path))
    assert logs.count() == 3
    run = quality.recent_runs(logs).first()
    assert (run["exit_code"], run["rows_written"], run["fare_rate"], run["budget_hit"]) == ("3", "12", "71.5", None)
    assert quality.failed_runs(logs, "2026-06-20 00:00:00").first()["last_error"] == "search FAILED"
    assert quality.failed_runs(logs, "2026-07-20 00:00:00").count() == 0
    age = quality.freshness(logs, "ts", "2026-06-20 03:02:00").first()
    assert (age["age_hours"], age["stale"]) == (48, True)


def test_legacy_months_are_not_split_by_task(spark, tmp_path, monkeypatch):
    """A month of few rows is one file, however many tasks have rows of it."""
    from gridfare.plans import catalog, fare_queries

    lines = spark.range(1200).selectExpr(
        "id AS l_orderkey", "id * 11 AS l_partkey", "id AS l_suppkey", "1L AS l_linenumber", "2.0D AS l_quantity", "900.0D AS l_extendedprice",
        "0.0D AS l_discount", "'R' AS l_returnflag", "date_add(DATE'2020-01-01', CAST(id % 60 AS INT)) AS l_shipdate",
    )
    lines.write.parquet(f"{tmp_path}/in/lineitem.parquet")
    monkeypatch.setattr(fare_queries, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = catalog.QUERIES["read_fares_all_months"](spark, f"{tmp_path}/in")
        months = {row["Scrape_Timestamp"][:7] for row in rows.where("Schema_Version = 3").select("Scrape_Timestamp").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(list((tmp_path / "fares-v3").rglob("*.csv"))) == len(months) > 1
