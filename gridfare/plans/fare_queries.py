"""Fare planning, normalisation, validation and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfare.functions.columns import r6
from gridfare.operators import fares as fare
from gridfare.operators import quality, routes
from gridfare.plans import fixtures as fx
from gridfare.plans.registry import query, sql_r6
from gridfare.schemas import FARE_COLUMNS_V3
from gridfare.session import scratch_path
from gridfare.sources.fares import append_fares_monthly, read_fares, read_fares_all_months
from gridfare.sources.logs import read_run_logs

# ---- oracle views ----


def _code(n: str) -> str:
    return f"('NA' || chr((65 + {n} % 25)::INT))"


def _horizon(n: str) -> str:
    return f"([1, 3, 7, 14, 30, 60])[({n} % 6 + 1)::INT]"


AIRPORTS = f"airports AS (SELECT {_code('n_nationkey')} AS code FROM nation)"
ROUTES = f"""{AIRPORTS}, universe AS (
  SELECT a.code AS origin, b.code AS destination,
         row_number() OVER (ORDER BY a.code, b.code) - 1 AS route_idx, count(*) OVER () AS n_routes
  FROM (SELECT DISTINCT code FROM airports) a, (SELECT DISTINCT code FROM airports) b WHERE a.code <> b.code),
routes AS (SELECT *, least(route_idx // (n_routes // 3), 2) AS batch FROM universe)"""
TASKS = f"""tasks AS (
  SELECT o_orderkey AS search_id, {_code('o_custkey')} AS origin,
         {_code('(o_custkey % 25 + 1 + o_orderkey % 24)')} AS destination, {_horizon('o_orderkey')} AS days_out,
         o_orderdate::TIMESTAMP + to_seconds(o_orderkey * 37 % 86400) AS now,
         strftime(o_orderdate, '%Y-%m') AS run_id,
         CASE o_orderstatus WHEN 'P' THEN 'error' ELSE 'done' END AS outcome FROM orders)"""
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
RESULTS = f"""results AS (
  SELECT l_orderkey AS search_id, l_partkey AS part, l_suppkey AS supplier,
         CASE WHEN l_quantity = 1 THEN NULL ELSE floor(l_extendedprice)::BIGINT END AS price,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rk FROM lineitem),
priced AS (SELECT *, count(*) OVER s AS n, row_number() OVER (s ORDER BY rk) AS by_rank,
         row_number() OVER (s ORDER BY price, rk) AS by_price, min(price) OVER s AS low
  FROM results WHERE price IS NOT NULL WINDOW s AS (PARTITION BY search_id)),
picks AS (
  SELECT *, 'Best' AS flight_category FROM priced WHERE by_rank = 1
  UNION ALL SELECT *, 'Cheapest' FROM priced WHERE by_price = 1
  UNION ALL SELECT *, 'Median' FROM priced WHERE by_price = n // 2 + 1 AND price <> low)"""


def _leg_at(i: str, which: str, shift: int) -> tuple[str, str]:
    minute = f"(({i} - 1) * 300 + l_partkey % 360)"
    if which == "arr":
        minute = f"({minute} + (l_partkey * 7 + {i} * 45) % 400)"
    at = f"(l_shipdate::TIMESTAMP + to_minutes({minute}))"
    known = (
        f"CASE WHEN (l_partkey + {i} + {shift}) % 17 = 0 OR (l_partkey + {i} + {shift}) % 29 = 0 THEN NULL "
        f"WHEN (l_suppkey + {i} + {shift}) % 7 = 0 THEN date_trunc('hour', {at}) ELSE {at} END"
    )
    return at, known


_LEGS = "(l_linenumber % 4)"
_DURATION = "(CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE {0} END)"
_MINUTES = " + ".join(f"CASE WHEN {_LEGS} >= {i} THEN (l_partkey * 7 + {i} * 45) % 400 ELSE 0 END" for i in (1, 2, 3))
ITINERARIES = f"""itineraries AS (
  SELECT l_orderkey AS search_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rk,
    l_partkey AS part, l_suppkey AS supplier, l_linenumber AS line,
    CASE WHEN l_quantity IN (1, 3) THEN NULL ELSE trunc(l_extendedprice)::BIGINT END AS price,
    greatest({_LEGS} - 1, 0)::BIGINT AS stops,
    CASE WHEN {_LEGS} >= 1 THEN {_leg_at('1', 'dep', 0)[1]} END AS departure_dt,
    CASE {_LEGS} WHEN 1 THEN {_leg_at('1', 'arr', 5)[1]} WHEN 2 THEN {_leg_at('2', 'arr', 5)[1]}
      WHEN 3 THEN {_leg_at('3', 'arr', 5)[1]} END AS arrival_dt,
    CASE WHEN {_LEGS} >= 1 THEN 'A' || (l_partkey % 5 + 318) ELSE '' END AS aircraft,
    CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'AL' || (l_suppkey % 7) END AS airline,
    CASE WHEN {_LEGS} >= 2 THEN {_code('(l_suppkey + 2)')} ELSE '' END AS layover_city,
    CASE WHEN {_LEGS} >= 2 THEN greatest(floor(date_diff('second', {_leg_at('1', 'arr', 5)[1]},
      {_leg_at('2', 'dep', 0)[1]}) / 60)::BIGINT, CASE WHEN {_leg_at('1', 'arr', 5)[1]} IS NOT NULL
      AND {_leg_at('2', 'dep', 0)[1]} IS NOT NULL THEN 0 END) END AS layover_duration_mins,
    nullif({_DURATION.format(f'({_MINUTES})')}, 0)::BIGINT AS duration_mins,
    CASE WHEN l_quantity = 2 THEN NULL ELSE l_partkey * 37 % 200000 END AS co2_g,
    CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 10 = 0 THEN 0
      ELSE 50000 + l_suppkey * 500 END AS co2_typical_g
  FROM lineitem)"""
CO2 = """(CASE WHEN co2_typical_g <> 0 THEN round_even((co2_g - co2_typical_g) / co2_typical_g * 100, 0) END)::BIGINT"""
FARES = f"""fares AS (
  SELECT CASE WHEN l_partkey % 11 = 0 THEN 3 ELSE 4 END::BIGINT AS version,
    strftime(l_shipdate::TIMESTAMP + to_seconds(l_orderkey * 37 % 86400), '%Y-%m-%d %H:%M:%S') AS scraped,
    CASE l_orderkey % 19 WHEN 0 THEN 'x' WHEN 1 THEN '-1' ELSE ({_horizon('l_orderkey')})::VARCHAR END AS days,
    l_linenumber = 6 AND l_partkey % 3 = 0 AS bad_date, dayname(l_shipdate) AS dow,
    dayname(l_shipdate - to_days((l_orderkey % 6)::INT)) AS booking_dow,
    CASE WHEN l_suppkey % 17 = 0 THEN 'nab' ELSE {_code('l_suppkey')} END AS src, {_code('l_partkey')} AS dst,
    CASE l_linenumber WHEN 1 THEN 'Best' WHEN 2 THEN 'Cheapest' WHEN 3 THEN 'Median' WHEN 4 THEN 'NoFlights'
      WHEN 5 THEN 'Best' WHEN 6 THEN 'Cheapest' ELSE 'Other' END AS cat,
    CASE WHEN l_suppkey % 23 = 0 THEN 'unknown' WHEN l_returnflag = 'R' THEN 'fast-flights'
      WHEN l_returnflag = 'A' THEN 'fli' ELSE 'playwright' END AS source,
    CASE WHEN l_quantity = 1 OR (l_linenumber = 4 AND l_quantity > 10) THEN NULL
      ELSE floor(l_extendedprice)::BIGINT * CASE WHEN l_discount = 0.05 THEN 3 ELSE 1 END END AS price,
    strftime(l_shipdate, '%Y-%m-%d') AS run_id
  FROM lineitem)"""
VALIDATED = f"""{FARES}, validated AS (
  SELECT *, CASE WHEN version <> 4 THEN 'schema_version'
    WHEN NOT regexp_full_match(src, '[A-Z]{{3}}') OR NOT regexp_full_match(dst, '[A-Z]{{3}}') THEN 'route_not_iata'
    WHEN src = dst THEN 'same_city' WHEN try_cast(days AS BIGINT) IS NULL THEN 'days_not_int'
    WHEN days::BIGINT < 0 THEN 'days_negative' WHEN bad_date THEN 'departure_date'
    WHEN cat NOT IN ('Best', 'Cheapest', 'Median', 'NoFlights') THEN 'category'
    WHEN source NOT IN ('fast-flights', 'fli', 'playwright') THEN 'data_source'
    WHEN cat <> 'NoFlights' AND price IS NULL THEN 'price_empty'
    WHEN cat <> 'NoFlights' AND (price < 1000 OR price > 200000) THEN 'price_out_of_band'
    WHEN cat = 'NoFlights' AND price IS NOT NULL THEN 'price_on_no_flights' END AS reason FROM fares)"""
LOGS = """logs AS (
  SELECT date_trunc('millisecond', ts) AS ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
    strftime(ts, '%Y%m%d') || 'T' || lpad((hour(ts) // 3 * 3)::VARCHAR, 2, '0') || '0000Z' AS run_id,
    event_type, user_id, event_id, value,
    CASE event_type WHEN 'error' THEN 'search FAILED for ' || user_id
      WHEN 'purchase' THEN '=== cron_slice.sh end rc=' || (user_id % 3)
      WHEN 'view' THEN 'fare_rate=' || value::DECIMAL(10, 2) WHEN 'click' THEN 'rows_written=' || (event_id % 500)
      ELSE 'budget_hit=' || CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END END AS message FROM events)"""
_RATES = f"{sql_r6('with_fares / attempted')} AS fare_rate"


# ---- planning ----


def _routes(spark, sf):
    return routes.route_universe(fx.airports(spark, sf))


query("route_universe", f"WITH {ROUTES} SELECT origin, destination, route_idx, n_routes FROM universe")(_routes)


@query(
    "batch_of_routes",
    f"WITH {ROUTES} SELECT origin, destination, route_idx, batch FROM routes WHERE batch = 1",
)
def _batch(spark, sf):
    batch = routes.batch_of_routes(_routes(spark, sf), index=1)
    return batch.select("origin", "destination", "route_idx", "batch")


@query(
    "slice_of_batch",
    f"""WITH {ROUTES}, b AS (SELECT *, row_number() OVER (ORDER BY route_idx) - 1 AS pos, count(*) OVER () AS n
      FROM routes WHERE batch = 2)
    SELECT origin, destination, least(pos // (n // 7), 6) + 1 AS slice, pos - (n // 7) * 6 AS slice_pos
    FROM b WHERE least(pos // (n // 7), 6) = 6""",
)
def _slice(spark, sf):
    cut = routes.slice_of_batch(routes.batch_of_routes(_routes(spark, sf), index=2), part=7, parts=7)
    return cut.select("origin", "destination", "slice", "slice_pos")


@query(
    "rotation_index",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n,
      ((date_diff('day', DATE '2000-01-01', o_orderdate::DATE) % 3 + 3) % 3)::BIGINT AS batch_index,
      floor(date_diff('day', DATE '2000-01-01', o_orderdate::DATE) / 3)::BIGINT AS cycle
    FROM orders GROUP BY 1, 3, 4""",
)
def _rotation(spark, sf):
    days = fx.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    turned = routes.rotation_index(days, "d")
    return turned.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "n", "batch_index", "cycle")


def _task_plan(spark, sf):
    """Each day's batch of routes, with that day's first event as the scrape time."""
    days = fx.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("now"))
    runs = routes.rotation_index(days, "day").withColumnRenamed("batch_index", "batch")
    batched = routes.assign_batches(_routes(spark, sf)).join(runs, "batch")
    return routes.search_tasks(batched, "now")


_PLAN = f"""{ROUTES}, runs AS (
  SELECT ts::DATE AS day, min(ts) AS now, date_diff('day', DATE '2000-01-01', ts::DATE) % 3 AS batch
  FROM events GROUP BY 1, 3),
plan AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY route_idx) - 1 AS route_pos
  FROM routes JOIN runs USING (batch)),
planned AS (SELECT *, strftime((now + INTERVAL 330 MINUTE)::DATE + days_out::INT, '%Y-%m-%d') AS target_date
  FROM plan, (VALUES (0, 1), (1, 3), (2, 7), (3, 14), (4, 30), (5, 60)) h(horizon_pos, days_out))"""


@query(
    "search_tasks",
    f"""WITH {_PLAN} SELECT strftime(day, '%Y-%m-%d') AS day, origin, destination, days_out::BIGINT AS days_out,
    target_date FROM planned""",
)
def _search_tasks(spark, sf):
    return _task_plan(spark, sf).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        "origin",
        "destination",
        F.col("days_out").cast("long").alias("days_out"),
        F.date_format("target_date", "yyyy-MM-dd").alias("target_date"),
    )


@query(
    "cap_tasks",
    f"""WITH {_PLAN} SELECT strftime(day, '%Y-%m-%d') AS day, origin, destination, days_out::BIGINT AS days_out
    FROM planned WHERE route_pos < 10 AND days_out IN (3, 14)""",
)
def _cap_tasks(spark, sf):
    capped = routes.cap_tasks(_task_plan(spark, sf), max_routes=10, max_horizons=4, horizons=[3, 14])
    return capped.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "origin", "destination", F.col("days_out").cast("long")
    )


@query(
    "parse_route_spec",
    """WITH r AS (SELECT c_custkey, 'na' || chr((97 + c_nationkey)::INT) AS a, 'ZZ' || chr((65 + c_custkey % 26)::INT) AS b
      FROM customer)
    SELECT c_custkey, 0::BIGINT AS part_pos, upper(a) AS origin, b AS destination, NULL AS problem FROM r
      WHERE c_custkey % 5 < 3
    UNION ALL SELECT c_custkey, 1, b, upper(a), NULL FROM r WHERE c_custkey % 5 = 1
    UNION ALL SELECT c_custkey, 1, NULL, NULL, 'expected ORIGIN:DEST' FROM r WHERE c_custkey % 5 = 2
    UNION ALL SELECT c_custkey, 0, NULL, NULL, 'empty side' FROM r WHERE c_custkey % 5 = 3
    UNION ALL SELECT c_custkey, NULL, NULL, NULL, 'no routes' FROM r WHERE c_custkey % 5 = 4""",
)
def _parse(spark, sf):
    specs = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "concat('na', chr(97 + c_nationkey)) AS a",
        "concat('ZZ', chr(65 + c_custkey % 26)) AS b",
    )
    spec = F.expr(
        "CASE c_custkey % 5 WHEN 0 THEN concat(' ', a, ' : ', b, ' ,') WHEN 1 THEN concat(a, ':', b, ', ', b, ':', a) "
        "WHEN 2 THEN concat(a, ':', b, ',,', a) WHEN 3 THEN concat(a, ': ') ELSE ' , ' END"
    )
    return routes.parse_route_spec(specs.select("c_custkey", spec.alias("spec"))).drop("spec")


@query(
    "route_coverage",
    f"""WITH {ROUTES}, days AS (
      SELECT date_diff('day', DATE '2000-01-01', o_orderdate::DATE + (o_orderkey % 7 * 400)::INT) AS d FROM orders),
    seen AS (SELECT floor(d / 3)::BIGINT AS cycle, (d % 3 + 3) % 3 AS batch, count(*) AS times FROM days GROUP BY 1, 2),
    slots AS (SELECT * FROM (SELECT unnest(range(min(cycle), max(cycle) + 1)) AS cycle FROM seen), (VALUES (0), (1), (2)) b(batch))
    SELECT cycle, origin, destination, coalesce(times, 0)::BIGINT AS times
    FROM slots LEFT JOIN seen USING (cycle, batch) JOIN routes USING (batch) WHERE coalesce(times, 0) <> 1""",
)
def _coverage(spark, sf):
    # Runs shifted by years leave windows at both ends with few runs, and some with none.
    days = fx.table(spark, sf, "orders").selectExpr("date_add(o_orderdate, CAST(o_orderkey % 7 * 400 AS INT)) AS day")
    return routes.route_coverage(_routes(spark, sf), days)


# ---- normalisation ----


def _ts(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


_GOOD = "k % 5 > 1"
_PAGES = "pages_k AS (SELECT event_id AS page_id, (props->>'$.k')::INT AS k FROM events)"


@query(
    "explode_pages",
    f"""WITH {_PAGES}
    SELECT page_id, 0::BIGINT AS entry_pos, (k * 100 + 1000)::DOUBLE AS price, 'AA' AS airlines, 1000::BIGINT AS typical,
      900::BIGINT AS emission FROM pages_k WHERE {_GOOD}
    UNION ALL SELECT page_id, 2, NULL, '', 1000, 900 FROM pages_k WHERE {_GOOD}""",
)
def _explode_pages(spark, sf):
    rows = fare.explode_pages(fx.pages(spark, sf))
    return rows.select(
        "page_id",
        F.col("entry_pos").cast("long").alias("entry_pos"),
        "price",
        F.array_join("airlines", ",").alias("airlines"),
        F.col("carbon.typical_on_route").alias("typical"),
        F.col("carbon.emission").alias("emission"),
    )


query(
    "explode_pages_counts",
    f"""WITH {_PAGES} SELECT page_id, CASE WHEN {_GOOD} THEN 2 ELSE 0 END::BIGINT AS kept,
    CASE WHEN {_GOOD} THEN 1 ELSE 0 END::BIGINT AS skipped FROM pages_k""",
)(lambda spark, sf: fare.page_counts(fx.pages(spark, sf)))


@query(
    "partial_datetime",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 6 IN (3, 4) THEN NULL
      WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 17:45:00'
      WHEN o_orderkey % 6 = 5 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 09:00:00'
      ELSE strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00:00' END AS at
    FROM orders""",
)
def _partial(spark, sf):
    parts = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "array(year(o_orderdate), IF(o_orderkey % 13 = 0, NULL, month(o_orderdate)), "
        "day(o_orderdate) + IF(o_orderkey % 11 = 0, 40, 0)) AS d",
        "CASE o_orderkey % 6 WHEN 0 THEN array(17, 45) WHEN 3 THEN array(CAST(NULL AS INT), 5) "
        "WHEN 4 THEN CAST(array() AS ARRAY<INT>) WHEN 5 THEN array(9, NULL) "
        "ELSE array(CAST(o_orderkey % 24 AS INT)) END AS t",
    )
    at = F.date_format(fare.partial_datetime("d", "t"), "yyyy-MM-dd HH:mm:ss")
    return parts.select("o_orderkey", at.alias("at"))


@query(
    "positive_price",
    """SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN l_extendedprice - 20000 > 0
    THEN trunc(l_extendedprice - 20000)::BIGINT END AS price FROM lineitem""",
)
def _positive(spark, sf):
    raw = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "CAST(l_linenumber AS BIGINT) AS line", "l_extendedprice - 20000 AS price"
    )
    return fare.positive_price(raw)


@query(
    "stops_and_legs",
    f"""WITH {ITINERARIES} SELECT search_id, part, stops, strftime(departure_dt, '%Y-%m-%d %H:%M:%S') AS departure_dt,
    strftime(arrival_dt, '%Y-%m-%d %H:%M:%S') AS arrival_dt, aircraft, airline FROM itineraries""",
)
def _stops(spark, sf):
    rows = fare.stops_and_legs(fx.entries(spark, sf))
    return rows.select("search_id", "part", "stops", _ts("departure_dt"), _ts("arrival_dt"), "aircraft", "airline")


query(
    "first_layover",
    f"WITH {ITINERARIES} SELECT search_id, part, layover_city, layover_duration_mins FROM itineraries",
)(
    lambda spark, sf: fare.first_layover(fx.entries(spark, sf)).select(
        "search_id", "part", "layover_city", "layover_duration_mins"
    )
)

query("leg_duration", f"WITH {ITINERARIES} SELECT search_id, part, duration_mins FROM itineraries")(
    lambda spark, sf: fare.leg_duration(fx.entries(spark, sf)).select("search_id", "part", "duration_mins")
)


@query(
    "co2_fields",
    f"""WITH {ITINERARIES} SELECT search_id, part, co2_g, co2_typical_g, {CO2} AS co2_delta_pct,
    round_even(co2_g / 1000, 0)::BIGINT AS co2_kg FROM itineraries""",
)
def _co2(spark, sf):
    grams = fx.entries(spark, sf).selectExpr(
        "search_id", "part", "carbon.emission AS co2_g", "carbon.typical_on_route AS co2_typical_g"
    )
    return fare.co2_fields(grams)


_LOCAL = "(ts + INTERVAL 330 MINUTE)"
_LEAVES = f"({_LOCAL}::DATE + (event_id % 60)::INT)"


@query(
    "booking_context",
    f"""SELECT event_id, 4::BIGINT AS "Schema_Version", strftime({_LOCAL}, '%Y-%m-%d %H:%M:%S') AS "Scrape_Timestamp",
    event_id % 60 AS "Days_to_Departure", strftime({_LEAVES}, '%Y-%m-%d') AS "Departure_Date",
    dayname({_LEAVES}) AS "Day_of_Week", dayname({_LOCAL}) AS "Booking_Day_Of_Week",
    CASE WHEN isodow({_LEAVES}) >= 6 THEN 1 ELSE 0 END::BIGINT AS "Is_Weekend_Departure", 'INR' AS "Currency",
    'economy' AS "Cabin_Class", strftime(ts, '%Y%m%dT%H%M%SZ') AS "Run_Id" FROM events""",
)
def _context(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "ts")
    return fare.booking_context(events, "ts", F.col("event_id") % 60).drop("ts")


query(
    "run_id", "SELECT strftime(ts, '%Y%m%dT%H%M%SZ') AS run_id, count(*) AS n FROM events GROUP BY 1"
)(
    lambda spark, sf: fx.table(spark, sf, "events")
    .groupBy(fare.run_id("ts").alias("run_id"))
    .agg(F.count(F.lit(1)).alias("n"))
)

query(
    "clock_fields",
    """SELECT event_id, strftime(ts, '%-I:%M %p') AS "Departure_Time",
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "Departure_ISO", hour(ts)::BIGINT AS "Departure_Hour" FROM events""",
)(
    lambda spark, sf: fare.clock_fields(
        fx.table(spark, sf, "events").select("event_id", "ts"), "ts", prefix="Departure"
    ).drop("ts")
)


@query(
    "overnight_flag",
    """SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey,
      coalesce((o_orderdate::DATE < (CASE WHEN l_quantity <> 5 THEN l_shipdate END)::DATE)::INT, 0)::BIGINT AS overnight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _overnight(spark, sf):
    lines, orders = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    arrives = F.when(F.col("l_quantity") != 5, F.col("l_shipdate"))
    return joined.select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("line"),
        "l_partkey",
        fare.overnight_flag("o_orderdate", arrives).alias("overnight"),
    )


query(
    "num_results",
    """SELECT o_orderkey AS search_id, count(CASE WHEN l_quantity <> 1 THEN 1 END) AS num_results
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)(
    lambda spark, sf: fare.num_results(fx.tasks(spark, sf).select("search_id"), fx.results(spark, sf))
)

for _name, _op, _where in (
    ("pick_best", fare.pick_best, "flight_category = 'Best'"),
    ("pick_cheapest", fare.pick_cheapest, "flight_category = 'Cheapest'"),
    ("pick_median", fare.pick_median, "flight_category = 'Median'"),
):
    query(_name, f"WITH {RESULTS} SELECT search_id, part, supplier, price FROM picks WHERE {_where}")(
        lambda spark, sf, op=_op: op(fx.results(spark, sf)).select("search_id", "part", "supplier", "price")
    )


@query(
    "fare_categories",
    f"""WITH {TASKS}, {RESULTS}
    SELECT search_id, origin, destination, days_out::BIGINT AS days_out, coalesce(flight_category, 'NoFlights') AS flight_category,
      price, part, supplier, coalesce(n, 0) AS num_results FROM tasks LEFT JOIN picks USING (search_id)""",
)
def fare_categories(spark, sf):
    rows = fare.fare_categories(fx.tasks(spark, sf), fx.results(spark, sf))
    return rows.select(
        "search_id",
        "origin",
        "destination",
        F.col("days_out").cast("long").alias("days_out"),
        "flight_category",
        "price",
        "part",
        "supplier",
        "num_results",
    )


_PICKED = f"""{TASKS}, {ITINERARIES},
priced AS (SELECT *, count(*) OVER s AS n, row_number() OVER (s ORDER BY rk) AS by_rank,
    row_number() OVER (s ORDER BY price, rk) AS by_price, min(price) OVER s AS low
  FROM itineraries WHERE price IS NOT NULL WINDOW s AS (PARTITION BY search_id)),
picks AS (SELECT *, 'Best' AS category FROM priced WHERE by_rank = 1
  UNION ALL SELECT *, 'Cheapest' FROM priced WHERE by_price = 1
  UNION ALL SELECT *, 'Median' FROM priced WHERE by_price = n // 2 + 1 AND price <> low)"""


def _clock(at: str, prefix: str) -> str:
    return (
        f"strftime({at}, '%-I:%M %p') AS \"{prefix}_Time\", strftime({at}, '%Y-%m-%dT%H:%M:%S') AS \"{prefix}_ISO\""
    )


@query(
    "fare_rows",
    f"""WITH {_PICKED}, dated AS (SELECT *, now + INTERVAL 330 MINUTE AS local,
      (now + INTERVAL 330 MINUTE)::DATE + days_out::INT AS leaves FROM tasks)
    SELECT search_id, 4::BIGINT AS "Schema_Version", strftime(local, '%Y-%m-%d %H:%M:%S') AS "Scrape_Timestamp",
      days_out::BIGINT AS "Days_to_Departure", strftime(leaves, '%Y-%m-%d') AS "Departure_Date",
      dayname(leaves) AS "Day_of_Week", dayname(local) AS "Booking_Day_Of_Week",
      {_clock('departure_dt', 'Departure')}, hour(departure_dt) AS "Departure_Hour", {_clock('arrival_dt', 'Arrival')},
      CASE WHEN isodow(leaves) >= 6 THEN 1 ELSE 0 END::BIGINT AS "Is_Weekend_Departure",
      coalesce((arrival_dt::DATE > departure_dt::DATE)::INT, 0)::BIGINT AS "Is_Overnight", origin AS "Source_City",
      destination AS "Destination_City", nullif(airline, '') AS "Airline", NULL::VARCHAR AS "Flight_Number",
      nullif(aircraft, '') AS "Aircraft", duration_mins AS "Total_Duration_Mins", stops AS "Number_of_Stops",
      nullif(layover_city, '') AS "Layover_City", layover_duration_mins AS "Layover_Duration_Mins",
      CASE WHEN category IS NOT NULL THEN 0 END::BIGINT AS "Self_Transfer",
      round_even(co2_g / 1000, 0)::BIGINT AS "CO2_Emissions_Kg", {CO2} AS "CO2_Delta_Pct",
      coalesce(n, 0) AS "Num_Results", 'fast-flights' AS "Data_Source",
      coalesce(category, 'NoFlights') AS "Flight_Category", price AS "Price_INR", co2_typical_g AS "Carbon_Typical_g",
      'INR' AS "Currency", 'economy' AS "Cabin_Class", strftime(now, '%Y%m%dT%H%M%SZ') AS "Run_Id"
    FROM dated LEFT JOIN picks USING (search_id)""",
)
def _fare_rows(spark, sf):
    return fare.fare_rows(fx.tasks(spark, sf), fx.itineraries(spark, sf))


# ---- validation, gates, audits ----


@query(
    "validate_fares",
    f"""WITH {VALIDATED} SELECT version AS "Schema_Version", scraped AS "Scrape_Timestamp", days AS "Days_to_Departure",
    src AS "Source_City", dst AS "Destination_City", cat AS "Flight_Category", source AS "Data_Source",
    price AS "Price_INR", reason AS reject_reason FROM validated""",
)
def _validate(spark, sf):
    return quality.validate_fares(fx.fares(spark, sf)).select(
        "Schema_Version",
        "Scrape_Timestamp",
        "Days_to_Departure",
        "Source_City",
        "Destination_City",
        "Flight_Category",
        "Data_Source",
        "Price_INR",
        "reject_reason",
    )


query(
    "reject_summary",
    f"""WITH {VALIDATED} SELECT reason AS reject_reason, count(*) AS rows_dropped FROM validated
    WHERE reason IS NOT NULL GROUP BY 1""",
)(lambda spark, sf: quality.reject_summary(quality.validate_fares(fx.fares(spark, sf))))


SUMMARY = f"""{_PICKED}, per_search AS (
  SELECT search_id, count(*) AS cats, count(*) FILTER (price BETWEEN 1000 AND 200000) AS good FROM picks GROUP BY 1),
summary AS (
  SELECT run_id, count(*) AS attempted, count(*) FILTER (outcome = 'done' AND cats > 0) AS with_fares,
    count(*) FILTER (outcome = 'done' AND cats IS NULL) AS no_flights, count(*) FILTER (outcome = 'error') AS errored,
    coalesce(sum(coalesce(good, 1)) FILTER (outcome = 'done'), 0)::BIGINT AS rows_written,
    coalesce(sum(coalesce(cats - good, 0)) FILTER (outcome = 'done'), 0)::BIGINT AS rows_dropped,
    count(*) FILTER (outcome = 'done' AND good > 0) AS with_valid
  FROM tasks LEFT JOIN per_search USING (search_id) GROUP BY run_id)"""


def _summary(spark, sf):
    tasks = fx.tasks(spark, sf)
    validated = quality.validate_fares(fare.fare_rows(tasks, fx.itineraries(spark, sf)))
    return quality.run_summary(tasks.select("search_id", "run_id", "outcome"), validated)


@query(
    "run_summary",
    f"""WITH {SUMMARY} SELECT run_id, attempted, with_fares, no_flights, errored, rows_written, rows_dropped, {_RATES},
    {sql_r6('with_valid / attempted')} AS valid_fare_rate FROM summary""",
)
def _run_summary(spark, sf):
    return _summary(spark, sf).withColumns({"fare_rate": r6("fare_rate"), "valid_fare_rate": r6("valid_fare_rate")})


query(
    "attempt_outcome",
    """WITH a AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, CASE event_type WHEN 'purchase' THEN 'ok'
      WHEN 'click' THEN 'empty' WHEN 'view' THEN 'empty' WHEN 'error' THEN 'error' ELSE 'timeout' END AS status
      FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id DESC) AS rn FROM a)
    SELECT user_id, day, count(*) AS attempts, CASE WHEN count(*) FILTER (status = 'ok') > 0 THEN 'fares'
      ELSE min(status) FILTER (rn = 1) END AS outcome FROM r GROUP BY 1, 2""",
)(lambda spark, sf: quality.attempt_outcome(fx.attempts(spark, sf), ["user_id", "day"]))

query(
    "quality_gate",
    f"""WITH {SUMMARY} SELECT run_id, attempted, {_RATES}, attempted > 0 AND with_fares / attempted >= 0.6 AS passed
    FROM summary""",
)(
    lambda spark, sf: quality.quality_gate(_summary(spark, sf)).select(
        "run_id", "attempted", r6("fare_rate").alias("fare_rate"), "passed"
    )
)

query(
    "publish_decision",
    f"""WITH {SUMMARY} SELECT run_id, rows_written, CASE WHEN with_fares / attempted >= 0.7 THEN 'publish'
      WHEN rows_written > 0 THEN 'publish_degraded' ELSE 'reject' END AS decision,
      CASE WHEN with_fares / attempted < 0.7 AND rows_written = 0 THEN 3 ELSE 0 END::BIGINT AS exit_code
    FROM summary""",
)(
    lambda spark, sf: quality.publish_decision(_summary(spark, sf), min_rate=0.7).select(
        "run_id", "rows_written", "decision", "exit_code"
    )
)


@query(
    "canary_check",
    f"""WITH r AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, {_code('l_suppkey')} AS o, {_code('l_partkey')} AS d,
      CASE WHEN l_quantity = 1 THEN NULL ELSE floor(l_extendedprice)::BIGINT END AS price FROM lineitem)
    SELECT month, count(*) FILTER (o = 'NAB' AND d = 'NAE') AS probe_results,
      count(price) FILTER (o = 'NAB' AND d = 'NAE') > 0 AS canary_ok,
      min(price) FILTER (o = 'NAB' AND d = 'NAE') AS cheapest FROM r GROUP BY 1""",
)
def _canary(spark, sf):
    rows = fx.table(spark, sf, "lineitem").selectExpr(
        "date_format(l_shipdate, 'yyyy-MM') AS month",
        "concat('NA', chr(65 + l_suppkey % 25)) AS origin",
        "concat('NA', chr(65 + l_partkey % 25)) AS destination",
        "CASE WHEN l_quantity = 1 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS price",
    )
    return quality.canary_check(rows, ["month"], origin="NAB", destination="NAE")


query(
    "legacy_filter",
    f"""WITH {FARES} SELECT version AS "Schema_Version", scraped AS "Scrape_Timestamp", price AS "Price_INR" FROM fares
    WHERE version >= 4 OR coalesce(price, 0) BETWEEN 1000 AND 200000""",
)(
    lambda spark, sf: quality.legacy_filter(fx.fares(spark, sf)).select(
        "Schema_Version", "Scrape_Timestamp", "Price_INR"
    )
)

query(
    "plausibility_audit",
    f"""WITH {FARES}, c AS (SELECT coalesce(cat, 'ALL') AS cat, coalesce(source, 'ALL') AS source,
      count(*) FILTER (price BETWEEN 1000 AND 200000) AS good, count(*) AS n
      FROM fares WHERE price IS NOT NULL GROUP BY CUBE (cat, source))
    SELECT cat AS "Flight_Category", source AS "Data_Source", good AS plausible, n - good AS implausible,
      {sql_r6('(n - good) / n')} AS bogus_share FROM c""",
)(
    lambda spark, sf: quality.plausibility_audit(fx.fares(spark, sf)).withColumn("bogus_share", r6("bogus_share"))
)

query(
    "dataset_profile",
    f"""WITH {FARES}, v AS (
      SELECT 'Schema_Version' AS field, version::VARCHAR AS value, version::VARCHAR IN ('1', '2', '3', '4') AS ok FROM fares
      UNION ALL SELECT 'Flight_Category', cat, cat IN ('Best', 'Cheapest', 'Median', 'NoFlights') FROM fares
      UNION ALL SELECT 'Data_Source', source, source IN ('fast-flights', 'fli', 'playwright') FROM fares
      UNION ALL SELECT 'Days_to_Departure', days, days IN ('1', '3', '7', '14', '30', '60') FROM fares)
    SELECT field, value, count(*) AS n_rows, coalesce(bool_and(ok), FALSE) AS expected FROM v GROUP BY field, value
    UNION ALL SELECT 'rows', NULL, count(*), TRUE FROM fares
    UNION ALL SELECT 'routes', NULL, count(DISTINCT src || '>' || dst), TRUE FROM fares
    UNION ALL SELECT 'first_scrape', min(scraped), NULL, TRUE FROM fares
    UNION ALL SELECT 'last_scrape', max(scraped), NULL, TRUE FROM fares""",
)(lambda spark, sf: quality.dataset_profile(fx.fares(spark, sf)))

query(
    "integrity_counts",
    f"""WITH {FARES} SELECT 'month' AS "by", scraped[1:7] AS value, count(*) AS n_rows,
      count(DISTINCT src || '>' || dst) AS routes FROM fares GROUP BY 2
    UNION ALL SELECT 'version', version::VARCHAR, count(*), count(DISTINCT src || '>' || dst) FROM fares GROUP BY 2
    UNION ALL SELECT 'category', cat, count(*), count(DISTINCT src || '>' || dst) FROM fares GROUP BY 2""",
)(lambda spark, sf: quality.integrity_counts(fx.fares(spark, sf)))

query(
    "lead_time_bands",
    f"""WITH {FARES} SELECT days AS "Days_to_Departure", dow AS "Day_of_Week", booking_dow AS "Booking_Day_Of_Week",
      cat AS "Flight_Category", count(*) AS n, {sql_r6('avg(price)')} AS mean_price, min(price) AS min_price,
      max(price) AS max_price, {sql_r6('quantile_cont(price, 0.25)')} AS q25,
      {sql_r6('quantile_cont(price, 0.5)')} AS median_price, {sql_r6('quantile_cont(price, 0.75)')} AS q75
    FROM fares WHERE price IS NOT NULL GROUP BY 1, 2, 3, 4""",
)(
    lambda spark, sf: quality.lead_time_bands(fx.fares(spark, sf)).withColumns(
        {c: r6(c) for c in ("mean_price", "q25", "median_price", "q75")}
    )
)


# ---- logs and run health ----


def _logs(spark, sf):
    path = scratch_path(spark, "logs")
    fx.log_lines(spark, sf).write.text(path)
    return read_run_logs(spark, path)


_LOG_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"


@query(
    "read_run_logs",
    f"WITH {LOGS} SELECT {_LOG_TS} AS ts, level, 'pipeline' AS logger, run_id, message FROM logs",
)
def _read_run_logs(spark, sf):
    return _logs(spark, sf).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))


_LAST = "arg_max({0}, (ts, message)) FILTER ({1})"
_FIGURES = f"""figures AS (SELECT run_id, max(ts) AS last_ts,
    {_LAST.format("(user_id % 3)::VARCHAR", "event_type = 'purchase'")} AS exit_code,
    {_LAST.format("(event_id % 500)::VARCHAR", "event_type = 'click'")} AS rows_written,
    {_LAST.format("value::DECIMAL(10, 2)::VARCHAR", "event_type = 'view'")} AS fare_rate,
    {_LAST.format("CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END", "event_type = 'signup'")} AS budget_hit,
    {_LAST.format("message", "event_type = 'error'")} AS last_error,
    count(*) FILTER (event_type = 'purchase' AND user_id % 3 > 0) AS failed FROM logs GROUP BY 1)"""


@query(
    "recent_runs",
    f"""WITH {LOGS}, {_FIGURES} SELECT run_id, {_LOG_TS.replace('ts,', 'last_ts,')} AS last_ts, exit_code, rows_written,
    fare_rate, budget_hit FROM figures ORDER BY figures.last_ts DESC, run_id DESC LIMIT 5""",
)
def _recent(spark, sf):
    runs = quality.recent_runs(_logs(spark, sf))
    return runs.withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSS"))


query(
    "failed_runs",
    f"""WITH {LOGS}, {_FIGURES} SELECT run_id, coalesce(last_error, '<no error message>') AS last_error FROM figures
    WHERE last_ts > TIMESTAMP '2024-01-14 00:00:00' AND last_ts <= TIMESTAMP '2024-01-21 00:00:00' AND failed > 0""",
)(lambda spark, sf: quality.failed_runs(_logs(spark, sf), "2024-01-21 00:00:00"))

query(
    "freshness",
    """SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest,
      floor((epoch(TIMESTAMP '2024-02-03 00:00:00') - floor(epoch(max(ts)))) / 3600)::BIGINT AS age_hours,
      floor((epoch(TIMESTAMP '2024-02-03 00:00:00') - floor(epoch(max(ts)))) / 3600) > 36 AS stale FROM events""",
)(
    lambda spark, sf: quality.freshness(fx.table(spark, sf, "events"), "ts", "2024-02-03 00:00:00").withColumn(
        "newest", F.date_format("newest", "yyyy-MM-dd HH:mm:ss")
    )
)


@query(
    "rows_with_logs",
    f"""WITH {LOGS}, per_run AS (SELECT run_id, count(*) AS log_lines, count(*) FILTER (level = 'ERROR') AS error_lines,
      arg_max(message, (ts, message)) AS last_message FROM logs GROUP BY 1)
    SELECT event_id, run_id, log_lines, error_lines, last_message FROM (
      SELECT event_id, strftime(ts, '%Y%m%d') || 'T' || lpad((hour(ts) // 3 * 3)::VARCHAR, 2, '0') || '0000Z' AS run_id
      FROM events) JOIN per_run USING (run_id)""",
)
def _with_logs(spark, sf):
    rows = fx.table(spark, sf, "events").selectExpr(
        "event_id",
        "concat(date_format(ts, 'yyyyMMdd'), 'T', lpad(CAST(hour(ts) div 3 * 3 AS STRING), 2, '0'), '0000Z') AS run_id",
    )
    return quality.rows_with_logs(rows, _logs(spark, sf))


# ---- monthly files ----

_FILE_COLUMNS = ["Schema_Version", "Scrape_Timestamp", "Days_to_Departure", "Source_City", "Destination_City",
                 "Flight_Category", "Price_INR"]
_FILE_SQL = """version AS "Schema_Version", scraped AS "Scrape_Timestamp", days::BIGINT AS "Days_to_Departure",
  src AS "Source_City", dst AS "Destination_City", cat AS "Flight_Category", price AS "Price_INR" """


@query(
    "append_fares_monthly",
    f"""WITH {VALIDATED} SELECT {_FILE_SQL}, strftime(scraped::TIMESTAMP, '%Y_%m') AS year_month
    FROM validated WHERE reason IS NULL""",
)
def _append(spark, sf):
    path = scratch_path(spark, "fares")
    good = quality.valid_rows(quality.validate_fares(fx.fares(spark, sf)))
    append_fares_monthly(good, path, F.to_timestamp("Scrape_Timestamp"))
    return read_fares(spark, path).select(*_FILE_COLUMNS, "year_month")


@query(
    "read_fares_all_months",
    f"""WITH {VALIDATED} SELECT {_FILE_SQL}, CASE WHEN version = 4 THEN run_id END AS "Run_Id" FROM validated
    WHERE reason IS NULL OR (version = 3 AND try_cast(days AS BIGINT) >= 0)""",
)
def _all_months(spark, sf):
    current, legacy = scratch_path(spark, "fares-v4"), scratch_path(spark, "fares-v3")
    rows = quality.validate_fares(fx.fares(spark, sf))
    append_fares_monthly(quality.valid_rows(rows), current, F.to_timestamp("Scrape_Timestamp"))
    old = rows.where("Schema_Version = 3 AND try_cast(Days_to_Departure AS BIGINT) >= 0")
    month = F.date_format(F.to_timestamp("Scrape_Timestamp"), "yyyy_MM").alias("year_month")
    # Without the hint each task would write a file for each of its months, and their number would be tasks times months.
    months = old.select(*FARE_COLUMNS_V3, month).hint("rebalance", "year_month")
    months.write.partitionBy("year_month").option("header", True).csv(legacy)
    return read_fares_all_months(spark, current, legacy).select(*_FILE_COLUMNS, "Run_Id")
