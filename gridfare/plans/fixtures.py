"""Views of the driver tables shaped like the library's inputs. Every view reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfare.operators.fares import normalise_itineraries
from gridfare.schemas import FARE_COLUMNS


#: Rows that a task takes at most when a table is dealt out, on average: of flat rows, and of planes with their 64 pixels.
TABLE_ROWS, PLANE_ROWS = 1 << 18, 1 << 12


def parts(spark: SparkSession, sf: str, name: str, rows: int) -> int:
    """Partitions to deal a driver table out to, ``rows`` to each: their number grows with the table, a task does not."""
    most = spark.read.parquet(f"{sf}/{name}.parquet").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // rows))


def table(spark: SparkSession, sf: str, name: str, *, spread: str | None = None, rows: int = TABLE_ROWS) -> DataFrame:
    """One driver table; ``spread`` names a key to deal its rows out by before costly expressions, about ``rows`` to a task."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.repartition(parts(spark, sf, name, rows), spread) if spread else df


# ---- fares ----

_HORIZON = "element_at(array(1, 3, 7, 14, 30, 60), cast({} % 6 as int) + 1)"


def _code(n: str) -> str:
    return f"concat('NA', chr(65 + {n} % 25))"


def airports(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr(f"{_code('n_nationkey')} AS code")


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as searches."""
    now = "CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, o_orderkey * 37 % 86400)"
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS search_id",
        f"{_code('o_custkey')} AS origin",
        f"{_code('(o_custkey % 25 + 1 + o_orderkey % 24)')} AS destination",
        f"{_HORIZON.format('o_orderkey')} AS days_out",
        f"{now} AS now",
        "date_format(o_orderdate, 'yyyy-MM') AS run_id",
        "CASE o_orderstatus WHEN 'P' THEN 'error' ELSE 'done' END AS outcome",
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as the results of those searches, in page order by ``rank``."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS search_id",
        "struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rank",
        "l_partkey AS part",
        "l_suppkey AS supplier",
        "CASE WHEN l_quantity = 1 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS price",
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as page entries with nought to three legs, short times, unknown hours and missing carbon."""
    moments, lengths = [], [f"((l_partkey * 7 + {i} * 45) % 400)" for i in (1, 2, 3)]
    for i in (1, 2, 3):
        minute = f"(({i} - 1) * 300 + l_partkey % 360)"
        moments.append(f"timestampadd(MINUTE, CAST({minute} AS INT), l_shipdate) AS _departs_{i}")
        moments.append(f"timestampadd(MINUTE, CAST({minute} + {lengths[i - 1]} AS INT), l_shipdate) AS _arrives_{i}")

    def leg(i: int) -> str:
        departs, arrives, length = f"_departs_{i}", f"_arrives_{i}", lengths[i - 1]

        def date(at: str, shift: int) -> str:
            month = f"IF((l_partkey + {i} + {shift}) % 29 = 0, NULL, month({at}))"
            return f"array(year({at}), {month}, day({at}))"

        def time(at: str, shift: int) -> str:
            return (
                f"CASE WHEN (l_partkey + {i} + {shift}) % 17 = 0 THEN array(CAST(NULL AS INT), minute({at}))"
                f" WHEN (l_suppkey + {i} + {shift}) % 7 = 0 THEN array(hour({at}))"
                f" ELSE array(hour({at}), minute({at})) END"
            )

        return (
            f"named_struct('from_code', {_code(f'(l_suppkey + {i})')}, 'to_code', {_code(f'(l_suppkey + {i} + 1)')},"
            f" 'dep_date', {date(departs, 0)}, 'dep_time', {time(departs, 0)},"
            f" 'arr_date', {date(arrives, 5)}, 'arr_time', {time(arrives, 5)},"
            f" 'duration', CAST(IF(l_partkey % 9 = 0, NULL, {length}) AS INT),"
            f" 'plane_type', concat('A', CAST(l_partkey % 5 + 318 AS STRING)))"
        )

    # Each leg is written out, so that Spark compiles it; a function of the leg's number would be interpreted.
    listed = ", ".join(f"IF(l_linenumber % 4 >= {i}, {leg(i)}, NULL)" for i in (1, 2, 3))
    legs = f"IF(l_linenumber IS NULL, NULL, array_compact(array({listed})))"
    timed = table(spark, sf, "lineitem", spread="l_orderkey").selectExpr("*", *moments)
    return timed.selectExpr(
        "l_orderkey AS search_id",
        "struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rank",
        "l_partkey AS part",
        "CASE WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 3 THEN 0.0 ELSE l_extendedprice END AS price",
        "slice(array(concat('AL', l_suppkey % 7), concat('AL', l_suppkey % 3)), 1, CAST(l_suppkey % 3 AS INT)) "
        "AS airlines",
        f"{legs} AS legs",
        "struct(IF(l_partkey % 13 = 0, NULL, IF(l_partkey % 10 = 0, 0, 50000 + l_suppkey * 500)) AS typical_on_route,"
        " IF(l_quantity = 2, NULL, l_partkey * 37 % 200000) AS emission) AS carbon",
    )


def itineraries(spark: SparkSession, sf: str) -> DataFrame:
    return normalise_itineraries(entries(spark, sf))


def fares(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as finished fare rows with planted faults; the columns not listed here are null."""
    row = table(spark, sf, "lineitem", spread="l_orderkey").selectExpr(
        "CAST(IF(l_partkey % 11 = 0, 3, 4) AS BIGINT) AS Schema_Version",
        "date_format(l_shipdate + make_dt_interval(0, 0, 0, l_orderkey * 37 % 86400), 'yyyy-MM-dd HH:mm:ss') "
        "AS Scrape_Timestamp",
        "CASE l_orderkey % 19 WHEN 0 THEN 'x' WHEN 1 THEN '-1' "
        f"ELSE CAST({_HORIZON.format('l_orderkey')} AS STRING) END AS Days_to_Departure",
        "CASE WHEN l_linenumber = 6 AND l_partkey % 3 = 0 THEN '2024-02-30' WHEN l_partkey % 5 = 0 "
        "THEN date_format(l_shipdate, 'yyyy-M-d') ELSE date_format(l_shipdate, 'yyyy-MM-dd') END AS Departure_Date",
        "date_format(l_shipdate, 'EEEE') AS Day_of_Week",
        "date_format(date_add(l_shipdate, CAST(-(l_orderkey % 6) AS INT)), 'EEEE') AS Booking_Day_Of_Week",
        f"IF(l_suppkey % 17 = 0, 'nab', {_code('l_suppkey')}) AS Source_City",
        f"{_code('l_partkey')} AS Destination_City",
        "CASE l_linenumber WHEN 1 THEN 'Best' WHEN 2 THEN 'Cheapest' WHEN 3 THEN 'Median' WHEN 4 THEN 'NoFlights' "
        "WHEN 5 THEN 'Best' WHEN 6 THEN 'Cheapest' ELSE 'Other' END AS Flight_Category",
        "CASE WHEN l_suppkey % 23 = 0 THEN 'unknown' WHEN l_returnflag = 'R' THEN 'fast-flights' "
        "WHEN l_returnflag = 'A' THEN 'fli' ELSE 'playwright' END AS Data_Source",
        "CASE WHEN l_quantity = 1 OR (l_linenumber = 4 AND l_quantity > 10) THEN NULL "
        "ELSE CAST(floor(l_extendedprice) AS BIGINT) * IF(l_discount = 0.05, 3, 1) END AS Price_INR",
        "date_format(l_shipdate, 'yyyy-MM-dd') AS Run_Id",
    )
    return row.select(
        *[F.col(c) if c in row.columns else F.lit(None).cast("string").alias(c) for c in FARE_COLUMNS]
    )


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as result pages: not-found, null list, and lists with good and bad entries."""
    carbon = '"carbon":{"typical_on_route":1000,"emission":900}'
    good = f"concat('{{\"price\":', k * 100 + 1000, ',\"type\":\"x\",\"airlines\":[\"AA\"],\"legs\":[],{carbon}}}')"
    unpriced = f"'{{\"price\":null,\"type\":\"x\",\"airlines\":[],\"legs\":[],{carbon}}}'"
    bad = f"IF(k % 2 = 0, '{{\"legs\":[],{carbon}}}', '{{\"price\":7}}')"
    return (
        table(spark, sf, "events", spread="event_id")
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .selectExpr(
            "event_id AS page_id",
            "CASE k % 5 WHEN 0 THEN '{\"not_found\":true}' WHEN 1 THEN '{\"entries\":null}' "
            f"ELSE concat('{{\"entries\":[', {good}, ',', {bad}, ',', {unpriced}, ']}}') END AS body",
        )
    )


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log lines of runs three hours long."""
    return table(spark, sf, "events").selectExpr(
        "concat('[', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\"), 'Z] [', IF(event_type = 'error', 'ERROR', 'INFO '),"
        " '] [pipeline    ] [run=', date_format(ts, 'yyyyMMdd'), 'T', lpad(CAST(hour(ts) div 3 * 3 AS STRING), 2, '0'),"
        " '0000Z] ', CASE event_type WHEN 'error' THEN concat('search FAILED for ', user_id)"
        " WHEN 'purchase' THEN concat('=== cron_slice.sh end rc=', user_id % 3)"
        " WHEN 'view' THEN concat('fare_rate=', CAST(value AS DECIMAL(10, 2)))"
        " WHEN 'click' THEN concat('rows_written=', event_id % 500)"
        " ELSE concat('budget_hit=', IF(user_id % 2 = 0, 'True', 'False')) END) AS value"
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as search attempts: a search is a user on a day, an attempt its event id."""
    return table(spark, sf, "events").selectExpr(
        "user_id",
        "date_format(ts, 'yyyy-MM-dd') AS day",
        "event_id AS attempt",
        "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'empty' WHEN 'view' THEN 'empty' "
        "WHEN 'error' THEN 'error' ELSE 'timeout' END AS status",
    )


# ---- grids ----

#: Folds of equal share at every size.
FOLD = "CAST(image_num % 4 + 1 AS BIGINT) AS fold_id"


def planes(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as images holding one 8x8 plane, row-major."""
    return table(spark, sf, "embeddings", spread="vec_id", rows=PLANE_ROWS).selectExpr(
        "vec_id",
        "concat('img_', vec_id + 1, '.jpg') AS image",
        "vec_id + 1 AS image_num",
        "IF(vec_id % 5 = 0, 'Test', 'Train') AS split",
        "label AS team",
        "CAST(embedding AS ARRAY<DOUBLE>) AS v",
        "8 AS height",
        "8 AS width",
    )


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    labels = "transform(v, (x, i) -> IF(x > 0.1D, CAST((team + i div 24) % 10 + 1 AS INT), 0))"
    found = planes(spark, sf).withColumn("labels", F.expr(labels))
    return found.withColumn("count", F.expr("CAST(least(20, size(filter(labels, l -> l > 0))) AS INT)"))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations, one row per image; up to three teams each."""
    cells_ = [f"labels[{i}] AS c{i + 1:02d}" for i in range(64)]
    return _labelled(spark, sf).selectExpr("image", "split", "count", *cells_)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same annotations as cells, with the plane value of each cell."""
    rows = _labelled(spark, sf).select(
        "image", "image_num", "split", "count", F.posexplode("labels").alias("cell_id", "label"), "v"
    )
    return rows.selectExpr(
        "image",
        "image_num",
        "split",
        "CAST(count AS BIGINT) AS count",
        "CAST(cell_id AS BIGINT) AS cell_id",
        "CAST(cell_id + 1 AS BIGINT) AS cell_num",
        "CAST(cell_id div 8 AS BIGINT) AS cell_row",
        "CAST(cell_id % 8 AS BIGINT) AS cell_col",
        "CAST(label AS BIGINT) AS label",
        "IF(label > 0, 1L, 0L) AS player_present",
        "v[cell_id] AS v",
        FOLD,
    )


def annotation_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as labelling actions: a user id is an image, and five annotators work on them."""
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "ts",
        "user_id AS image_id",
        "concat('u', event_id % 5) AS user",
        "CASE event_type WHEN 'signup' THEN 'lock' WHEN 'click' THEN 'heartbeat' WHEN 'view' THEN 'save' "
        "WHEN 'purchase' THEN 'unlock' ELSE IF(event_id % 2 = 0, 'force_unlock', 'lock') END AS action",
        "CAST(floor(value) AS BIGINT) % 21 AS count",
    )


def gray_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Planes as grey levels 0-255."""
    level = "transform(v, x -> CAST(floor(least(255D, greatest(0D, (x + 0.6D) / 1.2D * 255D))) AS DOUBLE))"
    return planes(spark, sf).selectExpr("image", "team", "height", "width", f"{level} AS level")


def colour_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Grey planes tinted into three channels."""
    return gray_planes(spark, sf).selectExpr(
        "image",
        "team",
        "height",
        "width",
        "transform(level, x -> CAST(x AS INT)) AS r",
        "transform(level, x -> CAST(255 - x AS INT)) AS g",
        "transform(level, x -> CAST(x * 7 % 256 AS INT)) AS b",
    )


def maps(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with a probability, for assembling maps."""
    return cells(spark, sf).withColumn("p", F.expr("least(1D, greatest(0D, v + 0.5D))"))


def map_planes(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).selectExpr(
        "image",
        "CAST(count AS BIGINT) AS count",
        FOLD,
        "height",
        "width",
        "transform(v, x -> least(1D, greatest(0D, x + 0.5D))) AS map",
    )


# ---- models ----

CELL_FEATURES = ["f_blur", "f_laplacian", "f_center_x", "f_center_y"]


def cell_features(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with plane features that hint at presence without giving it away; some are missing."""
    from gridfare.operators import planes as pl

    base = _labelled(spark, sf).selectExpr("image", "image_num", "count", "height", "width", "labels", "v")
    maps_ = pl.laplacian(pl.gaussian_blur(base, values="v", into="blur"), values="v", into="lap")
    zipped = F.posexplode(F.arrays_zip("labels", "blur", "lap")).alias("cell_id", "z")
    rows = maps_.select("image", "image_num", "count", zipped)
    return rows.selectExpr(
        "image",
        "CAST(cell_id AS BIGINT) AS cell_id",
        "CAST(count AS BIGINT) AS count",
        FOLD,
        "CAST(z.labels AS BIGINT) AS label",
        "IF(z.labels > 0, 1L, 0L) AS player_present",
        "IF(cell_id % 17 = 3, NULL, z.blur) AS f_blur",
        "z.lap AS f_laplacian",
        "(cell_id % 8 + 0.5D) / 8 AS f_center_x",
        "(cell_id div 8 + 0.5D) / 8 AS f_center_y",
    )


def scored_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels as truth, and a score from the length of the document."""
    scores = table(spark, sf, "documents").selectExpr("doc_id", "n_chars % 100 / 100D AS score")
    return table(spark, sf, "labels").join(scores, "doc_id").select("doc_id", "quality", "toxic", "score")
