"""Streaming jobs run to the end of their input, and their batch definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfare.functions.columns import r6
from gridfare.plans import fixtures as fx
from gridfare.plans.grid_queries import ACTIONS
from gridfare.plans.registry import query, sql_r6
from gridfare.session import scratch_path
from gridfare.streaming import jobs, leases


def _stream(spark, df, name, slices=4):
    """A file stream over ``df``, written to the shared folder slice by slice and read in as many micro-batches.

    Slices follow the time of the rows, or a hash of rows without one; a slice has as many files as the data has partitions.
    """
    path = scratch_path(spark, f"in-{name}")
    time = next((c for c in ("now", "ts") if c in df.columns), None)
    if time:
        at = F.col(time).cast("timestamp").cast("double")
        low, high = df.agg(F.min(at), F.max(at)).first()
        place = F.floor((at - F.lit(low)) / F.lit((high or 0.0) - (low or 0.0) + 1.0) * slices)
    else:
        place = F.pmod(F.xxhash64(*df.columns), F.lit(slices))
    dealt = df.withColumn("_slice", F.coalesce(place.cast("int"), F.lit(0)))
    for number in range(slices):
        dealt.where(F.col("_slice") == number).drop("_slice").write.mode("append").parquet(path)
    files = max(1, df.rdd.getNumPartitions())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _finish(spark, start, name):
    path = scratch_path(spark, f"out-{name}")
    start(path, scratch_path(spark, f"progress-{name}")).awaitTermination()
    return spark.read.parquet(path)


_STAMP = "yyyy-MM-dd HH:mm:ss.SSS"


def _ts(name):
    return F.date_format(name, _STAMP).alias(name)


def _ts_sql(name):
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%g') AS {name}"


def _search_pages(spark, sf):
    """Result pages with their search, each delivered twice."""
    events = fx.table(spark, sf, "events").selectExpr("event_id AS page_id", "ts AS now", "user_id")
    once = fx.pages(spark, sf).join(events, "page_id").selectExpr(
        "page_id AS search_id",
        "concat('NA', chr(65 + user_id % 25)) AS origin",
        "concat('NB', chr(65 + user_id % 25)) AS destination",
        "element_at(array(1, 3, 7, 14, 30, 60), CAST(page_id % 6 AS INT) + 1) AS days_out",
        "now",
        "body",
    )
    return once.unionByName(once)


@query(
    "stream_fares",
    """WITH p AS (SELECT event_id AS search_id, ts, user_id, (props->>'$.k')::INT AS k FROM events),
    r AS (SELECT *, unnest(CASE WHEN k % 5 > 1 THEN ['Best', 'Cheapest'] ELSE ['NoFlights'] END) AS category FROM p)
    SELECT search_id, 'NA' || chr((65 + user_id % 25)::INT) AS "Source_City", category AS "Flight_Category",
      CASE WHEN k % 5 > 1 THEN k * 100 + 1000 END::BIGINT AS "Price_INR", strftime(ts, '%Y_%m') AS year_month FROM r""",
)
def _stream_fares(spark, sf):
    pages = _stream(spark, _search_pages(spark, sf), "pages")
    rows = _finish(spark, lambda path, state: jobs.stream_fares(pages, path, state, lateness="60 days"), "fares")
    return rows.select("search_id", "Source_City", "Flight_Category", "Price_INR", "year_month")


def _complete(spark, sf, df, name, aggregate, summarise=lambda d: d):
    stream = aggregate(_stream(spark, df, name))
    return _finish(spark, lambda path, state: jobs.run_complete(stream, path, state, summarise=summarise), name)


@query(
    "autosave_debounce",
    f"""WITH {ACTIONS}, s AS (SELECT *, CASE WHEN ts - lag(ts) OVER u < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
      FROM acts WHERE action = 'save' WINDOW u AS (PARTITION BY image_id, "user" ORDER BY ts, event_id)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id, "user" ORDER BY ts, event_id) AS burst FROM s)
    SELECT image_id, "user", {_ts_sql('max(ts)')[:-len(' AS max(ts)')]} AS ts, arg_max(event_id, (ts, event_id)) AS event_id,
      arg_max(count, (ts, event_id)) AS count, count(*) AS merged FROM b GROUP BY image_id, "user", burst""",
)
def _autosave(spark, sf):
    events = fx.annotation_events(spark, sf)
    saved = _complete(spark, sf, events, "saves", lambda s: jobs.autosave_debounce(s, gap="6 hours"))
    return saved.withColumn("ts", F.date_format("ts", _STAMP))


@query(
    "current_annotations",
    f"""WITH {ACTIONS} SELECT image_id, arg_max("user", (ts, event_id)) AS "user", arg_max(count, (ts, event_id)) AS count,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS ts, arg_max(event_id, (ts, event_id)) AS event_id
    FROM acts WHERE action = 'save' GROUP BY 1""",
)
def _current(spark, sf):
    found = _complete(spark, sf, fx.annotation_events(spark, sf), "current", jobs.current_annotations)
    return found.withColumn("ts", F.date_format("ts", _STAMP))


_LEASES = f"""WITH RECURSIVE {ACTIONS}, e AS (SELECT image_id, ts, "user" AS u, action,
    row_number() OVER (PARTITION BY image_id ORDER BY ts, event_id) AS rn FROM acts WHERE action <> 'save'),
  step AS (
    SELECT image_id, 0::BIGINT AS rn, NULL::VARCHAR AS holder, NULL::TIMESTAMP AS granted, NULL::TIMESTAMP AS expires,
      NULL::VARCHAR AS x_holder, NULL::TIMESTAMP AS x_granted, NULL::TIMESTAMP AS x_ended,
      NULL::VARCHAR AS c_holder, NULL::TIMESTAMP AS c_granted, NULL::TIMESTAMP AS c_ended, NULL::VARCHAR AS c_reason
    FROM (SELECT DISTINCT image_id FROM e)
    UNION ALL
    SELECT image_id, rn, CASE WHEN ends THEN NULL WHEN live IS NULL AND action = 'lock' THEN u ELSE live END,
      CASE WHEN ends THEN NULL WHEN live IS NULL AND action = 'lock' THEN ts WHEN live IS NOT NULL THEN granted END,
      CASE WHEN ends THEN NULL WHEN (live IS NULL AND action = 'lock') OR (live = u AND action IN ('lock', 'heartbeat'))
        THEN ts + INTERVAL 6 HOUR WHEN live IS NOT NULL THEN expires END,
      CASE WHEN live IS NULL THEN holder END, CASE WHEN live IS NULL THEN granted END, CASE WHEN live IS NULL THEN expires END,
      CASE WHEN ends THEN live END, CASE WHEN ends THEN granted END, CASE WHEN ends THEN ts END, CASE WHEN ends THEN action END
    FROM (SELECT s.image_id, e.rn, e.ts, e.u, e.action, s.holder, s.granted, s.expires,
        CASE WHEN e.ts < s.expires THEN s.holder END AS live,
        coalesce(e.ts < s.expires AND ((e.action = 'unlock' AND s.holder = e.u) OR e.action = 'force_unlock'), false) AS ends
      FROM step s JOIN e ON e.image_id = s.image_id AND e.rn = s.rn + 1)),
  done AS (SELECT image_id, x_holder AS holder, x_granted AS granted_at, x_ended AS ended_at, 'expired' AS reason FROM step
      WHERE x_holder IS NOT NULL
    UNION ALL SELECT image_id, c_holder, c_granted, c_ended, c_reason FROM step WHERE c_holder IS NOT NULL
    UNION ALL SELECT s.image_id, holder, granted, expires, 'expired' FROM step s JOIN (
      SELECT image_id, max(rn) AS rn FROM e GROUP BY 1) m ON m.image_id = s.image_id AND m.rn = s.rn WHERE holder IS NOT NULL)
  SELECT image_id, holder, {_ts_sql('granted_at')}, {_ts_sql('ended_at')}, reason FROM done"""


@query("lock_leases", _LEASES)
def _lock_leases(spark, sf):
    found = leases.lock_leases(fx.annotation_events(spark, sf), seconds=6 * 3600)
    return found.select("image_id", "holder", _ts("granted_at"), _ts("ended_at"), "reason")


@query(
    "live_progress",
    f"""WITH {ACTIONS}, i AS (SELECT image_id, arg_max("user", (ts, event_id)) FILTER (action = 'save') AS u FROM acts GROUP BY 1)
    SELECT u AS annotator, count(*) AS done, NULL::BIGINT AS total FROM i WHERE u IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'ALL', count(u), count(*) FROM i""",
)
def _progress(spark, sf):
    events = _stream(spark, fx.annotation_events(spark, sf), "progress")
    return _finish(spark, lambda path, state: jobs.live_progress(events, path, state), "progress")


def _attempts(spark, sf):
    return fx.table(spark, sf, "events").selectExpr("ts", "IF(event_type IN ('purchase', 'view'), 'ok', 'empty') AS status")


@query(
    "fare_rate_windows",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS every, strftime({start}, '%Y-%m-%d %H:%M') AS window_start, count(*) AS attempted,
        count(*) FILTER (event_type IN ('purchase', 'view')) AS with_fares,
        {sql_r6("count(*) FILTER (event_type IN ('purchase', 'view')) / count(*)")} AS fare_rate FROM events GROUP BY 2"""
        for name, start in (("3 hours", "time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2000-01-01')"), ("1 day", "date_trunc('day', ts)"))
    ),
)
def _rates(spark, sf):
    parts = []
    for every in ("3 hours", "1 day"):
        found = _complete(
            spark, sf, _attempts(spark, sf), "rates", lambda s, e=every: jobs.fare_rate_windows(s, every=e)
        )
        parts.append(found.withColumn("every", F.lit(every)))
    both = parts[0].unionByName(parts[1])
    stamp = F.date_format("window_start", "yyyy-MM-dd HH:mm")
    return both.withColumns({"window_start": stamp, "fare_rate": r6("fare_rate")})


@query(
    "stale_alert",
    f"""WITH t AS (SELECT ts + to_hours((user_id % 5 * 3000)::INT) AS ts FROM events),
    g AS (SELECT lag(ts) OVER (ORDER BY ts) AS silent_from, ts AS silent_until FROM t),
    h AS (SELECT *, (epoch_us(silent_until) - epoch_us(silent_from)) / 3600000000 AS hours FROM g)
    SELECT {_ts_sql('silent_from')}, {_ts_sql('silent_until')}, {sql_r6('hours')} AS hours FROM h WHERE h.hours > 2""",
)
def _stale(spark, sf):
    # Users moved apart by months: the months between them are silent.
    quiet = fx.table(spark, sf, "events").selectExpr("ts + make_dt_interval(0, CAST(user_id % 5 * 3000 AS INT)) AS ts")
    found = _complete(spark, sf, quiet, "quiet", jobs.hourly_activity, lambda h: jobs.stale_alert(h, stale_hours=2))
    return found.select(_ts("silent_from"), _ts("silent_until"), r6("hours").alias("hours"))


@query(
    "no_player_default",
    """SELECT 'img_' || (vec_id + 1) || '.jpg' AS image, CASE WHEN vec_id + 1 BETWEEN 251 AND 287 THEN 0 ELSE
    least(20, len(list_filter(embedding, lambda x: x::DOUBLE > 0.1))) END::BIGINT AS count FROM embeddings""",
)
def _defaults(spark, sf):
    images = fx.map_planes(spark, sf).select("image", "count")
    stream = jobs.no_player_default(_stream(spark, images, "images"))
    return _finish(spark, lambda path, state: jobs.run_append(stream, path, state), "images")
