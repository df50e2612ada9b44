"""Pixel, plane, texture, edge and component queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfare.functions.columns import r6
from gridfare.operators import components as comp
from gridfare.operators import planes as pl
from gridfare.plans import fixtures as fx
from gridfare.plans.grid_queries import CELLS
from gridfare.plans.registry import ORACLES, query, sql_r6

CELL = {"cell_height": 4, "cell_width": 4}
KEYS = ["image", "cell_row", "cell_col"]

# ---- oracle views ----

PX = """px AS (
  SELECT 'img_' || (vec_id + 1) || '.jpg' AS image, label AS team, i // 8 AS y, i % 8 AS x,
    floor(least(255, greatest(0, (embedding[i + 1]::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE * 255::DOUBLE))) AS level
  FROM embeddings, range(64) t(i))"""
RGB = f"""{PX}, rgb AS (SELECT *, y // 4 AS cell_row, x // 4 AS cell_col, level::INT AS r, (255 - level)::INT AS g,
  (level * 7 % 256)::INT AS b FROM px),
span AS (SELECT *, greatest(r, g, b) / 255 AS v, least(r, g, b) / 255 AS low FROM rgb),
hsv AS (SELECT * EXCLUDE (low), CASE WHEN v = 0 THEN 0 ELSE (v - low) / v END AS s,
  CASE WHEN v = low THEN 0 ELSE (CASE WHEN b / 255 = v THEN 4 + (r / 255 - g / 255) / (v - low)
    WHEN g / 255 = v THEN 2 + (b / 255 - r / 255) / (v - low) ELSE (g / 255 - b / 255) / (v - low) END) END / 6 AS h6
  FROM span),
pixels AS (SELECT * EXCLUDE (h6), CASE WHEN h6 < 0 THEN h6 + 1 ELSE h6 END AS h FROM hsv)"""


def _mirrored(axis: str, step: str) -> str:
    return f"CASE WHEN {axis} + {step} < 0 THEN -({axis} + {step}) WHEN {axis} + {step} > 7 THEN 14 - {axis} - {step} ELSE {axis} + {step} END"


def _stencil(name: str, source: str, weights: str, value: str) -> str:
    """A view of ``source`` filtered with (dy, dx, w) rows under reflect-101 borders."""
    return f"""{name} AS (SELECT a.image, a.y, a.x, sum(w * b.{value}) AS {name}
      FROM {source} a, (VALUES {weights}) k(dy, dx, w) JOIN {source} b ON b.image = a.image
      AND b.y = {_mirrored('a.y', 'k.dy')} AND b.x = {_mirrored('a.x', 'k.dx')} GROUP BY 1, 2, 3)"""


_TAPS = [1, 4, 6, 4, 1]
_BLUR = ", ".join(f"({i - 2}, {j - 2}, {a * b / 256}::DOUBLE)" for i, a in enumerate(_TAPS) for j, b in enumerate(_TAPS))
_GX = "(-1, 1, 1), (0, 1, 2), (1, 1, 1), (-1, -1, -1), (0, -1, -2), (1, -1, -1)"
_GY = "(1, -1, 1), (1, 0, 2), (1, 1, 1), (-1, -1, -1), (-1, 0, -2), (-1, 1, -1)"
_LAP = "(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4)"
BLURRED = f"{PX}, {_stencil('blurred', 'px', _BLUR, 'level')}"


def _around(dy: int, dx: int) -> str:
    return f"coalesce((SELECT n.m FROM grad n WHERE n.image = g.image AND n.y = g.y + {dy} AND n.x = g.x + {dx}), 0)"


_STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
EDGES = f"""{BLURRED}, {_stencil('gx', 'blurred', _GX, 'blurred')}, {_stencil('gy', 'blurred', _GY, 'blurred')},
{_stencil('lap', 'blurred', _LAP, 'blurred')},
grad AS (SELECT *, abs(gx) + abs(gy) AS m FROM gx JOIN gy USING (image, y, x)),
near AS (SELECT g.image, g.y, g.x, g.gx, g.gy, g.m,
  {', '.join(f"max(CASE WHEN n.y = g.y + {dy} AND n.x = g.x + {dx} THEN n.m ELSE 0 END) AS n{i}" for i, (dy, dx) in enumerate(_STEPS))}
  FROM grad g JOIN grad n ON n.image = g.image AND abs(n.y - g.y) <= 1 AND abs(n.x - g.x) <= 1 GROUP BY ALL),
weak AS (SELECT image, y, x, m FROM near WHERE m > 50 AND CASE
  WHEN abs(gy) < 0.41421356237309503::DOUBLE * abs(gx) THEN m > n3 AND m >= n4
  WHEN abs(gy) > 2.414213562373095::DOUBLE * abs(gx) THEN m > n1 AND m >= n6
  WHEN gx * gy < 0 THEN m > n2 AND m > n5 ELSE m > n0 AND m > n7 END),
kept AS (SELECT image, y, x FROM weak WHERE m > 150 UNION
  SELECT w.image, w.y, w.x FROM kept k JOIN weak w ON w.image = k.image AND abs(w.y - k.y) <= 1 AND abs(w.x - k.x) <= 1),
edge AS (SELECT p.image, p.y, p.x, (k.y IS NOT NULL)::BIGINT AS edge FROM px p LEFT JOIN kept k USING (image, y, x))"""
MAPS = f"""{EDGES}, maps AS (SELECT *, y // 4 AS cell_row, x // 4 AS cell_col, sqrt(gx * gx + gy * gy) AS mag,
  ((degrees(atan2(gy, gx)) + 360) % 180) AS angle FROM grad JOIN lap USING (image, y, x) JOIN edge USING (image, y, x))"""


def _outer(keys: str, low_y: int, high_y: int, low_x: int, high_x: int) -> str:
    """Outer components of view ``fg(keys, y, x)`` on a frame of the given bounds, as ``outer_px(keys, y, x, root)``."""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    on_a = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    on_b = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    return f"""frame AS (SELECT {keys}, y, x FROM (SELECT DISTINCT {keys} FROM fg), range({low_y - 1}, {high_y + 2}) a(y),
      range({low_x - 1}, {high_x + 2}) b(x)),
    bg AS (SELECT * FROM frame EXCEPT SELECT {keys}, y, x FROM fg),
    outside AS (SELECT {keys}, y, x FROM bg WHERE y = {low_y - 1} AND x = {low_x - 1} UNION
      SELECT {on_b}, b.y, b.x FROM outside a JOIN bg b ON {same} AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
    reach AS (SELECT {keys}, y, x, y * 8 + x AS root FROM fg UNION
      SELECT {on_b}, b.y, b.x, a.root FROM reach a JOIN fg b ON {same} AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    rooted AS (SELECT {keys}, y, x, min(root) AS root FROM reach GROUP BY ALL),
    outer_roots AS (SELECT DISTINCT {on_a}, a.root FROM rooted a JOIN outside b
      ON {same} AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
    outer_px AS (SELECT rooted.* FROM rooted SEMI JOIN outer_roots USING ({keys}, root))"""


# ---- pixels and colour ----


def _pixels(spark, sf):
    return pl.assign_cell(pl.explode_pixels(fx.colour_planes(spark, sf), ["r", "g", "b"]), **CELL)


query("explode_pixels", f"WITH {RGB} SELECT image, y, x, r, g, b FROM rgb")(
    lambda spark, sf: pl.explode_pixels(fx.colour_planes(spark, sf).drop("team"), ["r", "g", "b"])
)
query("assign_cell", f"WITH {RGB} SELECT image, y, x, cell_row, cell_col FROM rgb")(
    lambda spark, sf: _pixels(spark, sf).select("image", "y", "x", "cell_row", "cell_col")
)
query(
    "to_gray",
    f"""WITH {RGB} SELECT image, y, x, {sql_r6('(299 * r + 587 * g + 114 * b) / 255000')} AS gray,
    ((299 * r + 587 * g + 114 * b) // 1000)::BIGINT AS gray_level FROM rgb""",
)(
    lambda spark, sf: pl.to_gray(_pixels(spark, sf)).select("image", "y", "x", r6("gray").alias("gray"), "gray_level")
)
query(
    "to_hsv",
    f"WITH {RGB} SELECT image, y, x, {sql_r6('h')} AS h, {sql_r6('s')} AS s, {sql_r6('v')} AS v FROM pixels",
)(
    lambda spark, sf: pl.to_hsv(_pixels(spark, sf)).select("image", "y", "x", *[r6(c).alias(c) for c in "hsv"])
)
_CODES = ["r // 8", "32 + g // 8", "64 + b // 8"] + [
    f"{32 * i} + least(floor({c} * 32), 31)::INT" for i, c in ((3, "h"), (4, "s"), (5, "v"))
]
_HIST = ", ".join(f"count(*) FILTER (code = {k}) AS f{k:03d}" for k in range(192))
_HISTOGRAM_SQL = f"""WITH {RGB}, codes AS (SELECT image, cell_row, cell_col, unnest([{', '.join(_CODES)}]) AS code FROM pixels)
    SELECT image, cell_row, cell_col, {_HIST} FROM codes GROUP BY ALL"""


def _dealt(spark, sf, rows):
    """Rows dealt out by cell, more tasks for more planes: what is counted or joined by cell then needs no other shuffle."""
    return rows.repartition(fx.parts(spark, sf, "embeddings", fx.PLANE_ROWS), *KEYS)


query("colour_histogram", _HISTOGRAM_SQL)(
    lambda spark, sf: pl.colour_histogram(_dealt(spark, sf, _pixels(spark, sf).drop("team")), KEYS)
)


def _moment_sql(c):
    centred = f"({c} - avg({c}) OVER w)"
    return f"{centred} ** 2 AS {c}2, {centred} ** 3 AS {c}3"


_MOMENTS = [f"{c}_{m}" for c in "hsv" for m in ("mean", "std", "skew")]
_MOMENTS_SQL = f"""WITH {RGB}, m AS (SELECT *, {', '.join(_moment_sql(c) for c in 'hsv')} FROM pixels
      WINDOW w AS (PARTITION BY image, cell_row, cell_col))
    SELECT image, cell_row, cell_col, {', '.join(
        f"{sql_r6(f'avg({c})')} AS {c}_mean, {sql_r6(f'stddev_pop({c})')} AS {c}_std, "
        f"CASE WHEN stddev_pop({c}) = 0 THEN 0 ELSE {sql_r6(f'avg({c}3) / avg({c}2) ** 1.5')} END AS {c}_skew"
        for c in 'hsv')} FROM m GROUP BY 1, 2, 3"""
query("colour_moments", _MOMENTS_SQL)(
    lambda spark, sf: pl.colour_moments(_pixels(spark, sf), KEYS).select(*KEYS, *[r6(c).alias(c) for c in _MOMENTS])
)
query(
    "dominant_colour",
    f"""WITH {RGB} SELECT team, count(*) AS pixels, {', '.join(f"{sql_r6(f'avg({c})')} AS mean_{c}" for c in 'rgbhsv')}
    FROM pixels WHERE team > 0 AND h NOT BETWEEN 0.15 AND 0.45 GROUP BY 1""",
)(
    lambda spark, sf: pl.dominant_colour(_pixels(spark, sf), label="team").withColumns(
        {f"mean_{c}": r6(f"mean_{c}") for c in "rgbhsv"}
    )
)
query(
    "colour_shift_profile",
    f"""WITH l AS (SELECT event_type, 'value' AS channel, value AS level FROM events
      UNION ALL SELECT event_type, 'user_id', user_id::DOUBLE FROM events)
    SELECT event_type, channel, {sql_r6('stddev_pop(level)')} AS std, {sql_r6('avg(level)')} AS mean,
      {sql_r6('quantile_cont(level, 0.25)')} AS q25, {sql_r6('quantile_cont(level, 0.75)')} AS q75,
      {sql_r6('quantile_cont(level, 0.75) - quantile_cont(level, 0.25)')} AS iqr FROM l GROUP BY 1, 2""",
)(
    lambda spark, sf: pl.colour_shift_profile(
        fx.table(spark, sf, "events"), "event_type", ["value", "user_id"]
    ).withColumns({c: r6(c) for c in ("std", "mean", "q25", "q75", "iqr")})
)

# ---- texture ----


def _cell_planes(spark, sf):
    return pl.cut_cells(fx.gray_planes(spark, sf).drop("team"), "level", **CELL)


_RING = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
_INCELL = f"""{PX}, cpx AS (SELECT *, y // 4 AS cell_row, x // 4 AS cell_col FROM px)"""
_BITS = ", ".join(
    f"""(coalesce(max(CASE WHEN n.y = c.y + {dy} AND n.x = c.x + {dx} THEN n.level END), 0) >= c.level)::INT AS b{i}"""
    for i, (dy, dx) in enumerate(_RING)
)
_CHANGES = " + ".join(f"abs(b{i} - b{(i + 1) % 8})" for i in range(8))
_ONES = " + ".join(f"b{i}" for i in range(8))
_LBP_SQL = f"""WITH {_INCELL}, bits AS (SELECT c.image, c.cell_row, c.cell_col, c.y, c.x, {_BITS} FROM cpx c JOIN cpx n
      ON c.image = n.image AND c.cell_row = n.cell_row AND c.cell_col = n.cell_col
      GROUP BY c.image, c.cell_row, c.cell_col, c.y, c.x, c.level),
    codes AS (SELECT *, CASE WHEN {_CHANGES} <= 2 THEN {_ONES} ELSE 9 END AS code FROM bits)
    SELECT image, cell_row, cell_col, {', '.join(
        f"{sql_r6(f'count(*) FILTER (code = {k}) / (count(*) + 1e-6)')} AS tex_{k:02d}" for k in range(10))}
    FROM codes GROUP BY 1, 2, 3"""
query("lbp_histogram", _LBP_SQL)(
    lambda spark, sf: pl.lbp_histogram(_cell_planes(spark, sf), KEYS).select(
        *KEYS, *[r6(f"tex_{k:02d}").alias(f"tex_{k:02d}") for k in range(10)]
    )
)
_PROPS = [
    "sum(n * (i - j) ** 2)::DOUBLE / sum(n)",
    "sum(n / (1 + (i - j) ** 2)) / sum(n)",
    "sqrt(sum(n * n)::DOUBLE) / sum(n)",
    """CASE WHEN sum(n * i * i) * sum(n) = sum(n * i) * sum(n * i) THEN 1 ELSE
      (sum(n * i * j) * sum(n) - sum(n * i) * sum(n * j))::DOUBLE
      / (sum(n * i * i) * sum(n) - sum(n * i) * sum(n * i))::DOUBLE END""",
]
query(
    "glcm_features",
    f"""WITH {_INCELL}, pairs AS (SELECT c.image, c.cell_row, c.cell_col, angle, floor(c.level / 8)::BIGINT AS a,
        floor(n.level / 8)::BIGINT AS b FROM cpx c, (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) k(angle, dy, dx)
      JOIN cpx n ON n.image = c.image AND n.cell_row = c.cell_row AND n.cell_col = c.cell_col AND n.y = c.y + dy
        AND n.x = c.x + dx),
    sym AS (SELECT image, cell_row, cell_col, angle, a AS i, b AS j FROM pairs UNION ALL
      SELECT image, cell_row, cell_col, angle, b, a FROM pairs),
    counts AS (SELECT image, cell_row, cell_col, angle, i, j, count(*) AS n FROM sym GROUP BY ALL),
    props AS (SELECT image, cell_row, cell_col, angle, {', '.join(f'{p} AS p{k}' for k, p in enumerate(_PROPS))}
      FROM counts GROUP BY 1, 2, 3, 4)
    SELECT image, cell_row, cell_col, {', '.join(
        f"{sql_r6(f'max(p{k}) FILTER (angle = {a})')} AS tex_{10 + 4 * k + a}" for k in range(4) for a in range(4))}
    FROM props GROUP BY 1, 2, 3""",
)(
    lambda spark, sf: pl.glcm_features(_cell_planes(spark, sf), KEYS).select(
        *KEYS, *[r6(f"tex_{k}").alias(f"tex_{k}") for k in range(10, 26)]
    )
)

# ---- edges ----


def _gray(spark, sf):
    return fx.gray_planes(spark, sf).drop("team")


def _edge_maps(spark, sf):
    return pl.edge_maps(_gray(spark, sf))


query("gaussian_blur", f"WITH {BLURRED} SELECT image, y, x, {sql_r6('blurred')} AS blurred FROM blurred")(
    lambda spark, sf: pl.explode_pixels(
        pl.gaussian_blur(_gray(spark, sf)).drop("level"), ["blurred"]
    ).withColumn("blurred", r6("blurred"))
)
query(
    "sobel",
    f"""WITH {PX}, {_stencil('gx', 'px', _GX, 'level')}, {_stencil('gy', 'px', _GY, 'level')}
    SELECT image, y, x, gx::DOUBLE AS gx, gy::DOUBLE AS gy, {sql_r6('sqrt(gx * gx + gy * gy)')} AS magnitude,
      {sql_r6('(degrees(atan2(gy, gx)) + 360) % 180')} AS angle FROM gx JOIN gy USING (image, y, x)""",
)(
    lambda spark, sf: pl.sobel(_gray(spark, sf), ["image"]).withColumns(
        {"magnitude": r6("magnitude"), "angle": r6("angle")}
    )
)
query(
    "laplacian",
    f"WITH {PX}, {_stencil('laplacian', 'px', _LAP, 'level')} SELECT image, y, x, laplacian + 0.0 AS laplacian FROM laplacian",
)(
    lambda spark, sf: pl.explode_pixels(pl.laplacian(_gray(spark, sf)).drop("level"), ["laplacian"])
)
query("edge_map", f"WITH RECURSIVE {EDGES} SELECT image, y, x, edge FROM edge")(
    lambda spark, sf: pl.explode_pixels(pl.edge_map(_gray(spark, sf)).drop("level"), ["edge"])
)
_STATS = ["f_edge_density", "f_sobel_mean", "f_sobel_std", "f_laplacian_var"]
query(
    "edge_cell_stats",
    f"""WITH RECURSIVE {MAPS} SELECT image, cell_row, cell_col, {sql_r6('avg(edge)')} AS f_edge_density,
      sum(edge)::BIGINT AS f_canny_count, {sql_r6('avg(mag)')} AS f_sobel_mean, {sql_r6('stddev_pop(mag)')} AS f_sobel_std,
      {sql_r6('var_pop(lap)')} AS f_laplacian_var FROM maps GROUP BY 1, 2, 3""",
)(
    lambda spark, sf: pl.edge_cell_stats(_edge_maps(spark, sf), ["image"], **CELL).withColumns(
        {c: r6(c) for c in _STATS}
    )
)
query(
    "external_contour_count",
    f"""WITH RECURSIVE {EDGES}, fg AS (SELECT image, y // 4 AS cell_row, x // 4 AS cell_col, y % 4 AS y, x % 4 AS x
      FROM edge WHERE edge = 1), {_outer('image, cell_row, cell_col', 0, 3, 0, 3)}
    SELECT image, cell_row, cell_col, count(DISTINCT root) AS f_contour_count
    FROM (SELECT DISTINCT image, y // 4 AS cell_row, x // 4 AS cell_col FROM px)
      LEFT JOIN outer_px USING (image, cell_row, cell_col) GROUP BY 1, 2, 3""",
)(lambda spark, sf: pl.external_contour_count(_edge_maps(spark, sf), ["image"], **CELL))
_HOG36 = [f"f_hog_{k:03d}" for k in range(36)]
query(
    "hog_36",
    f"""WITH RECURSIVE {MAPS}, coded AS (SELECT *, (y % 4 // 2 * 2 + x % 4 // 2) AS patch, least(floor(angle / 20), 8)::INT AS bin
      FROM maps), p AS (SELECT image, cell_row, cell_col, patch, bin, mag, sum(mag) OVER (
      PARTITION BY image, cell_row, cell_col, patch) AS whole FROM coded)
    SELECT image, cell_row, cell_col, {', '.join(
        f"{sql_r6(f'coalesce(sum(CASE WHEN whole > 0 THEN mag / whole END) FILTER (patch = {k // 9} AND bin = {k % 9}), 0)')}"
        f" AS f_hog_{k:03d}" for k in range(36))} FROM p GROUP BY 1, 2, 3""",
)(
    lambda spark, sf: pl.hog_36(_edge_maps(spark, sf), ["image"], **CELL).select(
        *KEYS, *[r6(c).alias(c) for c in _HOG36]
    )
)
query(
    "edge_table",
    "SELECT * FROM "
    + " NATURAL JOIN ".join(f"({ORACLES[name]}) t{place}" for place, name in enumerate(("edge_cell_stats", "external_contour_count", "hog_36"))),
)(
    lambda spark, sf: pl.edge_table(_gray(spark, sf), ["image"], **CELL).withColumns(
        {c: r6(c) for c in (*_STATS, *_HOG36)}
    )
)
_CENTRAL = f"""{_INCELL}, diff AS (SELECT c.image, c.cell_row, c.cell_col, c.y, c.x,
  coalesce(max(n.level) FILTER (n.y = c.y + 1 AND n.x = c.x) - max(n.level) FILTER (n.y = c.y - 1 AND n.x = c.x), 0) AS gy,
  coalesce(max(n.level) FILTER (n.x = c.x + 1 AND n.y = c.y) - max(n.level) FILTER (n.x = c.x - 1 AND n.y = c.y), 0) AS gx
  FROM cpx c JOIN cpx n ON c.image = n.image AND c.cell_row = n.cell_row AND c.cell_col = n.cell_col
  GROUP BY 1, 2, 3, 4, 5),
turned AS (SELECT *, sqrt(gx * gx + gy * gy) AS m, least(floor(((degrees(atan2(gy, gx)) + 360) % 180) / 20), 8)::INT AS bin
  FROM diff)"""


def _normed(view: str, keys: str, value: str) -> str:
    return f"""{view}_1 AS (SELECT *, {value} / sqrt(sum({value} ** 2) OVER (PARTITION BY {keys}) + 1e-10) AS u FROM {view}),
    {view}_2 AS (SELECT *, least(u, 0.2::DOUBLE) AS c FROM {view}_1),
    {view}_3 AS (SELECT *, c / sqrt(sum(c ** 2) OVER (PARTITION BY {keys}) + 1e-10) AS q FROM {view}_2)"""


query(
    "hog_9",
    f"""WITH {_CENTRAL}, hist AS (SELECT image, cell_row, cell_col, b AS bin, sum(CASE WHEN bin = b THEN m ELSE 0 END) / 16 AS s
      FROM turned, range(9) r(b) GROUP BY 1, 2, 3, 4), {_normed('hist', 'image, cell_row, cell_col', 's')}
    SELECT image, cell_row, cell_col, {', '.join(f"{sql_r6(f'max(q) FILTER (bin = {k})')} AS hog_bin_{k}" for k in range(9))}
    FROM hist_3 GROUP BY 1, 2, 3""",
)(
    lambda spark, sf: pl.hog_9(_cell_planes(spark, sf), KEYS).select(
        *KEYS, *[r6(f"hog_bin_{k}").alias(f"hog_bin_{k}") for k in range(9)]
    )
)


@query(
    "hog_dense",
    f"""WITH {PX}, diff AS (SELECT c.image, c.y, c.x,
      coalesce(max(n.level) FILTER (n.y = c.y + 1 AND n.x = c.x) - max(n.level) FILTER (n.y = c.y - 1 AND n.x = c.x), 0) AS gy,
      coalesce(max(n.level) FILTER (n.x = c.x + 1 AND n.y = c.y) - max(n.level) FILTER (n.x = c.x - 1 AND n.y = c.y), 0) AS gx
      FROM px c JOIN px n ON c.image = n.image AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 GROUP BY 1, 2, 3),
    turned AS (SELECT *, y // 2 AS sy, x // 2 AS sx, sqrt(gx * gx + gy * gy) AS m,
      least(floor(((degrees(atan2(gy, gx)) + 360) % 180) / 20), 8)::INT AS bin FROM diff),
    squares AS (SELECT image, sy, sx, b AS bin, sum(CASE WHEN bin = b THEN m ELSE 0 END) / 4 AS s
      FROM turned, range(9) r(b) GROUP BY 1, 2, 3, 4),
    blocks AS (SELECT image, sy - dy AS py, sx - dx AS bx, dy, dx, bin, s FROM squares,
      (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx) WHERE sy - dy BETWEEN 0 AND 2 AND sx - dx BETWEEN 0 AND 2),
    {_normed('blocks', 'image, py, bx', 's')}
    SELECT image, (((py * 3 + bx) * 2 + dy) * 2 + dx) * 9 + bin AS pos, {sql_r6('q')} AS value FROM blocks_3""",
)
def _hog_dense(spark, sf):
    dense = pl.hog_dense(_gray(spark, sf), ["image"], size=2)
    rows = dense.select("image", F.posexplode("hog").alias("pos", "value"))
    return rows.select("image", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


_CLOSED = """wide AS (SELECT a.image, a.y, a.x, max(b.edge) AS e FROM edge a JOIN edge b ON a.image = b.image
  AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2, 3),
closed AS (SELECT a.image, a.y, a.x, min(b.e)::BIGINT AS closed FROM wide a JOIN wide b ON a.image = b.image
  AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2, 3)"""
query("morph_close", f"WITH RECURSIVE {EDGES}, {_CLOSED} SELECT image, y, x, closed FROM closed")(
    lambda spark, sf: pl.explode_pixels(
        pl.morph_close(_edge_maps(spark, sf)).select("image", "height", "width", "closed"), ["closed"]
    ).withColumn("closed", F.col("closed").cast("long"))
)
query(
    "contour_summary",
    f"""WITH RECURSIVE {EDGES}, {_CLOSED}, fg AS (SELECT image, y, x FROM closed WHERE closed = 1), {_outer('image', 0, 7, 0, 7)},
    areas AS (SELECT image, root, count(*) AS a FROM outer_px GROUP BY 1, 2),
    e AS (SELECT image, sum(edge)::BIGINT AS n, sum(edge) FILTER (y < 4)::BIGINT AS up FROM edge GROUP BY 1)
    SELECT image, count(a) AS f_raw_contour_count, count(*) FILTER (a BETWEEN 4 AND 40) AS f_filtered_contour_count,
      count(*) FILTER (a > 20) AS f_large_contour_count,
      {sql_r6('coalesce(avg(a) FILTER (a BETWEEN 4 AND 40), 0)')} AS f_mean_contour_area,
      coalesce(max(a) FILTER (a BETWEEN 4 AND 40), 0)::BIGINT AS f_max_contour_area,
      coalesce(sum(a) FILTER (a BETWEEN 4 AND 40), 0)::BIGINT AS f_total_contour_area, n AS f_edge_pixel_count,
      n / 64 AS f_edge_density, up / 32 AS f_upper_half_edge_density, (n - up) / 32 AS f_lower_half_edge_density
    FROM e LEFT JOIN areas USING (image) GROUP BY image, n, up""",
)(
    lambda spark, sf: pl.contour_summary(_edge_maps(spark, sf), ["image"], min_area=4, max_area=40).withColumn(
        "f_mean_contour_area", r6("f_mean_contour_area")
    )
)


def _unpivoted(sql: str, first: int, shift: int) -> str:
    """Numbered columns of a finished oracle as (cell, pos, value) rows; ``first`` is the column number to start at."""
    return f"""SELECT image, cell_row, cell_col, row_number() OVER (PARTITION BY image, cell_row, cell_col ORDER BY name)
      - 1 + {shift} AS pos, value::DOUBLE AS value FROM (UNPIVOT (FROM ({sql}))
      ON COLUMNS(* EXCLUDE (image, cell_row, cell_col)) INTO NAME name VALUE value) WHERE {first}"""


_NAMED_MOMENTS = f"""SELECT image, cell_row, cell_col, {', '.join(f'{m} AS m{i}' for i, m in enumerate(_MOMENTS))}
  FROM ({_MOMENTS_SQL})"""
_CELL_HOG = f"""WITH {_CENTRAL}, squares AS (SELECT image, cell_row, cell_col, y % 4 // 2 AS sy, x % 4 // 2 AS sx, b AS bin,
    sum(CASE WHEN bin = b THEN m ELSE 0 END) / 4 AS s FROM turned, range(9) r(b) GROUP BY 1, 2, 3, 4, 5, 6),
  {_normed('squares', 'image, cell_row, cell_col', 's')}
  SELECT image, cell_row, cell_col, 105 + (sy * 2 + sx) * 9 + bin AS pos, {sql_r6('q')} AS value FROM squares_3"""


@query(
    "feature_export",
    f"""{_unpivoted(_HISTOGRAM_SQL, "name >= 'f096'", 0)}
    UNION ALL {_unpivoted(_NAMED_MOMENTS, 'true', 96)}
    UNION ALL ({_CELL_HOG})
    UNION ALL {_unpivoted(_LBP_SQL, 'true', 141)}""",
)
def _export(spark, sf):
    """Grid cells of 4x4 pixels with their whole vector, one row per value; dense squares of 2x2 pixels."""
    tinted = fx.colour_planes(spark, sf).drop("team")
    pixels = _dealt(spark, sf, pl.assign_cell(pl.explode_pixels(tinted, ["r", "g", "b"]), **CELL))
    crops = _dealt(spark, sf, _cell_planes(spark, sf))
    table = pl.feature_export(
        crops.select(*KEYS),
        pl.colour_histogram(pixels, KEYS),
        pl.colour_moments(pixels, KEYS),
        pl.hog_dense(crops, KEYS, size=2),
        pl.lbp_histogram(crops, KEYS),
    )
    rows = table.select(*KEYS, F.posexplode("features").alias("pos", "value"))
    return rows.select(*KEYS, F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


# ---- components ----

MAP = f"""{CELLS}, maps AS (SELECT *, least(1, greatest(0, v + 0.5::DOUBLE)) AS p FROM cells)"""


def _reach(t: float, suffix: str) -> str:
    return f"""on_{suffix} AS (SELECT image, cell_id, cell_row AS y, cell_col AS x FROM maps WHERE p > {t}::DOUBLE),
    reach_{suffix} AS (SELECT image, cell_id, y, x, cell_id AS root FROM on_{suffix} UNION
      SELECT b.image, b.cell_id, b.y, b.x, a.root FROM reach_{suffix} a JOIN on_{suffix} b ON a.image = b.image
        AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    comp_{suffix} AS (SELECT image, cell_id, min(root) + 1 AS component FROM reach_{suffix} GROUP BY 1, 2)"""


query(
    "grid_components",
    f"""WITH RECURSIVE {MAP}, {_reach(0.5, 'a')} SELECT image, cell_id, coalesce(component, 0) AS component
    FROM cells LEFT JOIN comp_a USING (image, cell_id)""",
)(
    lambda spark, sf: comp.grid_components(fx.map_planes(spark, sf), values="map", above=0.5)
    .select("image", F.posexplode("component").alias("cell_id", "component"))
    .withColumn("cell_id", F.col("cell_id").cast("long"))
)


def _sizes(suffix: str) -> str:
    return f"""size_{suffix} AS (SELECT image, component, count(*) AS n, row_number() OVER (PARTITION BY image
      ORDER BY count(*) DESC, component) AS rn FROM comp_{suffix} GROUP BY 1, 2),
    stat_{suffix} AS (SELECT image, sum(n)::BIGINT AS occ, count(*) AS k, max(n) AS top, max(n) FILTER (rn = 2) AS second,
      avg(n) AS mean FROM size_{suffix} GROUP BY 1)"""


_T = {"t030": 0.3, "t050": 0.5, "t070": 0.7}
_STATS_CTE = ", ".join(f"{_reach(t, n)}, {_sizes(n)}" for n, t in _T.items())
_STATS_COLS = ", ".join(
    f"""coalesce(stat_{n}.occ, 0) AS f_occ_cells_{n}, coalesce(stat_{n}.k, 0) AS f_component_count_{n},
    coalesce(stat_{n}.top, 0) AS f_largest_component_{n}, coalesce(stat_{n}.second, 0) AS f_second_largest_component_{n},
    {sql_r6(f'coalesce(stat_{n}.mean, 0)')} AS f_mean_component_size_{n}"""
    for n in _T
)
_STATS_JOIN = " ".join(f"LEFT JOIN stat_{n} USING (image)" for n in _T)


def _rounded(df):
    names = [c for c in df.columns if c.startswith("f_mean_component") or c in comp.STAT_FEATURES]
    return df.withColumns({c: r6(c) for c in names})


query(
    "component_stats",
    f"""WITH RECURSIVE {MAP}, {_STATS_CTE} SELECT image, {_STATS_COLS} FROM (SELECT DISTINCT image FROM cells) {_STATS_JOIN}""",
)(lambda spark, sf: _rounded(comp.component_stats(fx.map_planes(spark, sf), ["image"])))
_MAP_STATS = f"""{sql_r6('sum(p)')} AS f_sum_player_prob, {sql_r6('avg(p)')} AS f_mean_player_prob,
  {sql_r6('max(p)')} AS f_max_player_prob, {sql_r6('stddev_pop(p)')} AS f_std_player_prob"""
query("map_stats", f"WITH {MAP} SELECT image, {_MAP_STATS} FROM maps GROUP BY 1")(
    lambda spark, sf: _rounded(comp.map_stats(fx.map_planes(spark, sf))).select("image", *comp.STAT_FEATURES)
)
_OCC = ", ".join(
    [f"count(*) FILTER (p > 0.5 AND cell_row = {r}) AS f_row_{r}_occ" for r in range(8)]
    + [f"count(*) FILTER (p > 0.5 AND cell_col = {c}) AS f_col_{c}_occ" for c in range(8)]
    + [
        "count(*) FILTER (p > 0.5 AND cell_row < 4) AS f_upper_half_occ",
        "count(*) FILTER (p > 0.5 AND cell_row >= 4) AS f_lower_half_occ",
        "count(*) FILTER (p > 0.5 AND cell_row BETWEEN 1 AND 6) AS f_middle_rows_occ",
    ]
)
query("map_occupancy", f"WITH {MAP} SELECT image, {_OCC} FROM maps GROUP BY 1")(
    lambda spark, sf: comp.map_occupancy(fx.map_planes(spark, sf)).select("image", *comp.OCCUPANCY_FEATURES)
)
_TABLE = f"""f AS (SELECT image, count, fold_id, {_MAP_STATS}, {_OCC} FROM maps GROUP BY 1, 2, 3)
  SELECT f.*, {_STATS_COLS} FROM f {_STATS_JOIN}"""
query("count_feature_table", f"WITH RECURSIVE {MAP}, {_STATS_CTE}, {_TABLE}")(
    lambda spark, sf: _rounded(comp.count_feature_table(fx.map_planes(spark, sf), ["image", "count", "fold_id"]))
)
_SUBSET = f"""{CELLS}, maps AS (SELECT *, CASE WHEN cell_row BETWEEN 1 AND 6 THEN least(1, greatest(0, v + 0.5::DOUBLE))
  ELSE 0 END AS p FROM cells)"""
query("subset_map", f"WITH RECURSIVE {_SUBSET}, {_STATS_CTE}, {_TABLE}")(
    lambda spark, sf: _rounded(
        comp.count_feature_table(comp.subset_map(fx.map_planes(spark, sf), 1, 6), ["image", "count", "fold_id"])
    )
)
query(
    "assemble_map",
    f"WITH {MAP} SELECT image, cell_id AS pos, {sql_r6('p')} AS p FROM maps",
)(
    lambda spark, sf: comp.assemble_map(fx.maps(spark, sf), ["image"])
    .select("image", F.posexplode("map").alias("pos", "p"))
    .select("image", F.col("pos").cast("long").alias("pos"), r6("p").alias("p"))
)
