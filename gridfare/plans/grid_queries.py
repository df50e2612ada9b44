"""Grid reshaping, merge, check and exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfare.functions.columns import r6
from gridfare.operators import checks, explore, grid, merge
from gridfare.plans import fixtures as fx
from gridfare.plans.registry import query, sql_r6
from gridfare.schemas import CELL_NAMES, TEAMS
from gridfare.session import scratch_path
from gridfare.sources import annotations as notes

CELLS = """cells AS (
  SELECT image, image_num, split, least(20, sum((label > 0)::INT) OVER (PARTITION BY image))::BIGINT AS count,
    cell_id, cell_id + 1 AS cell_num, 'c' || lpad((cell_id + 1)::VARCHAR, 2, '0') AS cell_name,
    cell_id // 8 AS cell_row, cell_id % 8 AS cell_col, label, (label > 0)::BIGINT AS player_present, v,
    (image_num % 4 + 1)::BIGINT
      AS fold_id
  FROM (SELECT 'img_' || (vec_id + 1) || '.jpg' AS image, vec_id + 1 AS image_num,
      CASE WHEN vec_id % 5 = 0 THEN 'Test' ELSE 'Train' END AS split, i AS cell_id, embedding[i + 1]::DOUBLE AS v,
      CASE WHEN embedding[i + 1]::DOUBLE > 0.1 THEN (label + i // 24) % 10 + 1 ELSE 0 END::BIGINT AS label
    FROM embeddings, range(64) t(i)))"""
KEY = "image, cell_num"


def _cells(spark, sf, *columns):
    rows = fx.cells(spark, sf)
    return rows.select(*columns) if columns else rows


# ---- sources and exports ----


@query(
    "read_annotations",
    f"WITH {CELLS} SELECT image, split, count::INT AS count, cell_name, label::INT AS label FROM cells",
)
def _read(spark, sf):
    path = scratch_path(spark, "annotations")
    names = {"image": "Image File Name", "split": "Train Or Test"}
    fx.wide(spark, sf).withColumnsRenamed(names).write.option("header", True).csv(path)
    return notes.read_annotations(spark, path).unpivot(["image", "split", "count"], CELL_NAMES, "cell_name", "label")


_PIVOT = ", ".join(f"max(label) FILTER (cell_id = {i}) AS {c}" for i, c in enumerate(CELL_NAMES))


query(
    "export_annotations_csv",
    f"WITH {CELLS} SELECT image, split, count, {_PIVOT} FROM cells GROUP BY image, split, count",
)(lambda spark, sf: notes.export_annotations_csv(_cells(spark, sf)))


@query(
    "export_annotations_json",
    f"""WITH {CELLS}, r AS (SELECT image, split, cell_row, string_agg(label::VARCHAR, ',' ORDER BY cell_col) AS line
      FROM cells GROUP BY ALL)
    SELECT image, split, string_agg(line, ';' ORDER BY cell_row) AS labels,
      replace(string_agg(line, ',' ORDER BY cell_row), ';', ',') AS features FROM r GROUP BY ALL""",
)
def _json(spark, sf):
    path = scratch_path(spark, "annotations-json")
    notes.export_annotations_json(_cells(spark, sf)).write.json(path)
    shape = "image string, split string, labels array<array<int>>, features array<int>"
    back = spark.read.schema(shape).json(path)
    return back.select(
        "image",
        "split",
        F.expr("array_join(transform(labels, r -> array_join(r, ',')), ';')").alias("labels"),
        F.array_join("features", ",").alias("features"),
    )


# ---- reshaping ----

query("unpivot_cells", f"WITH {CELLS} SELECT image, split, cell_name, cell_num, label::INT AS label FROM cells")(
    lambda spark, sf: grid.unpivot_cells(fx.wide(spark, sf).drop("count"))
)
query("cell_coordinates", f"WITH {CELLS} SELECT {KEY}, cell_id, cell_row, cell_col FROM cells")(
    lambda spark, sf: grid.cell_coordinates(_cells(spark, sf, "image", "cell_num"))
)
query(
    "cell_bounds",
    f"""WITH {CELLS} SELECT image, cell_row, cell_col, cell_col * 100 AS x_min, cell_row * 75 AS y_min,
    cell_col * 100 + 100 AS x_max, cell_row * 75 + 75 AS y_max FROM cells""",
)(lambda spark, sf: grid.cell_bounds(_cells(spark, sf, "image", "cell_row", "cell_col")))
query(
    "cell_position_features",
    f"""WITH {CELLS} SELECT {KEY}, {sql_r6('cell_row / 7')} AS f_row_norm, {sql_r6('cell_col / 7')} AS f_col_norm,
    {sql_r6('(cell_col + 0.5::DOUBLE) / 8')} AS f_center_x, {sql_r6('(cell_row + 0.5::DOUBLE) / 8')} AS f_center_y
    FROM cells""",
)(
    lambda spark, sf: grid.cell_position_features(_cells(spark, sf)).select(
        "image", "cell_num", *[r6(c).alias(c) for c in ("f_row_norm", "f_col_norm", "f_center_x", "f_center_y")]
    )
)
query("player_present", f"WITH {CELLS} SELECT {KEY}, label, player_present FROM cells")(
    lambda spark, sf: grid.player_present(_cells(spark, sf, "image", "cell_num", "label"))
)
_HOT = ", ".join(f"(cell_{a} = {i})::BIGINT AS f_{a}_{i}" for a in ("row", "col") for i in range(8))
query("one_hot_row_col", f"WITH {CELLS} SELECT {KEY}, {_HOT} FROM cells")(
    lambda spark, sf: grid.one_hot_row_col(_cells(spark, sf, "image", "cell_num", "cell_row", "cell_col")).drop(
        "cell_row", "cell_col"
    )
)
query("image_number", f"WITH {CELLS} SELECT DISTINCT image, image_num FROM cells")(
    lambda spark, sf: grid.image_number(fx.planes(spark, sf).select("image"))
)
query(
    "assign_fold",
    """SELECT 'img_' || (vec_id + 1) || '.jpg' AS image, CASE WHEN vec_id < 250 THEN 1 WHEN vec_id < 500 THEN 2
    WHEN vec_id < 750 THEN 3 ELSE 4 END::BIGINT AS fold_id FROM embeddings""",
)(
    lambda spark, sf: grid.assign_fold(grid.image_number(fx.planes(spark, sf).select("image"))).drop("image_num")
)
_TEAM = " ".join(f"WHEN {k} THEN '{v}'" for k, v in TEAMS.items())
query("team_names", f"WITH {CELLS} SELECT {KEY}, label * 2 AS label, CASE label * 2 {_TEAM} END AS team FROM cells")(
    lambda spark, sf: grid.team_names(
        _cells(spark, sf).select("image", "cell_num", (F.col("label") * 2).alias("label"))
    )
)
query("rebase_indices", f"WITH {CELLS} SELECT image, cell_row, cell_col FROM cells")(
    lambda spark, sf: grid.rebase_indices(
        _cells(spark, sf).select("image", (F.col("cell_row") + 1).alias("cell_row"), (F.col("cell_col") + 1).alias("cell_col"))
    )
)


@query(
    "grid_matrix",
    """SELECT vec_id, r AS cell_row, array_to_string(list_transform(embedding[r * 8 + 1 : r * 8 + 8],
      lambda x: (floor(x::DOUBLE * 1000))::BIGINT), ',') AS line FROM embeddings, range(8) t(r)""",
)
def _matrix(spark, sf):
    rows = grid.grid_matrix(fx.planes(spark, sf), "v").select("vec_id", F.posexplode("matrix").alias("r", "line"))
    whole = F.transform("line", lambda x: F.floor(x * 1000))
    return rows.select("vec_id", F.col("r").cast("long").alias("cell_row"), F.array_join(whole, ",").alias("line"))


query(
    "dominant_label",
    f"""WITH {CELLS}, n AS (SELECT image, label, count(*) AS cells FROM cells GROUP BY 1, 2)
    SELECT image, label, cells FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY cells DESC, label) AS rn
      FROM n) WHERE rn = 1""",
)(lambda spark, sf: grid.dominant_label(_cells(spark, sf)))
query(
    "image_group",
    """SELECT 'img_' || (vec_id + 1) || '.jpg' AS image, CASE WHEN vec_id + 1 < 251 THEN 'batch_1'
    WHEN vec_id + 1 <= 287 THEN 'no_player' ELSE 'batch_2' END AS image_group FROM embeddings""",
)(
    lambda spark, sf: grid.image_group(fx.planes(spark, sf).select("image", "image_num")).drop("image_num")
)
query(
    "melt_features",
    """SELECT p_brand, 'p_size' AS feature, p_size::DOUBLE AS value FROM part
    UNION ALL SELECT p_brand, 'p_retailprice', p_retailprice FROM part""",
)(
    lambda spark, sf: grid.melt_features(fx.table(spark, sf, "part"), ["p_size", "p_retailprice"], by="p_brand")
)
query(
    "bin_region",
    f"""WITH {CELLS} SELECT {KEY}, CASE WHEN cell_row < 2 THEN 'upper' WHEN cell_row < 6 THEN 'middle' ELSE 'lower' END
    AS region FROM cells""",
)(lambda spark, sf: grid.bin_region(_cells(spark, sf, "image", "cell_num", "cell_row")).drop("cell_row"))


@query("feature_columns", "SELECT unnest(['f_center_x', 'f_center_y', 'f_col_norm', 'f_row_norm']) AS feature, "
       "(SELECT count(*) * 64 FROM embeddings) AS known")
def _feature_columns(spark, sf):
    cells = grid.cell_position_features(fx.cells(spark, sf))
    chosen = grid.feature_columns(cells, exclude=["fold_id"])
    return cells.agg(*[F.count(c).alias(c) for c in chosen]).unpivot([], chosen, "feature", "known")


# ---- merge ----


def _feature_sets(spark, sf):
    """The cell table split in three: colour for all, texture 1-based and lacking negative cells, edge lacking some."""
    cells = fx.cells(spark, sf)
    key = ["image", "cell_row", "cell_col"]
    colour = cells.select(*key, "label", "split", F.round(F.col("v") * 2, 6).alias("f000"))
    texture = cells.where("v > -0.2").select(
        "image",
        (F.col("cell_row") + 1).alias("cell_row"),
        (F.col("cell_col") + 1).alias("cell_col"),
        F.when(F.col("v") > 0.3, F.col("label") + 1).otherwise(F.col("label")).alias("label"),
        F.when(F.col("v") > 0, F.col("split")).alias("split"),
        F.round(F.col("v") * 3, 6).alias("tex_00"),
    )
    edge = cells.where("v < 0.35").select(*key, "label", "split", F.round(F.col("v") * 4, 6).alias("f_edge"))
    return colour, texture, edge


@query(
    "merge_features",
    f"""WITH {CELLS} SELECT image, cell_row, cell_col, label, split, {sql_r6('v * 2')} AS f000,
      CASE WHEN v > -0.2 THEN {sql_r6('v * 3')} END AS tex_00, CASE WHEN v < 0.35 THEN {sql_r6('v * 4')} END AS f_edge,
      count, CASE WHEN image_num <= 250 THEN 1 WHEN image_num <= 500 THEN 2 WHEN image_num <= 750 THEN 3 ELSE 4
      END::BIGINT AS fold_id FROM cells""",
)
def _merge(spark, sf):
    annotations = fx.wide(spark, sf).select("image", F.col("count").cast("long").alias("count"))
    return merge.merge_features(*_feature_sets(spark, sf), annotations)


@query(
    "merge_match_report",
    f"""WITH {CELLS} SELECT image, cell_row, cell_col, 'texture' AS missing_in FROM cells WHERE NOT v > -0.2
    UNION ALL SELECT image, cell_row, cell_col, 'edge' FROM cells WHERE NOT v < 0.35""",
)
def _match(spark, sf):
    colour, texture, edge = _feature_sets(spark, sf)
    return merge.merge_match_report(colour, {"texture": grid.rebase_indices(texture), "edge": edge})


@query(
    "merge_conflicts",
    f"""WITH {CELLS}, s AS (SELECT image, cell_row, cell_col, label::VARCHAR AS label, split FROM cells
      UNION ALL SELECT image, cell_row, cell_col, (label + (v > 0.3)::INT)::VARCHAR, CASE WHEN v > 0 THEN split END
      FROM cells WHERE v > -0.2
      UNION ALL SELECT image, cell_row, cell_col, label::VARCHAR, split FROM cells WHERE v < 0.35),
    g AS (SELECT image, cell_row, cell_col, 'label' AS field, min(label) AS low, max(label) AS high,
        count(*) - count(label) AS nulls, count(label) AS known FROM s GROUP BY ALL
      UNION ALL SELECT image, cell_row, cell_col, 'split', min(split), max(split), count(*) - count(split), count(split)
        FROM s GROUP BY ALL)
    SELECT image, cell_row, cell_col, field, low, high, nulls FROM g WHERE low <> high OR (nulls > 0 AND known > 0)""",
)
def _conflicts(spark, sf):
    colour, texture, edge = _feature_sets(spark, sf)
    tables = {"colour": colour, "texture": grid.rebase_indices(texture), "edge": edge}
    return merge.merge_conflicts(tables, ["label", "split"])


@query(
    "label_audit",
    f"""WITH {CELLS} SELECT 'colour' AS left_table, 'texture' AS right_table,
      count(*) FILTER (v > -0.2 AND v <= 0.3) AS same, count(*) FILTER (v > 0.3) AS different,
      count(*) FILTER (NOT v > -0.2) AS left_only, 0::BIGINT AS right_only FROM cells
    UNION ALL SELECT 'colour', 'edge', count(*) FILTER (v < 0.35), 0, count(*) FILTER (NOT v < 0.35), 0 FROM cells
    UNION ALL SELECT 'texture', 'edge', count(*) FILTER (v > -0.2 AND v <= 0.3), count(*) FILTER (v > 0.3 AND v < 0.35),
      count(*) FILTER (NOT v < 0.35), count(*) FILTER (NOT v > -0.2) FROM cells""",
)
def _audit(spark, sf):
    colour, texture, edge = _feature_sets(spark, sf)
    return merge.label_audit({"colour": colour, "texture": grid.rebase_indices(texture), "edge": edge})


# ---- checks ----

@query(
    "check_required_columns",
    """SELECT unnest(['f_center_x', 'f_center_y']) AS missing, (SELECT count(*) * 64 FROM embeddings) AS n_rows""",
)
def _required(spark, sf):
    cells = fx.cells(spark, sf)
    lacking = checks.check_required_columns(cells)
    return cells.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array(*map(F.lit, lacking))).alias("missing"), "n_rows")


query("drop_image_number", f"WITH {CELLS} SELECT image, cell_num FROM cells")(
    lambda spark, sf: merge.drop_image_number(_cells(spark, sf, "image", "cell_num", "image_num"))
)
query("check_binary_domain", "SELECT n_chars, count(*) AS n FROM documents WHERE n_chars NOT IN (0, 1) GROUP BY 1")(
    lambda spark, sf: checks.check_binary_domain(fx.table(spark, sf, "documents"), "n_chars")
)
query(
    "check_cells_per_image",
    f"""WITH {CELLS}, k AS (SELECT CASE WHEN v >= 0.3 AND split = 'Train' THEN 'stray_' || image ELSE image END AS image
      FROM cells) SELECT image, count(*) AS cells FROM k GROUP BY 1 HAVING count(*) <> 64""",
)(
    lambda spark, sf: checks.check_cells_per_image(
        _cells(spark, sf).withColumn("image", F.expr("IF(v >= 0.3D AND split = 'Train', concat('stray_', image), image)"))
    )
)
query(
    "check_single_fold",
    f"""WITH {CELLS}, f AS (SELECT image, CASE WHEN v > 0.45 THEN 5 ELSE fold_id END::BIGINT AS fold_id FROM cells)
    SELECT image, min(fold_id) AS low, max(fold_id) AS high FROM f GROUP BY 1 HAVING min(fold_id) <> max(fold_id)""",
)(
    lambda spark, sf: checks.check_single_fold(
        _cells(spark, sf).withColumn("fold_id", F.when(F.col("v") > 0.45, F.lit(5)).otherwise(F.col("fold_id")))
    )
)
query(
    "check_constant_count",
    """SELECT l_orderkey, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1
    HAVING count(DISTINCT l_quantity) > 1""",
)(
    lambda spark, sf: checks.check_constant_count(fx.table(spark, sf, "lineitem"), image="l_orderkey", count="l_quantity")
)
query(
    "count_grid_agreement",
    f"""WITH {CELLS}, c AS (SELECT image, label, CASE WHEN image_num % 3 = 0 THEN 0 ELSE count END AS count FROM cells)
    SELECT image, max(count)::BIGINT AS count, count(*) FILTER (label > 0) AS active FROM c GROUP BY 1
    HAVING (max(count) = 0) <> (count(*) FILTER (label > 0) = 0)""",
)(
    lambda spark, sf: checks.count_grid_agreement(
        _cells(spark, sf).withColumn("count", F.when(F.col("image_num") % 3 == 0, F.lit(0)).otherwise(F.col("count")))
    )
)
query("edge_row_labels", f"WITH {CELLS} SELECT image, cell_col, label FROM cells WHERE cell_row = 0 AND label > 0")(
    lambda spark, sf: checks.edge_row_labels(_cells(spark, sf)).select("image", "cell_col", "label")
)
query(
    "isolated_cells",
    f"""WITH {CELLS} SELECT a.image, a.cell_row, a.cell_col, a.label FROM cells a WHERE a.label > 0 AND NOT EXISTS (
      SELECT 1 FROM cells b WHERE b.image = a.image AND b.label = a.label AND b.cell_id <> a.cell_id
      AND abs(b.cell_row - a.cell_row) <= 1 AND abs(b.cell_col - a.cell_col) <= 1)""",
)(lambda spark, sf: checks.isolated_cells(_cells(spark, sf)))
query(
    "missing_counts",
    """SELECT unnest(['event_id', 'user_id', 'value', 'kind']) AS "column",
    unnest([0, 0, count(*) FILTER (value > 20), count(*) FILTER (event_type = 'click')])::BIGINT AS missing FROM events""",
)(
    lambda spark, sf: checks.missing_counts(
        fx.table(spark, sf, "events").selectExpr(
            "event_id",
            "user_id",
            "IF(value > 20, double('NaN'), value) AS value",
            "nullif(event_type, 'click') AS kind",
        )
    )
)
query(
    "duplicate_rows",
    """WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang) SELECT sum(n)::BIGINT AS n_rows,
    sum(n - 1)::BIGINT AS duplicates, count(*) FILTER (n > 1) AS repeated_groups FROM g""",
)(lambda spark, sf: checks.duplicate_rows(fx.table(spark, sf, "documents"), ["text", "lang"]))

# ---- exploration ----

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
query(
    "min_max_range",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", min({c}) + 0.0 AS "min", max({c}) AS "max", {sql_r6(f'max({c}) - min({c})')} AS "range"
        FROM lineitem"""
        for c in _LINE
    ),
)(
    lambda spark, sf: explore.min_max_range(fx.table(spark, sf, "lineitem"), _LINE).withColumns(
        {"range": r6("range"), "min": F.col("min") + F.lit(0.0)}
    )
)
query("images_per_fold", f"WITH {CELLS} SELECT fold_id, count(DISTINCT image) AS images FROM cells GROUP BY 1")(
    lambda spark, sf: explore.images_per_fold(_cells(spark, sf))
)
query(
    "image_stats",
    f"""WITH {CELLS} SELECT image, min(count) AS count, min(fold_id) AS fold_id,
    sum(player_present)::BIGINT AS player_cells FROM cells GROUP BY 1""",
)(lambda spark, sf: explore.image_stats(_cells(spark, sf)))
_HEAT = ", ".join(
    f"{sql_r6(f'coalesce(avg(player_present) FILTER (cell_col = {c}), 0)')} AS col_{c}" for c in range(8)
)
query("occupancy_heatmap", f"WITH {CELLS} SELECT cell_row, {_HEAT} FROM cells GROUP BY 1")(
    lambda spark, sf: explore.occupancy_heatmap(_cells(spark, sf)).select(
        "cell_row", *[r6(f"col_{c}").alias(f"col_{c}") for c in range(8)]
    )
)
_AXES = {
    "row": "cell_row::VARCHAR",
    "col": "cell_col::VARCHAR",
    "region": "CASE WHEN cell_row < 2 THEN 'upper' WHEN cell_row < 6 THEN 'middle' ELSE 'lower' END",
    "fold": "fold_id::VARCHAR",
}
query(
    "occupancy_by_axis",
    f"WITH {CELLS} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS axis, {e} AS value, {sql_r6('avg(player_present)')} AS mean_presence, count(*) AS cells "
        f"FROM cells GROUP BY 2"
        for a, e in _AXES.items()
    ),
)(
    lambda spark, sf: explore.occupancy_by_axis(_cells(spark, sf)).withColumn("mean_presence", r6("mean_presence"))
)
query(
    "class_balance",
    f"""SELECT quality AS value, n, {sql_r6('n / sum(n) OVER ()')} AS share,
    {sql_r6('min(n) OVER () / max(n) OVER ()')} AS minority_ratio
    FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)""",
)(
    lambda spark, sf: explore.class_balance(fx.table(spark, sf, "labels"), "quality").withColumns(
        {"share": r6("share"), "minority_ratio": r6("minority_ratio")}
    )
)
query(
    "count_cell_corr",
    f"""WITH {CELLS} SELECT {sql_r6('corr(count, cells)')} AS corr FROM (
      SELECT image, min(count) AS count, sum(player_present) AS cells FROM cells GROUP BY 1)""",
)(
    lambda spark, sf: explore.count_cell_corr(explore.image_stats(_cells(spark, sf))).select(r6("corr").alias("corr"))
)
_CORR = [*_LINE, "l_linenumber", "l_partkey"]
query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {sql_r6(f'corr({a}, {b})')} AS corr FROM lineitem"
        for i, a in enumerate(_CORR)
        for b in _CORR[:i]
    ),
)(
    lambda spark, sf: explore.correlation_matrix(fx.table(spark, sf, "lineitem"), _CORR).withColumn("corr", r6("corr"))
)


def _skew_sql(c):
    centred = f"({c} - (SELECT avg({c}) FROM e))"
    return (
        f"SELECT '{c}' AS \"column\", {sql_r6(f'avg({centred} ** 3) / avg({centred} ** 2) ** 1.5')} AS skew, "
        f"count(*) - count({c}) AS missing, min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\", "
        f"(max({c}) - min({c}))::DOUBLE AS \"range\", "
        f"abs(avg({centred} ** 3) / avg({centred} ** 2) ** 1.5) > 1 AS high FROM e"
    )


query(
    "skewness_report",
    "WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'click' THEN floor(value) END AS worth, "
    "floor(value) * floor(value) * floor(value) AS cube FROM events) "
    + " UNION ALL ".join(_skew_sql(c) for c in ("user_id", "worth", "cube")),
)(
    lambda spark, sf: explore.skewness_report(
        fx.table(spark, sf, "events").selectExpr(
            "user_id",
            "IF(event_type <> 'click', floor(value), NULL) AS worth",
            "floor(value) * floor(value) * floor(value) AS cube",
        ),
        ["user_id", "worth", "cube"],
        limit=1.0,
    ).withColumn("skew", r6("skew"))
)


def _quartiles(column):
    return ", ".join(
        f"{sql_r6(f'quantile_cont({column}, {q})')} AS {n}" for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))
    )


_QS = ("q25", "median", "q75")
query(
    "describe_counts",
    f"""SELECT count(o_totalprice) AS n, {sql_r6('avg(o_totalprice)')} AS mean, {sql_r6('stddev_samp(o_totalprice)')} AS std,
    min(o_totalprice) AS "min", max(o_totalprice) AS "max", {_quartiles('o_totalprice')} FROM orders""",
)(
    lambda spark, sf: explore.describe_counts(fx.table(spark, sf, "orders"), "o_totalprice").withColumns(
        {c: r6(c) for c in ("mean", "std", *_QS)}
    )
)
query(
    "fold_boxplot",
    f"""SELECT l_linenumber, min(l_extendedprice) AS low, max(l_extendedprice) AS high, {_quartiles('l_extendedprice')}
    FROM lineitem GROUP BY 1""",
)(
    lambda spark, sf: explore.fold_boxplot(
        fx.table(spark, sf, "lineitem"), "l_linenumber", "l_extendedprice"
    ).withColumns({c: r6(c) for c in _QS})
)
query(
    "count_histogram",
    f"""WITH e AS (SELECT min(o_custkey)::DOUBLE AS lo, (max(o_custkey) - min(o_custkey)) / 15 AS w FROM orders),
    c AS (SELECT least(floor((o_custkey - lo) / w), 14)::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1)
    SELECT b AS bin, {sql_r6('lo + b * w')} AS "left", {sql_r6('lo + (b + 1) * w')} AS "right", coalesce(n, 0) AS n
    FROM e, range(15) r(b) LEFT JOIN c ON c.bin = b""",
)(
    lambda spark, sf: explore.count_histogram(fx.table(spark, sf, "orders"), "o_custkey").withColumns(
        {"left": r6("left"), "right": r6("right")}
    )
)
query(
    "class_distributions",
    f"""WITH m AS (SELECT p_brand, 'p_size' AS feature, p_size::DOUBLE AS value FROM part
      UNION ALL SELECT p_brand, 'p_retailprice', p_retailprice FROM part)
    SELECT p_brand, feature, count(value) AS n, min(value) AS low, max(value) AS high, {_quartiles('value')}
    FROM m GROUP BY 1, 2""",
)(
    lambda spark, sf: explore.class_distributions(
        fx.table(spark, sf, "part"), ["p_size", "p_retailprice"], by="p_brand"
    ).withColumns({c: r6(c) for c in _QS})
)
query(
    "team_presence",
    f"WITH {CELLS} SELECT label, count(DISTINCT image) AS images FROM cells WHERE label <> 0 GROUP BY 1",
)(lambda spark, sf: explore.team_presence(_cells(spark, sf)))
query(
    "team_heatmaps",
    f"WITH {CELLS} SELECT label, cell_row, cell_col, count(*) AS n FROM cells WHERE label <> 0 GROUP BY 1, 2, 3",
)(lambda spark, sf: explore.team_heatmaps(_cells(spark, sf)))
query(
    "team_cooccurrence",
    f"""WITH {CELLS}, t AS (SELECT DISTINCT image, label FROM cells WHERE label <> 0),
    k AS (SELECT image, count(t.label) AS n FROM (SELECT DISTINCT image FROM cells) LEFT JOIN t USING (image) GROUP BY 1)
    SELECT 'pair' AS kind, a.label AS team_a, b.label AS team_b, count(*) AS images FROM t a JOIN t b
      ON a.image = b.image AND a.label < b.label GROUP BY 2, 3
    UNION ALL SELECT 'single', NULL, NULL, count(*) FILTER (n = 1) FROM k
    UNION ALL SELECT 'none', NULL, NULL, count(*) FILTER (n = 0) FROM k""",
)(lambda spark, sf: explore.team_cooccurrence(_cells(spark, sf)))
query(
    "split_alignment",
    f"""WITH {CELLS}, b AS (SELECT 'team' AS kind, label AS value, split FROM cells WHERE label <> 0
      UNION ALL SELECT 'count', min(count), split FROM cells GROUP BY image, split),
    n AS (SELECT kind, value, count(*) FILTER (split = 'Train') AS train, count(*) FILTER (split = 'Test') AS test
      FROM b GROUP BY 1, 2),
    s AS (SELECT kind, value, train / sum(train) OVER k AS a, test / sum(test) OVER k AS z FROM n
      WINDOW k AS (PARTITION BY kind))
    SELECT kind, value, {sql_r6('a')} AS train_share, {sql_r6('z')} AS test_share, {sql_r6('a - z')} AS difference FROM s""",
)(
    lambda spark, sf: explore.split_alignment(_cells(spark, sf)).withColumns(
        {c: r6(c) for c in ("train_share", "test_share", "difference")}
    )
)
query(
    "split_summary",
    f"""WITH {CELLS} SELECT coalesce(split, 'Total') AS split, count(DISTINCT image) AS images, count(*) AS n_rows,
    {sql_r6('count(*) / (SELECT count(*) FROM cells) * 100')} AS percent FROM cells GROUP BY ROLLUP (split)""",
)(lambda spark, sf: explore.split_summary(_cells(spark, sf)).withColumn("percent", r6("percent")))
query(
    "hotspot",
    f"""WITH {CELLS}, a AS (SELECT 'row' AS axis, cell_row AS "at", avg(player_present) AS p FROM cells GROUP BY 2
      UNION ALL SELECT 'col', cell_col, avg(player_present) FROM cells GROUP BY 2)
    SELECT axis, "at", {sql_r6('p')} AS presence FROM (
      SELECT *, row_number() OVER (PARTITION BY axis ORDER BY p DESC, "at") AS rn FROM a) WHERE rn = 1""",
)(lambda spark, sf: explore.hotspot(_cells(spark, sf)).withColumn("presence", r6("presence")))

ACTIONS = """acts AS (SELECT event_id, ts, user_id AS image_id, 'u' || (event_id % 5) AS "user",
    CASE event_type WHEN 'signup' THEN 'lock' WHEN 'click' THEN 'heartbeat' WHEN 'view' THEN 'save'
      WHEN 'purchase' THEN 'unlock' ELSE CASE WHEN event_id % 2 = 0 THEN 'force_unlock' ELSE 'lock' END END AS action,
    floor(value)::BIGINT % 21 AS count FROM events)"""
query(
    "annotation_progress",
    f"""WITH {ACTIONS}, i AS (SELECT image_id, arg_max("user", (ts, event_id)) FILTER (action = 'save') AS u
      FROM acts GROUP BY 1)
    SELECT u AS annotator, count(*) AS done, NULL::BIGINT AS total FROM i WHERE u IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'ALL', count(u), count(*) FROM i""",
)(lambda spark, sf: explore.annotation_progress(fx.annotation_events(spark, sf)))
query(
    "count_extremes",
    """WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS p,
      count(*) OVER () AS n, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS t FROM orders)
    SELECT 'low' AS kind, o_orderkey, o_custkey FROM o WHERE p = 1
    UNION ALL SELECT 'middle', o_orderkey, o_custkey FROM o WHERE p = n // 2 + 1
    UNION ALL SELECT 'high', o_orderkey, o_custkey FROM o WHERE p = n
    UNION ALL SELECT 'top', o_orderkey, o_custkey FROM o WHERE t <= 5""",
)(lambda spark, sf: explore.count_extremes(fx.table(spark, sf, "orders"), key="o_orderkey", count="o_custkey"))
