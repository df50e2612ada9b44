"""Collection cleaning and file index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfare.operators import checks, cleaning
from gridfare.plans import fixtures as fx
from gridfare.plans.registry import query
from gridfare.sources import annotations as notes
from gridfare.session import scratch_path
from gridfare.plans.grid_queries import CELLS

# Documents as image files: sizes come from their length, content is their text.
FILES = """files AS (SELECT doc_id, 'doc_' || doc_id AS name, source, lang, text, n_chars,
  (n_chars * 13 % 1700)::BIGINT AS width, (n_chars * 7 % 1300)::BIGINT AS height FROM documents)"""
WORDS = (*cleaning.STOP_WORDS, "thund", "eaux")
NAMES = ("the", "blog", "tion", "www", "forum", "shop")


def _files(spark, sf):
    return fx.table(spark, sf, "documents").selectExpr(
        "doc_id",
        "concat('doc_', doc_id) AS name",
        "source",
        "lang",
        "text",
        "n_chars",
        "n_chars * 13 % 1700 AS width",
        "n_chars * 7 % 1300 AS height",
    )


query("resolution_filter", f"WITH {FILES} SELECT doc_id, width, height FROM files WHERE width >= 800 AND height >= 600")(
    lambda spark, sf: cleaning.resolution_filter(_files(spark, sf)).select("doc_id", "width", "height")
)
query(
    "best_variant",
    f"""WITH {FILES} SELECT source, lang, doc_id, width, height FROM (SELECT *, row_number() OVER (
      PARTITION BY source, lang ORDER BY width * height DESC, doc_id) AS rn FROM files) WHERE rn = 1""",
)(
    lambda spark, sf: cleaning.best_variant(
        _files(spark, sf).select("source", "lang", "doc_id", "width", "height"), ["source", "lang"], key="doc_id"
    )
)
query(
    "aspect_filter",
    """SELECT p_partkey, p_size::BIGINT AS width, p_partkey % 50 AS height FROM part
    WHERE p_partkey % 50 > 0 AND p_size / (p_partkey % 50) BETWEEN 1 AND 2""",
)(
    lambda spark, sf: cleaning.aspect_filter(
        fx.table(spark, sf, "part").selectExpr("p_partkey", "CAST(p_size AS BIGINT) AS width", "p_partkey % 50 AS height")
    )
)
query(
    "keyword_filter",
    f"WITH {FILES} SELECT doc_id FROM files WHERE NOT regexp_matches(text || ' ' || source, '(?i){'|'.join(WORDS)}')",
)(lambda spark, sf: cleaning.keyword_filter(_files(spark, sf), ["text", "source"], words=WORDS).select("doc_id"))
query(
    "dedupe_by_hash",
    f"""WITH {FILES} SELECT min(name) AS name, sha256(text) AS sha256, count(*) AS copies FROM files GROUP BY 2""",
)(
    lambda spark, sf: cleaning.dedupe_by_hash(_files(spark, sf).select("name", "text"), content="text")
)


def _names_sql(column):
    listed = ", ".join(f"'{n}'" for n in NAMES)
    return f"list_filter([{listed}], lambda n: contains(lower({column}), n))"


query(
    "metadata_mismatch",
    f"""WITH p AS (SELECT page_id, {_names_sql('url')} AS a, {_names_sql("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS b
      FROM pages) SELECT page_id, array_to_string(a, ',') AS left_names, array_to_string(b, ',') AS right_names FROM p
    WHERE len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b)""",
)(
    lambda spark, sf: cleaning.metadata_mismatch(
        fx.table(spark, sf, "pages").withColumn("title", F.regexp_extract("html", "<title>(.*?)</title>", 1)),
        "url",
        "title",
        NAMES,
    ).select(
        "page_id", F.array_join("left_names", ",").alias("left_names"), F.array_join("right_names", ",").alias("right_names")
    )
)
_ALIVE = ["width >= 800 AND height >= 600", "width <= 2 * height", "lang <> 'de'", "n_chars > 500"]
_STAGES = ["resolution", "aspect", "keyword", "quality"]


def _stage_sql(i):
    whole = " AND ".join(_ALIVE[: i + 1])
    before = f"count(*) FILTER ({' AND '.join(_ALIVE[:i])})" if i else "count(*)"
    return (
        f"SELECT {i + 1}::BIGINT AS stage_no, '{_STAGES[i]}' AS stage, count(*) FILTER ({whole}) AS remaining, "
        f"{before} - count(*) FILTER ({whole}) AS dropped FROM files"
    )


query("cleaning_funnel", f"WITH {FILES} " + " UNION ALL ".join(_stage_sql(i) for i in range(4)))(
    lambda spark, sf: cleaning.cleaning_funnel(
        _files(spark, sf), {name: F.expr(rule) for name, rule in zip(_STAGES, _ALIVE)}
    )
)
query(
    "sequential_rename",
    f"""WITH {FILES}, r AS (SELECT name, row_number() OVER (PARTITION BY lang = 'de' ORDER BY name) AS p, lang = 'de' AS np,
      count(*) FILTER (lang <> 'de') OVER () AS others FROM files),
    n AS (SELECT name, CASE WHEN NOT np THEN CASE WHEN p >= 251 THEN p + 37 ELSE p END WHEN p <= 37 THEN p + 250
      ELSE greatest(CASE WHEN others >= 251 THEN others + 37 ELSE others END, 287) + p - 37 END AS image_num FROM r)
    SELECT name, image_num, 'img_' || image_num || '.jpg' AS new_name FROM n""",
)(
    lambda spark, sf: cleaning.sequential_rename(
        _files(spark, sf).select("name", (F.col("lang") == "de").alias("no_player"))
    ).drop("no_player")
)
query(
    "size_gate",
    f"""WITH {FILES} SELECT 'kept' AS gate, count(*) AS n FROM files WHERE width % 8 = 0 AND height % 6 = 0
    UNION ALL SELECT 'quarantined', count(*) FROM files WHERE NOT (width % 8 = 0 AND height % 6 = 0)""",
)(lambda spark, sf: _gate(spark, sf))


def _gate(spark, sf):
    sized = _files(spark, sf).selectExpr("IF(width % 8 = 0, 800, 801) AS width", "IF(height % 6 = 0, 600, 601) AS height")
    kept, other = cleaning.size_gate(sized)
    counts = [d.agg(F.lit(n).alias("gate"), F.count(F.lit(1)).alias("n")) for n, d in (("kept", kept), ("quarantined", other))]
    return counts[0].unionByName(counts[1])


query(
    "check_image_size",
    f"WITH {FILES} SELECT doc_id, width, height FROM files WHERE NOT (width = 800 AND height = 600)",
)(lambda spark, sf: checks.check_image_size(_files(spark, sf)).select("doc_id", "width", "height"))

# ---- file index ----

query(
    "image_index",
    """SELECT regexp_extract(url, '[^/]*$') AS name, min(url) AS path, count(*) AS copies FROM pages GROUP BY 1""",
)(lambda spark, sf: cleaning.image_index(fx.table(spark, sf, "pages"), path="url"))
query(
    "missing_and_unreadable",
    """SELECT DISTINCT 'd' || doc_id AS name, 'missing' AS problem FROM labels
      WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'fr')
    UNION ALL SELECT CASE WHEN lang = 'fr' THEN 'moved_' ELSE 'd' END || doc_id, 'unreadable' FROM documents
      WHERE n_chars % 10 = 0""",
)(
    lambda spark, sf: cleaning.missing_and_unreadable(
        fx.table(spark, sf, "labels").selectExpr("concat('d', doc_id) AS name"),
        fx.table(spark, sf, "documents").selectExpr("concat(IF(lang = 'fr', 'moved_', 'd'), doc_id) AS name", "n_chars"),
        readable=F.col("n_chars") % 10 != 0,
    )
)


@query(
    "write_features",
    f"WITH {CELLS} SELECT image, cell_row, cell_col, label FROM cells",
)
def _write_features(spark, sf):
    path = scratch_path(spark, "features")
    notes.write_features(fx.cells(spark, sf), path, ["image", "cell_row", "cell_col", "label"])
    shape = "image string, cell_row long, cell_col long, label long"
    return notes.read_features(spark, path, schema=shape)


@query(
    "read_features",
    f"WITH {CELLS} SELECT image, cell_id, player_present FROM cells",
)
def _read_features(spark, sf):
    path = scratch_path(spark, "features-parquet")
    fx.cells(spark, sf).select("image", "cell_id", "player_present").write.parquet(path)
    return notes.read_features(spark, path, format="parquet")


@query(
    "write_reports",
    f"""WITH {CELLS} SELECT 'fold' AS report, fold_id::VARCHAR AS item, count(DISTINCT image)::VARCHAR AS value FROM cells GROUP BY 2
    UNION ALL SELECT 'team', label::VARCHAR, count(DISTINCT image)::VARCHAR FROM cells WHERE label > 0 GROUP BY 2""",
)
def _write_reports(spark, sf):
    from gridfare.operators import explore

    cells = fx.cells(spark, sf)
    reports = {"fold": explore.images_per_fold(cells), "team": explore.team_presence(cells)}
    paths = notes.write_reports(reports, scratch_path(spark, "reports"))
    back = [spark.read.option("header", True).csv(p).toDF("item", "value").select(F.lit(n).alias("report"), "item", "value")
            for n, p in paths.items()]
    return back[0].unionByName(back[1])
