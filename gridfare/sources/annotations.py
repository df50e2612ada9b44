"""Annotation tables in and out: wide CSV, nested JSON, feature and report files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfare.operators.grid import cell_slots, to_matrix
from gridfare.schemas import CELL_NAMES

FILE_NAMES = {"Image File Name": "image", "Train Or Test": "split"}


def read_annotations(
    spark: SparkSession,
    path: str,
    *,
    rename: Mapping[str, str] = FILE_NAMES,
    required: Sequence[str] = ("image", "split", *CELL_NAMES),
) -> DataFrame:
    """Wide annotation CSV with typed columns; missing columns are an error that names them."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.withColumnsRenamed(dict(rename))
    missing = [c for c in required if c not in named.columns]
    if missing:
        raise ValueError(f"annotation file lacks columns: {', '.join(missing)}")
    whole = {c: F.col(c).try_cast("int") for c in [*CELL_NAMES, "count"] if c in named.columns}
    return named.withColumns(whole)


def read_features(spark: SparkSession, path: str, *, schema=None, format: str = "csv") -> DataFrame:
    """A feature table by path. Give a schema: inferring one reads a CSV twice."""
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.load(path)


def write_features(df: DataFrame, path: str, columns: Sequence[str], *, mode: str = "errorifexists") -> None:
    """The named columns, in that order, as CSV."""
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def write_reports(reports: Mapping[str, DataFrame], root: str, *, mode: str = "errorifexists") -> dict[str, str]:
    """Each report under its own folder of ``root``; returns the paths."""
    paths = {name: f"{root.rstrip('/')}/{name}" for name in reports}
    for name, report in reports.items():
        report.write.mode(mode).option("header", True).csv(paths[name])
    return paths


def export_annotations_csv(cells: DataFrame) -> DataFrame:
    """Wide rows ``image, split, count, c01..c64`` from cells."""
    packed = cell_slots(cells, ["image", "split", "count"], "label")
    columns = [F.get("values", F.lit(i)).alias(c) for i, c in enumerate(CELL_NAMES)]
    return packed.select("image", "split", "count", *columns)


def export_annotations_json(cells: DataFrame) -> DataFrame:
    """Nested rows: ``labels`` as an 8x8 matrix and ``features`` as the flat vector."""
    packed = cell_slots(cells, ["image", "split"], "label")
    return packed.select("image", "split", to_matrix("values").alias("labels"), F.col("values").alias("features"))
