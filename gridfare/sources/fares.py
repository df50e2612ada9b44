"""Monthly fare files of both schema vintages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfare.functions.columns import col
from gridfare.schemas import FARE_COLUMNS, FARE_COLUMNS_V3, FARE_SCHEMA


def append_fares_monthly(rows: DataFrame, path: str, when: str | Column) -> None:
    """Append rows, in header order and null as empty text, to the folder of the UTC month of ``when``.

    The rebalance hint sizes the files and lets AQE split a month that holds most of the rows.
    """
    month = F.date_format(col(when), "yyyy_MM")
    ordered = rows.select(*FARE_COLUMNS, month.alias("year_month")).hint("rebalance", "year_month")
    writer = ordered.write.mode("append").partitionBy("year_month")
    writer.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_fares(spark: SparkSession, path: str, *, columns: list[str] = FARE_COLUMNS) -> DataFrame:
    """One vintage; the month folder comes back as ``year_month`` and prunes scans."""
    schema = T.StructType([FARE_SCHEMA[c] for c in columns] + [T.StructField("year_month", T.StringType())])
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def read_fares_all_months(spark: SparkSession, current: str, legacy: str | None = None) -> DataFrame:
    """Every month of the current vintage and, when given, of the 29-column one; its missing columns are null."""
    rows = read_fares(spark, current)
    if legacy is None:
        return rows
    return rows.unionByName(read_fares(spark, legacy, columns=FARE_COLUMNS_V3), allowMissingColumns=True)
