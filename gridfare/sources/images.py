"""Image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_images(spark: SparkSession, path: str, *, pattern: str = "*.{jpg,jpeg,png,JPG,JPEG,PNG}") -> DataFrame:
    """Every image under ``path``, decoded by Spark's image source; an undecodable file keeps a row with height -1."""
    reader = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.option("dropInvalid", False).load(path)
