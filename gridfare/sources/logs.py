"""Run log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the line layout `[ts] [LEVEL] [logger] [run=ID] message`.
LINE = r"^\[([0-9T:.\-]+)Z\] \[(\w+)\s*\] \[([\w.]+)\s*\] \[run=([^\]]*)\] (.*)$"


def parse_log_lines(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """Timestamp, level, logger, run id and message; lines of another shape are left out."""
    part = [F.regexp_extract(value, LINE, i) for i in range(1, 6)]
    return lines.where(F.col(value).rlike(LINE)).select(
        F.try_to_timestamp(part[0], F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("ts"),
        part[1].alias("level"),
        part[2].alias("logger"),
        part[3].alias("run_id"),
        part[4].alias("message"),
    )


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of every log file under ``path``."""
    return parse_log_lines(spark.read.option("recursiveFileLookup", True).text(path))
