"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of every row, a null text as an empty one.

    Only these two columns are taken, so further columns of the input may have any name.
    """
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def unsigned_share(hashed: Column) -> Column:
    """A 64-bit hash as a number strictly inside (0, 1), from its upper 52 bits."""
    return (F.shiftrightunsigned(hashed, 12).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name where the table has that column already; case does not tell names apart."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
