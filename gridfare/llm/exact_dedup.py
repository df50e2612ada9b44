"""Exact duplicates without hot tasks: combine locally, then per salted digest, then globally.

Every stage is one hash aggregate whose key holds the whole compared text beside its digest, so two texts are only ever
merged after their contents were compared. Spark combines each key inside a task first (the local stage), a salt taken
from the row's id then spreads even a text that fills a third of the corpus over many tasks (the salted stage), and at
most one row per text and salt is left for the last (the global stage). DataFrame functions only.

The winner is carried as one decimal, ``characters * 10^20 + (2^63 - 1 - id)``, because a fixed-width value keeps the
aggregates in hash maps; its maximum is the longest original and then the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfare.llm.columns import free_name, keyed_text

#: White space that does not count: space and the characters 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"
SALTS = 64
_LAST = 2**63 - 1


def _whole(value: int, digits: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({digits},0)")


def _order(chars: Column, row_id: Column) -> Column:
    back = _whole(_LAST, 20) - F.coalesce(row_id, F.lit(_LAST)).cast("decimal(20,0)")
    return (chars.cast("decimal(10,0)") * _whole(10**20, 21) + back).cast("decimal(38,0)")


def compared_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chars, body, digest, echo): characters of the original, the text compared, its SHA-256 and XXH64."""
    texts = keyed_text(docs, id_col, text_col)
    bare = texts.select("doc_id", F.length("text").alias("chars"), F.regexp_replace("text", BLANKS, "").alias("body"))
    return bare.select("*", F.sha2("body", 256).alias("digest"), F.xxhash64("body").alias("echo"))


def winners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per different text: digest, echo, keep_id (null where only a row without id has it), group_size."""
    rows = compared_text(docs, id_col=id_col, text_col=text_col)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    partly = salted.groupBy("digest", "echo", "body", "salt").agg(
        F.max(_order(F.col("chars"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("n")
    )
    whole = partly.groupBy("digest", "echo", "body").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    kept = (_whole(_LAST, 20) - F.col("best") % _whole(10**20, 21)).cast("long")
    return whole.select("digest", "echo", F.nullif(kept, F.lit(_LAST)).alias("keep_id"), F.col("n").alias("group_size"))


def duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty, and all texts without a visible character are equal. Of repeated rows with the winning id each
    is marked kept (they are the same document); a row without an id stays only if no equal row has one. The look-up of a
    row's group uses both digests and carries no text, so it is a plain equi-join that Spark splits where a group is hot.
    """
    rows = compared_text(docs, id_col=id_col, text_col=text_col).select("doc_id", "digest", "echo")
    found = rows.join(winners(docs, id_col=id_col, text_col=text_col, salts=salts), ["digest", "echo"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows with the winning id one stays.

    Winners are few columns wide, so a text moves once more at most, to meet its group and id under one key.
    """
    pick, place = free_name(docs, "_pick"), free_name(docs, "_place")
    best = winners(docs, id_col=id_col, text_col=text_col, salts=salts)
    staying = best.select(_pick(F.col("digest"), F.col("keep_id")).alias(pick))
    body = F.regexp_replace(F.coalesce(docs[text_col].cast("string"), F.lit("")), BLANKS, "")
    keyed = docs.withColumn(pick, _pick(F.sha2(body, 256), docs[id_col].cast("long")))
    order = Window.partitionBy(pick).orderBy(F.length(text_col).desc_nulls_last(), F.col(text_col))
    kept = keyed.join(staying, pick, "left_semi").withColumn(place, F.row_number().over(order))
    return kept.where(F.col(place) == 1).drop(pick, place)


def _pick(digest: Column, row_id: Column) -> Column:
    return F.concat_ws(":", digest, F.coalesce(row_id.cast("string"), F.lit("none")))
