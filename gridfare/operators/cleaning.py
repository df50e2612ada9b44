"""Cleaning an image collection: filters, duplicates, mismatches, the funnel and stable renaming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfare.functions.columns import any_of, col, count_if
from gridfare.functions.ranking import positions
from gridfare.schemas import NO_PLAYER_RANGE

# Words that mark a picture as no match scene.
STOP_WORDS = ("sponsor", "award", "presser", "graphic")
MIN_WIDTH, MIN_HEIGHT = 800, 600


def resolution_filter(images: DataFrame, *, min_width: int = MIN_WIDTH, min_height: int = MIN_HEIGHT) -> DataFrame:
    return images.where((F.col("width") >= min_width) & (F.col("height") >= min_height))


def best_variant(images: DataFrame, shot: Sequence[str], *, key: str) -> DataFrame:
    """The variant of each shot with the largest area, the lowest key on ties; an aggregate, so a hot shot combines early."""
    area = F.col("width").cast("long") * F.col("height")
    rest = [c for c in images.columns if c not in shot]
    best = images.groupBy(*shot).agg(F.min_by(F.struct(*rest), F.struct(-area, F.col(key))).alias("_b"))
    return best.select(*shot, "_b.*")


def aspect_filter(images: DataFrame, *, low: float = 1.0, high: float = 2.0) -> DataFrame:
    """Width over height within the limits: no portraits, no panoramas."""
    return images.where((F.col("height") > 0) & (F.col("width") / F.col("height")).between(low, high))


def has_stop_word(texts: Sequence[str], words: Sequence[str] = STOP_WORDS) -> Column:
    """Whether a name, caption or tag text contains one of the words, in any case."""
    pattern = "(?i)" + "|".join(words)
    return any_of([F.coalesce(F.col(t).rlike(pattern), F.lit(False)) for t in texts])


def keyword_filter(images: DataFrame, texts: Sequence[str], *, words: Sequence[str] = STOP_WORDS) -> DataFrame:
    return images.where(~has_stop_word(texts, words))


def dedupe_by_hash(files: DataFrame, *, content: str = "content", name: str = "name") -> DataFrame:
    """One row per content hash, the smallest name, with the number of copies. The content itself is not shuffled.

    A file without content is no copy of another one: each name without content stays.
    """
    digest = F.sha2(F.col(content).cast("binary"), 256)
    hashed = files.withColumn("sha256", digest).drop(content)
    rest = [c for c in hashed.columns if c != "sha256"]
    unknown = F.when(F.col("sha256").isNull(), F.col(name))
    kept = hashed.groupBy("sha256", unknown.alias("_unknown")).agg(
        F.min_by(F.struct(*rest), F.col(name)).alias("_k"), F.count(F.lit(1)).alias("copies")
    )
    return kept.select("_k.*", "sha256", "copies")


def undecodable(images: DataFrame) -> DataFrame:
    """Files the image source could not decode."""
    return images.where(F.col("image.height") == -1).select(F.col("image.origin").alias("origin"))


def names_in(text: str | Column, names: Sequence[str]) -> Column:
    """Which of the names occur in the text, in any case."""
    lowered = F.lower(col(text))
    return F.array_compact(F.array(*[F.when(lowered.contains(n.lower()), n) for n in names]))


def metadata_mismatch(df: DataFrame, left: str, right: str, names: Sequence[str]) -> DataFrame:
    """Rows whose two texts both name teams but share none."""
    found = df.withColumns({"left_names": names_in(left, names), "right_names": names_in(right, names)})
    named = (F.size("left_names") > 0) & (F.size("right_names") > 0)
    return found.where(named & ~F.arrays_overlap("left_names", "right_names"))


def cleaning_funnel(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows left after each stage, in order, and how many it dropped. All stages come from one pass."""
    names = list(stages)
    alive, aggs = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, name in enumerate(names):
        alive = alive & F.coalesce(stages[name], F.lit(False))
        aggs.append(count_if(alive).alias(f"n{i + 1}"))
    steps = [
        F.struct(
            F.lit(i + 1).cast("long").alias("stage_no"),
            F.lit(name).alias("stage"),
            F.col(f"n{i + 1}").alias("remaining"),
            (F.col(f"n{i}") - F.col(f"n{i + 1}")).alias("dropped"),
        )
        for i, name in enumerate(names)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*steps)))


def sequential_rename(
    images: DataFrame,
    *,
    key: str = "name",
    no_player: str = "no_player",
    reserved: tuple[int, int] = NO_PLAYER_RANGE,
) -> DataFrame:
    """Old name to ``img_N.jpg``: images without players take the reserved numbers, the others the rest in key order.

    Numbers come from running positions that spread over tasks, so no single task sorts a whole group. Images without
    players that find the reserved block full go on after the highest number of all.
    """
    first, last = reserved
    size = last - first + 1
    grouped = images.withColumn("_np", F.when(F.col(no_player), 1).otherwise(0))
    placed = positions(grouped, ["_np"], [key], into="_pos")
    skip = F.when(F.col("_pos") >= first, F.col("_pos") + size).otherwise(F.col("_pos"))
    others = images.where(~F.coalesce(F.col(no_player), F.lit(False))).agg(F.count(F.lit(1))).scalar()
    highest = F.greatest(F.when(others >= first, others + size).otherwise(others), F.lit(last))
    fits = F.when(F.col("_pos") <= size, F.col("_pos") + first - 1).otherwise(highest + F.col("_pos") - size)
    number = F.when(F.col("_np") == 1, fits).otherwise(skip)
    kept = [c for c in images.columns]
    return placed.select(*kept, number.alias("image_num"), F.concat(F.lit("img_"), number, F.lit(".jpg")).alias("new_name"))


def size_gate(images: DataFrame, *, width: int = MIN_WIDTH, height: int = MIN_HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Images of exactly the required size, and the others for quarantine."""
    good = (F.col("width") == width) & (F.col("height") == height)
    return images.where(good), images.where(~F.coalesce(good, F.lit(False)))


# ---- file index ----


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def image_index(files: DataFrame, *, path: str = "path") -> DataFrame:
    """File name to its first path, with the number of paths that share the name."""
    return files.groupBy(file_name(path).alias("name")).agg(
        F.min(path).alias("path"), F.count(F.lit(1)).alias("copies")
    )


def duplicate_names(index: DataFrame) -> DataFrame:
    return index.where("copies > 1")


def missing_and_unreadable(annotated: DataFrame, files: DataFrame, *, name: str = "name", readable: Column) -> DataFrame:
    """Annotated names without a file (``missing``), and files that do not decode (``unreadable``)."""
    missing = annotated.select(name).distinct().join(files.select(name), name, "left_anti")
    broken = files.where(~F.coalesce(readable, F.lit(False))).select(name)
    return missing.withColumn("problem", F.lit("missing")).unionByName(broken.withColumn("problem", F.lit("unreadable")))

