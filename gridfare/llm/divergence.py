"""Source divergence audit: how far the words of each source of a language lie from those of the others.

Terms are counted inside ``mapInArrow`` with Arrow's own kernels: texts are lower-cased for ASCII and split by a pattern, words
are dictionary encoded, and a hash aggregate counts them per row and then per group, so a partition passes on one row for each
group and term it has seen (a partition's counts are merged until they reach a bound of rows, then emitted). Equal terms of a
language then meet, rare ones go, and the counts that are left are written once. They are dealt out in columnar shards by
language and a hash of the term, so no language is one task. A shard reads its terms in order, a batch at a time, fills one row
a term and one column a source, and adds up absolute differences for all pairs of sources; the sums of all shards make the
divergences. Shares are whole numbers, and all arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfare.session import scratch_path

#: Whatever is not a letter of ASCII or beyond ASCII parts terms.
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, SCALE, SMOOTH, TOP = 30, 1_000_000_000, 5, 50
#: Bytes of text split at once, and rows of merged counts a task holds.
SLICE_BYTES, HELD_ROWS = 4 << 20, 400_000
#: Rows of kept counts a shard has on average, and terms whose columns are filled at once.
SHARD_ROWS, BLOCK_CELLS = 200_000, 1 << 21

_GROUP = ["lang", "source"]
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in runs of at most ``SLICE_BYTES`` of text; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs): occurrences of each term in each group and rows that hold it."""
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), BREAKS)
    words = pc.list_flatten(lists).dictionary_encode()
    rows = pa.table({"row": pc.list_parent_indices(lists), "word": words.indices})
    per_row = rows.group_by(["row", "word"]).aggregate([([], "count_all")])
    groups = [pc.take(batch.column(c), per_row["row"]) for c in _GROUP]
    grouped = pa.table([*groups, per_row["word"], per_row["count_all"]], names=[*_GROUP, "word", "n"])
    summed = grouped.group_by([*_GROUP, "word"]).aggregate([("n", "sum"), ([], "count_all")])
    terms = pc.take(words.dictionary, summed["word"])
    counts = pa.table([summed["lang"], summed["source"], terms, summed["n_sum"], summed["count_all"]], schema=_PARTIAL)
    return counts.filter(pc.not_equal(counts["term"], ""))


def _merged(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by([*_GROUP, "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table([whole["lang"], whole["source"], whole["term"], whole["n_sum"], whole["docs_sum"]], schema=_PARTIAL)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    settled = 0
    for batch in batches:
        for part in _slices(batch):
            held.append(count_terms(part))
            if sum(t.num_rows for t in held) >= settled + HELD_ROWS:
                held = [_merged(held)]
                settled = held[0].num_rows
                if settled >= HELD_ROWS:
                    yield from held[0].to_batches(max_chunksize=65_536)
                    held, settled = [], 0
    if held:
        yield from _merged(held).to_batches(max_chunksize=65_536)


def kept_counts(docs: DataFrame, *, least: int = LEAST_DOCS, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n) of the terms that at least ``least`` rows of their language hold."""
    texts = _groups_of(docs, text_col)
    partial = texts.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    # One exchange serves both: rows of a term and its sources lie together, and a term has one row a source.
    counted = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return counted.withColumn("docs", everywhere).where(F.col("docs") >= least).select("lang", "source", "term", "n")


def _groups_of(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _GROUP], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def _share(n: Column, total: Column, terms: Column) -> Column:
    """The whole number 1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)); 0 where there is no term."""
    above = (n + SMOOTH).cast("decimal(27,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + F.lit(SMOOTH) * terms.cast("long")).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", above.cast("decimal(38,0)"), below) + 1).otherwise(0)


def shares(kept: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shares of all groups for a term they lack, and of the kept counts: (…, base, whole) and (…, term, p, q).

    ``base`` is the group's share of a term that it does not hold; ``p`` and ``q`` are the shares in group and language.
    """
    per_term = kept.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"))
    languages = per_term.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    totals = kept.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    sized = groups.join(totals, _GROUP, "left").join(languages, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    bases = sized.withColumn("base", _share(F.lit(0), F.col("total"), F.col("terms")))
    found = kept.join(bases, _GROUP).join(per_term, ["lang", "term"])
    return bases, found.select(
        *_GROUP, "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q")
    )


_SHARD = "lang string, one string, other string, difference decimal(38,0)"
_SHARD_ARROW = pa.schema([("lang", pa.string()), ("one", pa.string()), ("other", pa.string()), ("difference", pa.decimal128(38, 0))])


class _Pairs:
    """Sums of absolute differences for all pairs of a language's sources, over the terms of a shard."""

    def __init__(self, lang: str) -> None:
        self.lang, self.sources, self.bases = lang, [], []
        self.sums = self.places = None

    def source(self, name: str, base: int) -> None:
        self.sources.append(name)
        self.bases.append(base)

    def add(self, terms: np.ndarray, sources: list[str], p: np.ndarray) -> None:
        """Shares of whole terms, rows of a term side by side; sources that a term lacks have their base."""
        if self.sums is None:
            self.places = {name: at for at, name in enumerate(self.sources)}
            self.sums = np.zeros((len(self.sources),) * 2, object)
        columns = np.array([self.places[s] for s in sources])
        rows = np.cumsum(np.r_[0, terms[1:] != terms[:-1]])
        step = max(BLOCK_CELLS // len(self.sources), 1)
        cuts = np.searchsorted(rows, np.arange(0, rows[-1] + step, step))
        for begin, end in zip(cuts, [*cuts[1:], len(rows)]):
            if begin == end:
                continue
            filled = np.tile(np.array(self.bases, np.int64), (rows[end - 1] - rows[begin] + 1, 1))
            filled[rows[begin:end] - rows[begin], columns[begin:end]] = p[begin:end]
            for at in range(len(self.sources) - 1):
                self.sums[at, at + 1 :] += np.abs(filled[:, at + 1 :] - filled[:, at : at + 1]).sum(axis=0)

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.sums is None:
            return
        for at, name in enumerate(self.sources[:-1]):
            others = self.sources[at + 1 :]
            sums = pa.array([int(v) for v in self.sums[at, at + 1 :]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(others)), pa.array([name] * len(others)), pa.array(others), sums], schema=_SHARD_ARROW)


def _shard_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair sums of the shards of a partition, whose rows come by shard: first the language's sources, then its terms.

    A term that a batch cuts in two waits for the rest of it.
    """
    now, pairs, waiting = None, None, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        shard = pc.binary_join_element_wise(pc.cast(table["shard"], pa.string()), table["lang"], " ").combine_chunks()
        codes = shard.dictionary_encode().indices.to_numpy()
        terms = table["term"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        size = len(codes)
        last = size - 1
        while last > 0 and codes[last - 1] == codes[size - 1] and terms[last - 1] == terms[size - 1] and terms[size - 1] >= 0:
            last -= 1
        if terms[size - 1] < 0:
            last = size
        cuts = [0, *(np.flatnonzero(codes[1:last] != codes[: last - 1]) + 1 if last > 1 else []), last]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            key = shard[begin].as_py()
            if key != now:
                if pairs is not None:
                    yield from pairs.result()
                now, pairs = key, _Pairs(table["lang"][begin].as_py())
            heads = begin + int(np.searchsorted(terms[begin:end] >= 0, True))
            for name, base in zip(table["source"][begin:heads].to_pylist(), table["p"][begin:heads].to_pylist()):
                pairs.source(name, base)
            if heads < end:
                pairs.add(terms[heads:end], table["source"][heads:end].to_pylist(), table["p"][heads:end].to_numpy())
        waiting = table.slice(last) if last < size else None
    if waiting is not None:
        yield from _shard_tail(waiting, now, pairs)
    elif pairs is not None:
        yield from pairs.result()


def _shard_tail(table: pa.Table, now: str | None, pairs: _Pairs) -> Iterator[pa.RecordBatch]:
    """The last term of a partition; its sources have come before it."""
    pairs.add(np.zeros(table.num_rows, np.int64), table["source"].to_pylist(), table["p"].combine_chunks().to_numpy())
    yield from pairs.result()


def pair_differences(bases: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """(lang, one, other, difference): the summed differences of all pairs of sources, each once, over all kept terms."""
    heads = bases.where("terms > 0").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), *_GROUP, F.lit(None).cast("string").alias("term"), F.col("base").alias("p"))
    dealt = found.select(F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), *_GROUP, "term", "p")
    rows = heads.unionByName(dealt).repartition("lang", "shard").sortWithinPartitions("lang", "shard", "term", "source")
    return rows.mapInArrow(_shard_sums, _SHARD).groupBy("lang", "one", "other").agg(F.sum("difference").cast("long").alias("difference"))


def divergences(
    docs: DataFrame, *, least: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every occurring (lang, source).

    Part ``pair``: each other source of the language and the summed difference of their shares, over all kept terms. Part
    ``term``: the ``top`` terms whose share in the source exceeds that in the language most. Ranks go by falling value, then by
    the bytes of the item. Null text, lang and source are empty strings; repeated rows are rows. A language without kept terms
    has pairs of value 0 and no terms, and the only source of a language has no pairs. An empty table gives no rows. Further
    columns are not read. Kept counts are written to the shared folder, as every later step reads them.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "divergence-counts")
    kept_counts(docs, least=least, text_col=text_col).write.parquet(path)
    kept = spark.read.parquet(path)
    groups = _groups_of(docs, text_col).select(*_GROUP).distinct()
    bases, found = shares(kept, groups)
    differences = pair_differences(bases, found, max(kept.count() // shard_rows, 0) + 1)
    both = differences.unionByName(differences.select("lang", F.col("one").alias("other"), F.col("other").alias("one"), "difference"))
    others = bases.select("lang", F.col("source").alias("one")).join(bases.select("lang", F.col("source").alias("other")), "lang").where("one <> other")
    pairs = others.join(both, ["lang", "one", "other"], "left").select(
        "lang", F.col("one").alias("source"), F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("difference", F.lit(0)).alias("value")
    )
    terms = found.where("p > q").select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    ranked = [rows.withColumn("rank", F.row_number().over(order)) for rows in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
