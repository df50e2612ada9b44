"""The operators of this subpackage over the driver tables, one query each, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridfare.llm import ann, byte_bpe, divergence, exact_dedup, language_id, masked_lm, packing, personal_data, quality, secret_scan, sharding, simhash, turn_repair


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def byte_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip_digests(_documents(spark, sf), path, public_tokenizers.PATTERN)


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_documents(spark, sf))


def masked_scores(spark: SparkSession, sf: str) -> DataFrame:
    return masked_lm.score_corpus(_documents(spark, sf))


def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = ann.usable(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return ann.nearest(vectors.where("vec_id % 100 = 0"), vectors, ann.dimensions(vectors))


def simhash_components(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf))


def lexical_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


def secret_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return secret_scan.scan_documents(docs, secret_scan.fit(docs))


def languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return language_id.label_documents(docs, language_id.fit(docs))


def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return quality.score_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))


def hash_tree_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_table(_documents(spark, sf), 40)


def personal_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    return personal_data.scan_documents(docs, personal_data.fit(docs))


def source_divergences(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergences(_documents(spark, sf))


def repaired_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return turn_repair.repair_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))


QUERIES = {
    "op1_masked_lm": masked_scores,
    "op2_byte_bpe": byte_bpe_round_trip,
    "op3_exact_dedup": exact_duplicates,
    "op4_cross_polytope": nearest_vectors,
    "op5_simhash": simhash_components,
    "op6_lexical_packing": lexical_packing,
    "op7_secret_grammar": secret_spans,
    "op8_language_id": languages,
    "op9_quality_cnn": quality_scores,
    "op10_hash_tree_sharding": hash_tree_shards,
    "op11_weak_pii": personal_spans,
    "op12_source_divergence": source_divergences,
    "op13_turn_repair": repaired_conversations,
}

ORACLES = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = first_value(doc_id) OVER best AS kept, sha256(body) AS text_sha256
        FROM d WINDOW best AS (PARTITION BY body ORDER BY chars DESC, doc_id)""",
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        o AS (SELECT id, lang, source, unnest(words) AS term FROM d),
        t AS (SELECT lang, term, count(*) AS m FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 30),
        c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN t USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v, sum(m) AS m_all FROM t GROUP BY 1),
        s AS (SELECT lang, source, coalesce(sum(n), 0) AS n_all FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        x AS (
            SELECT lang, source, term, coalesce(n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (n_all + 5 * v) AS p,
                   1 + (1000000000::HUGEINT * (m + 5)) // (m_all + 5 * v) AS q
            FROM s JOIN v USING (lang) JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)),
        f AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q)::BIGINT FROM x WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value,
               row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 50""",
}
