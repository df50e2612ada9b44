"""The pipeline: each stage on what the one before has written, held against plain versions."""

import corpus_pipeline
import pytest

from gridfare.llm import exact_dedup, quality, queries, secret_scan, simhash
from gridfare.session import scratch_path


@pytest.fixture(scope="module")
def outputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_are_the_named_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]


def test_all_but_the_last_keep_the_columns(outputs):
    assert all(out.columns == outputs[0].columns for out in outputs[:-1])


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_decisions_take_effect(spark, sf, outputs):
    docs, good, single, apart, masked, packed = outputs
    net = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(good) == ids(quality.score_documents(docs, net).where("predicted = 1"))
    assert ids(single) == ids(exact_dedup.duplicate_groups(good).where("kept"))
    assert ids(apart) == sorted(r[0] for r in simhash.near_duplicates(single).select("component_id").distinct().collect())
    assert ids(masked) == ids(apart)
    before = {r["doc_id"]: r["text"] for r in apart.collect()}
    formats = secret_scan.fit(apart)
    for r in masked.collect():
        assert (r["text"] != before[r["doc_id"]]) == bool(secret_scan.find_spans(before[r["doc_id"]], formats))
        assert not secret_scan.base_spans(r["text"])[0] and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in packed.collect()} == set(ids(masked))


def test_run_gives_the_last_stage(spark, sf, outputs):
    rows = corpus_pipeline.run(spark, sf)
    pick = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sum(r["length"] for r in rows.collect()) == sum(r["length"] for r in outputs[-1].collect())
    assert {r["doc_id"] for r in rows.select(pick).collect()} == {r["doc_id"] for r in outputs[-1].collect()}


def test_stages_stand_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, sf)
            assert rows.count() >= 0


def test_every_query_runs_whole(spark, sf):
    size = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, query in queries.QUERIES.items():
        rows = query(spark, sf).count()
        if name.startswith("op13"):
            assert rows == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
        else:
            assert rows == size if not name.startswith(("op4", "op6", "op12")) else rows > 0
