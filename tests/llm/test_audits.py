"""Personal data and source divergences: plain Python versions, odd rows, planted cases."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfare.llm import divergence, personal_data, queries

# ---- personal data ----

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + place % 2) for place, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def sound(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(text):
    order = list(PATTERNS)
    spans = [(m.start(), order.index(kind), m.end()) for kind in order for m in re.finditer(PATTERNS[kind], text or "") if sound(kind, m[0])]
    return ",".join(f"{order[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def check_base(rows, texts):
    assert len(rows) == len(texts)
    for row in rows:
        listed = plain_spans(texts[row["doc_id"]])
        kinds = Counter(part.split(":")[0] for part in listed.split(",") if part)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (row, listed)
        assert [row[f"n_{kind}"] for kind in PATTERNS] == [kinds[kind] for kind in PATTERNS]
        spans = [s for s in row["spans"].split(",") if s]
        assert [s for s in spans if s.split(":")[0] in PATTERNS] == [s for s in listed.split(",") if s]
        assert row["n_added"] == len(spans) - sum(kinds.values())


def test_base_spans_equal_plain_python(spark, sf, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = queries.QUERIES["op11_weak_pii"](spark, sf).collect()
    check_base(rows, texts)
    assert all(sum(r[f"n_{kind}"] for r in rows) for kind in PATTERNS)


TRICKY = [
    "a@b.c_d@e.f and x@y then abc@def@x.y.z. a..b%+@c-d.e-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.004 1.2.3 9.9.9.9.9", "4111-1111 1111 1111 4111111111111111 411111111111111 4111  1111",
    "+1 (743) 555-3824+49 30 1234567 +1 +12345 + 1 (2) +123456789012345678 +1234567890.", "é\U0001f600 +1 (743) 555-3824 \U0001f600 a@b.co", "", None, "+1-" * 50 + "2", "1 2-3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "user.name+tag@mail.example.co.uk,1.1.1.1@x.io", "x@y.z@w.v", "\n@a.b", "@a.b a@.b a@b. a@b.c.", "4111 1111 1111 1111 4111 1111 1111 1111", "0.0.0.0255.00.1",
]


def test_tricky_texts(spark):
    rows = list(enumerate(TRICKY))
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, base string, added string")
    check_base(personal_data.scan_documents(docs, personal_data.fit(docs)).collect(), dict(rows))


def test_random_texts(spark):
    random = np.random.default_rng(4)
    signs = list("ab1290.@+-() _%") + ["é"]
    rows = [(i, "".join(random.choice(signs, 60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_base(personal_data.scan_documents(docs, personal_data.fit(docs)).collect(), dict(rows))


def test_long_runs_and_many_matches(spark):
    rows = [(1, "x" * 300_000 + "@"), (2, "1" * 300_000 + ".5"), (3, "a." * 100_000 + "@b.c"), (4, "c@" + "d." * 100_000 + "e"), (5, "m@n.op " * 3_000), (6, "1 2\n" * 50_000), (7, "+1" + " " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in personal_data.scan_documents(docs, personal_data.fit(docs)).collect()}
    expected = {1: 0, 2: 0, 3: 1, 4: 1, 5: 3_000, 6: 0, 7: 0}
    assert {i: r["n_email"] for i, r in got.items()} == expected
    assert got[5]["spans"].startswith("email:0:6,email:7:13,") and got[5]["spans"].endswith("email:20993:20999")
    assert got[4]["spans"] == f"email:0:{2 + 200_000 + 1}"


def test_odd_rows(odd_docs, no_docs):
    model = personal_data.fit(odd_docs)
    rows = personal_data.scan_documents(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == nothing for r in rows if r["doc_id"] in (4, 5, 6, 7, 11))
    assert personal_data.scan_documents(no_docs, personal_data.fit(no_docs)).collect() == []


PLANTED = [
    ("Please call me: (743) 555-3824 today", "number:16:30"), ("My account is IBAN: DE89 3704 0044 0532 0130 00 thanks", "account:20:47"),
    ("Write to mail: jane.doe (at) example (dot) com now", "contact:15:46"), ("Name: Dr. Anna Schmidt lives here", "name:6:22"),
]
CLEAN = ["see page 312.34.56.78.90 of version 2-33-44-55", "date 2024-05-06 or 31.12.1999", "item 4432 5073 7903 5541 order", "account number XX99 1234 5678 9012 was refused"]


@pytest.fixture(scope="module")
def trained(spark, documents):
    """The model of the documents, some of which hold planted cases."""
    extra = spark.createDataFrame([(10**9 + i, t) for i, (t, _) in enumerate(PLANTED)] + [(2 * 10**9 + i, t) for i, t in enumerate(CLEAN)], "doc_id long, text string")
    return personal_data.fit(documents.select("doc_id", "text").union(extra))


def test_planted_spans_are_added_and_clean_texts_stay(spark, trained):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in PLANTED] + CLEAN)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal_data.scan_documents(docs, trained).collect()}
    assert [got[i] for i in range(len(PLANTED))] == [span for _, span in PLANTED]
    assert [got[len(PLANTED) + i] for i in range(len(CLEAN))] == [""] * len(CLEAN)


def test_estimated_reliabilities_follow_the_truth():
    """Votes drawn from known reliabilities: the estimate ranks labelers, and its chances agree with the truth."""
    random = np.random.default_rng(2)
    truth = random.random(20_000) < 0.3
    right = (0.95, 0.6, 0.85, 0.75)
    votes = np.stack([np.where(random.random(truth.size) < r, truth, ~truth) * 2 - 1 for r in right], axis=1)
    counted = Counter(("number", *map(int, v), 2) for v in votes)
    rows = [(*key, n) for key, n in sorted(counted.items())]
    model, chance = personal_data.reliabilities(rows)
    estimated = [model.votes[j][1][2] for j in range(4)]
    assert np.argsort(estimated).tolist() == np.argsort(right).tolist()
    assert abs(model.common["number"] - truth.mean()) < 0.05
    by_votes = {row[:6]: c for row, c in zip(rows, chance)}
    agreed = [(by_votes[("number", *map(int, v), 2)] >= 0.5) == t for v, t in zip(votes, truth)]
    assert np.mean(agreed) > 0.93
    personal_data.train(model, rows, chance)
    assert model.weights["format=1"] > model.weights["gazetteer=1"] > model.weights["gazetteer=-1"] > model.weights["format=-1"]


def test_no_python_on_the_main_path(spark, documents):
    plan = personal_data.scan_documents(documents, personal_data.fit(documents))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# ---- divergences ----


def plain_divergences(rows, least=30, top=50):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        words = terms.findall(text.translate(lower))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for one, s in groups if one == lang)

        def share(counter, term):
            return 1 + 10**9 * (counter[term] + 5) // (sum(counter[t] for t in kept) + 5 * len(kept))

        all_ = sum((counts[lang, s] for s in own), Counter())
        p = {t: share(counts[lang, source], t) for t in kept}
        pairs = [(sum(abs(p[t] - share(counts[lang, s], t)) for t in kept), s) for s in own if s != source]
        above = [(p[t] - share(all_, t), t) for t in kept if counts[lang, source][t] and p[t] > share(all_, t)]
        for part, values, most in (("pair", pairs, None), ("term", above, top)):
            ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))[:most]
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def ranked(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("batch, shard_rows", [(10_000, divergence.SHARD_ROWS), (3, 7)])
def test_divergences_equal_plain_python(spark, monkeypatch, batch, shard_rows):
    """Ties, nulls, other scripts, one source alone, groups without terms, repeated rows; also with tiny batches and shards."""
    random = np.random.default_rng(8)
    words = ["Ab", "aB", "c", "Zürich", "ZÜRICH", "日本", "x_y", "d9e", " ", "f-g", "h\x00i", "{j}"]
    rows = [(" ".join(random.choice(words, 8)), random.choice(["en", "de", None]), random.choice(["s1", "s2", "s3", None, ""])) for _ in range(300)]
    rows += [(None, "en", "s9"), ("", "xx", "s1"), ("only here", "fr", "s1"), ("12 34", "xx", "s2"), *[("Same row", "es", "s1")] * 31, ("same", "es", "s2")]
    rows = [(t, None if lang is None else str(lang), None if s is None else str(s)) for t, lang, s in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    monkeypatch.setattr(divergence, "HELD_ROWS", 20 if batch == 3 else divergence.HELD_ROWS)
    try:
        docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "text string, lang string, source string, term string, n int")
        got = ranked(divergence.divergences(docs, shard_rows=shard_rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_divergences(rows)


def test_divergence_query_equals_its_sql(spark, sf, documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    sql = con.sql(queries.ORACLES["op12_source_divergence"])
    expected = sorted(sql.project("lang, source, part, item, value, rank").fetchall())
    df = queries.QUERIES["op12_source_divergence"](spark, sf)
    assert ranked(df) == expected
    assert dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_long_text_and_large_counts(spark):
    docs = spark.createDataFrame([("w " * 300_000, "en", "a"), *[("w v", "en", "b")] * 40], "text string, lang string, source string")
    got = {r[:4]: r[4] for r in ranked(divergence.divergences(docs))}
    p = lambda n, total: 1 + 10**9 * (n + 5) // (total + 10)
    assert got["en", "a", "pair", "b"] == (p(300_000, 300_000) - p(40, 80)) + (p(40, 80) - p(0, 300_000))
    big = spark.range(1).select(divergence._share(F.lit(10**14), F.lit(10**15), F.lit(10**9)).alias("s"))
    assert big.first()["s"] == 1 + 10**9 * (10**14 + 5) // (10**15 + 5 * 10**9)


def test_odd_and_empty_tables(odd_docs, no_docs):
    got = ranked(divergence.divergences(odd_docs))
    assert got == plain_divergences([(r["text"], r["lang"], r["source"]) for r in odd_docs.collect()])
    assert divergence.divergences(no_docs).collect() == []
