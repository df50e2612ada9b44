"""Exact and near duplicates and nearest neighbours against brute force."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gridfare.llm import ann, exact_dedup, queries, simhash
from gridfare.llm.components import components


def brute_groups(rows):
    bare = [(i, t or "", "".join(c for c in t or "" if c not in " \t\n\v\f\r")) for i, t in rows]
    out = []
    for i, _, body in bare:
        group = [(-len(t), j is None, j or 0, j) for j, t, other in bare if other == body]
        keep = min(group)[3] if any(j is not None for *_, j in group) else None
        longest = min(group)
        keep = longest[3]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(body.encode()).hexdigest()))
    return out


def by_key(rows):
    return sorted(map(repr, rows))


def test_exact_groups_on_odd_rows(odd_docs, odd_rows):
    got = [tuple(row) for row in exact_dedup.duplicate_groups(odd_docs).collect()]
    assert by_key(got) == by_key(brute_groups([row[:2] for row in odd_rows]))


def test_exact_groups_match_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLES["op3_exact_dedup"]).fetchall()
    assert by_key(tuple(r) for r in queries.QUERIES["op3_exact_dedup"](spark, sf).collect()) == by_key(want)


def test_equal_digests_do_not_merge_different_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "a a"), (4, "ab")], "doc_id long, text string")
    whole = exact_dedup.compared_text

    def weak(*args, **kwargs):
        return whole(*args, **kwargs).withColumn("digest", exact_dedup.F.lit("same"))

    monkeypatch.setattr(exact_dedup, "compared_text", weak)
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.duplicate_groups(docs).collect()} == {(1, 3), (2, 2), (3, 3), (4, 2)}


def test_dropping_keeps_one_row_of_each_text_with_all_columns(odd_docs, odd_rows):
    kept = exact_dedup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    bodies = ["".join((row["text"] or "").split()) for row in kept.collect()]
    assert len(bodies) == len(set(bodies)) == len({"".join((row[1] or "").split()) for row in odd_rows})


def test_exact_on_an_empty_table(no_docs):
    assert exact_dedup.duplicate_groups(no_docs).count() == exact_dedup.drop_duplicates(no_docs).count() == 0


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def check_simhash(docs):
    rows = [(r["doc_id"], brute_print(r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
    prints = sorted({p for _, p in rows})
    near = [(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 4]
    comp = brute_components(prints, near)
    low = {}
    for i, p in rows:
        if i is not None:
            low[comp[p]] = min(i, low.get(comp[p], i))
    want = [(i, f"{p:016x}", low.get(comp[p])) for i, p in rows]
    assert by_key(want) == by_key(tuple(r) for r in simhash.near_duplicates(docs).collect())


def test_near_duplicates_on_documents(documents):
    check_simhash(documents)


def test_near_duplicates_on_odd_rows(odd_docs):
    check_simhash(odd_docs)


def test_near_duplicates_on_an_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == simhash.drop_near_duplicates(no_docs).count() == 0


def test_near_duplicates_leave_one_of_each_group(documents):
    kept = simhash.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    groups = {r["component_id"] for r in simhash.near_duplicates(documents).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)


def test_every_link_is_found_also_in_crowded_and_correlated_bits(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints = set(base)
    for value in base[:8]:
        for flips in range(1, 7):
            for _ in range(12):
                prints.add(value ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
    prints |= {value & ~0xFFFF | 0xABCD for value in base}  # sixteen bits all alike
    prints |= {0, 2**64 - 1, 1, 3}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "print long")
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    for parts in (3, 4):
        assert {tuple(r) for r in simhash.links(table, parts=parts).collect()} == want


def test_thresholds_add_up_and_cost_least(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 2**63, 300)
    how = simhash.plan(spark.createDataFrame([(int(v),) for v in values], "print long"))
    picked, costs = how.thresholds(values), how.costs(values)
    assert (picked.sum(axis=1) == 2).all() and picked.min() >= -1
    for row in range(40):
        own = sum(costs[row, n, t + 1] for n, t in enumerate(picked[row]))
        least = min(
            costs[row, 0, a + 1] + costs[row, 1, b + 1] + costs[row, 2, c + 1]
            for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 2
        )
        assert abs(own - least) < 1e-9


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="aB \t\nçÉ", max_size=60))
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) == brute_print(text)


def brute_nearest(rows, queries_, k=10):
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows])
    out = {}
    for i, v in queries_:
        gaps = np.sqrt(((matrix - np.array(v)) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, gaps)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(gaps[j])) for j in order]
    return out


def test_nearest_vectors_have_exact_scores_and_recall(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = ann.usable(source)
    found = {}
    for r in ann.nearest(rows.where("vec_id % 25 = 0"), rows, 64).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    plain = [(r[0], r[1]) for r in rows.collect()]
    want = brute_nearest(plain, [x for x in plain if x[0] % 25 == 0])
    gap = {i: dict(brute_nearest(plain, [(i, v)], k=len(plain))[i]) for i, v in plain if i in want}
    assert all(score == gap[i][j] for i, own in found.items() for j, score in own)
    hits = [len({j for j, _ in want[i]} & {j for j, _ in found.get(i, [])}) for i in want]
    assert sum(hits) >= 0.9 * 10 * len(want)


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(8)
    rows = [(i, [float(x) for x in centre]) for i in range(0, 40)]
    rows += [(100 + i, [float(x) for x in centre + 0.01 * rng.standard_normal(8)]) for i in range(30)]
    bad = [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (204, [None] + [1.0] * 7), (205, [float("inf")] + [0.0] * 7),
           (None, [1.0] * 8)]
    table = ann.usable(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"))
    assert table.count() == len(rows)
    found = {}
    for r in ann.nearest(table.where("vec_id % 20 = 0"), table, 8, block_rows=16).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found[0] == list(range(1, 11)) and found[20] == list(range(10))
    assert len(found[100]) == 10 and 100 not in found[100]


@pytest.mark.parametrize("others", [0, 400])
def test_every_query_has_ten_answers_or_all(spark, others):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64) * 9
    rows = [(i, [float(x) for x in rng.standard_normal(64)]) for i in range(9)]
    rows += [(100 + i, [float(x) for x in centre + rng.standard_normal(64)]) for i in range(others)]
    table = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = [x for x in rows if x[0] < 9]
    found = {}
    for r in ann.nearest(table.where("vec_id < 9"), table, 64, block_rows=128, slice_rows=4).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert {i: len(own) for i, own in found.items()} == {i: 10 if others else 8 for i, _ in asked}
    if not others:
        want = brute_nearest(rows, asked)
        assert all([j for j, _ in found[i]] == [j for j, _ in want[i]] for i, _ in asked)


def test_nearest_on_an_empty_table(spark):
    table = ann.usable(spark.createDataFrame([], "vec_id long, embedding array<float>, t int, a int"))
    assert ann.nearest(table, table, ann.dimensions(table)).count() == 0


def test_rotations_keep_lengths():
    vectors = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(np.linalg.norm(ann.rotate(vectors, 3), axis=1), np.linalg.norm(vectors, axis=1))


def test_all_queries_are_registered(sf):
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 14))
    assert os.path.isdir(sf)


def test_repeated_ids_are_judged_by_their_own_texts(spark):
    """Ids 3 and 8 share a text, another row with id 8 has a different one: the copy goes, the different text stays."""
    one, other = "a text that two documents share word for word", "quite another text with nothing in common at all"
    rows = [(3, one, "x"), (8, one, "y"), (8, other, "z"), (None, one, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _print string")
    kept = sorted((r["doc_id"] or 0, r["text"], r["_print"]) for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == [(0, one, "n"), (3, one, "x"), (8, other, "z")]


def test_exact_copies_keep_columns_of_any_name(spark):
    rows = [(1, "a b", "p", 7), (2, "ab", "q", 8), (2, "c", "r", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _pick string, _place int")
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
