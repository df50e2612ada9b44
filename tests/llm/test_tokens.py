"""Byte-level BPE against the library that defines it, and packing against its contract."""

import functools
import hashlib
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridfare.llm import byte_bpe, packing, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.load_ranks(RANKS).rank
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def check_bpe(docs, library):
    want = sorted(
        (
            (row["doc_id"] is None, row["doc_id"] or 0),
            len(ids := library.encode_ordinary(row["text"] or "")),
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((row["text"] or "").encode()).hexdigest(),
        )
        for row in docs.select("doc_id", "text").collect()
    )
    rows = byte_bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def test_bpe_on_odd_rows(odd_docs, library):
    check_bpe(odd_docs, library)


def test_bpe_on_documents(documents, library):
    check_bpe(documents, library)


def test_bpe_on_an_empty_table(no_docs):
    assert byte_bpe.round_trip_digests(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_merges_that_overlap_or_go_back_in_rank():
    ranks = byte_bpe.load_ranks(RANKS)
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"ab \ne1!"), size=n)) for n in rng.integers(1, 40, 800)]
    ids, places, lengths = byte_bpe.replay(words, ranks)
    for word, place, length in zip(words, places, lengths):
        want = [ranks.rank[word]] if word in ranks.rank else byte_bpe.merge_word(word, ranks)
        assert ids[place : place + length].tolist() == want


def test_forgetting_and_long_texts_change_nothing(monkeypatch, library):
    forgetful = functools.partial(byte_bpe.Encoder, remember=3)
    monkeypatch.setattr(byte_bpe, "Encoder", forgetful)
    monkeypatch.setattr(byte_bpe, "REPLAYED_WORDS", 2)
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 50)
    texts = ["some words that come and go, and come again", "x" * 20, "many many words " * 30, "日本語 " * 40]
    ids, counts = byte_bpe.encoder.__wrapped__(RANKS, public_tokenizers.PATTERN).encode(texts)
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(t) for t in texts]


def test_long_unbroken_words(library, tokenizer):
    """Overlapping merges of a very long word take no time that grows with its square."""
    ranks = byte_bpe.load_ranks(RANKS)
    for word in ("a" * 200_000, "ab" * 50_000, "xyzzy" * 9_999):
        begin = time.perf_counter()
        found = byte_bpe.merge_word(word.encode(), ranks)
        assert time.perf_counter() - begin < 10
        assert b"".join(ranks.token[i] for i in found).decode() == word
    for word in ("a" * 5_000, "ab" * 2_500, "thth" * 700 + "e"):
        assert byte_bpe.merge_word(word.encode(), ranks) == library.encode_ordinary(word)
        assert packing.WordTokens(WORDS).encode([word])[0].tolist() == tokenizer.encode(word, add_special_tokens=False).ids


def test_pairs_of_tokens_that_no_merge_goes_on_from(tokenizer):
    """Every token may stand beside any other; each pair has a key of its own."""
    vocabulary = np.array(sorted(t for t in tokenizer.get_vocab() if t.isascii() and t.isalpha()))
    pairs = np.random.default_rng(3).choice(vocabulary, (20_000, 2))
    words = ["".join(pair) for pair in pairs.tolist()] + ["onhenderin", "ofattionly"]
    text = " ".join(words)
    assert packing.WordTokens(WORDS).encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_neighbours_come_in_order():
    random = np.random.default_rng(4)

    class Index:
        def scores(self, _):
            return scores

    for size in (0, 5, 64, 65, 3_000):
        scores, rest = random.integers(0, 40, size).astype(float), random.integers(0, 2, size)
        unused = np.flatnonzero(rest)
        assert list(packing.nearest(Index(), 0, rest)) == unused[np.argsort(-scores[unused], kind="stable")].tolist()


def test_word_tokens_equal_the_library(tokenizer):
    every = "".join(map(chr, range(256)))
    texts = [every, every[::-1], "I'VE don't 'S'T ÀÉÎ ß µ ªº ½¾ ²³ 12345 aaaa!!!!", "x" * 300, "", " \n ", "日本 Ωσς İ e\u0301", "<|endoftext|> <|startoftext|>", "in a <|endoftext|>text and <|EndOfText|>",
             "the quick, brown (fox)... jumps" * 3, "a\u00a0b\x85c\x1cd"]
    found = packing.WordTokens(WORDS).encode(texts)
    assert [x.tolist() for x in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(docs, tokenizer, window=2048):
    rows = packing.pack_documents(docs, WORDS).collect()
    source = docs.select("doc_id", "text").collect()
    ids = {}
    for row in source:
        own = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        ids.setdefault(row["doc_id"], []).append(np.array(own, dtype="<u4"))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc_id, own in pieces.items():
        assert sum(r["length"] for r in own) == sum(map(len, ids[doc_id]))
        for r in own:
            cut = slice(r["start"], r["start"] + r["length"])
            assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[cut].tobytes()) == r["ids_crc32"] for x in ids[doc_id])
        if len(ids[doc_id]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    return rows


def test_packing_on_documents(documents, tokenizer):
    check_packing(documents, tokenizer)


def test_packing_on_odd_rows(odd_docs, tokenizer):
    check_packing(odd_docs, tokenizer)


def test_packing_on_an_empty_table(no_docs):
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_a_seed_takes_its_nearest_unused_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(10 + 100 * t, 110 + 100 * t, size=(6, 300)) for t in range(3)]
    ids = [doc.astype("<u4") for pair in zip(*topics) for doc in pair]
    idf = np.ones(400)
    first = packing.pack_block(ids, idf, 300.0, window=900)[0]
    assert len({number % 3 for number, _, _ in first}) == 1


def test_block_scores_are_bm25():
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 50, size=n).astype("<u4") for n in (5, 40, 200, 1, 80)]
    idf = rng.random(50) + 0.1
    mean = 60.0
    index = packing.BlockIndex(ids, idf, mean)
    for seed in range(len(ids)):
        terms = index.terms[seed]
        for number, own in enumerate(ids):
            want = 0.0
            for term in terms:
                times = (own == term).sum()
                if times:
                    want += idf[term] * times / (times + 1.2 * (0.25 + 0.75 * len(own) / mean))
            assert abs(index.scores(seed)[number] - want) < 1e-5


def test_null_ids_decode_to_null(spark):
    ids = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")
    found = [row[0] for row in ids.select(byte_bpe.decode(F.col("ids"), RANKS)).collect()]
    tokens = byte_bpe.load_ranks(RANKS).token
    assert found == [None, b"", tokens[0] + tokens[1]]


def test_encoder_forgets_by_words_and_by_ids(monkeypatch):
    """Whatever is forgotten, texts get the same ids."""
    spelt = []

    def spell(words):
        spelt.extend(words)
        counts = np.array([len(word) for word in words], np.int64)
        return np.frombuffer("".join(words).encode(), np.uint8).astype(np.int32), np.cumsum(counts) - counts, counts

    texts = ["ab c", "ab " + "x" * 50, "c ab", ""]
    expected = [list(text.replace(" ", "").encode()) for text in texts]
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 1)
    for words, ids in ((99, 99), (0, 99), (99, 10)):
        monkeypatch.setattr(byte_bpe, "REMEMBERED_IDS", ids)
        spelt.clear()
        known = byte_bpe.Encoder(str.split, spell, words)
        values, counts = known.encode(texts)
        assert [own.tolist() for own in np.split(values, np.cumsum(counts)[:-1])] == expected
        assert len(spelt) == len(set(spelt)) + {99: 0 if ids == 99 else 2, 0: 3}[words]


@pytest.mark.parametrize("bound", ["REMEMBERED_WORDS", "REMEMBERED_IDS", "REMEMBERED_BYTES"])
def test_lookup_forgets_by_words_ids_and_bytes(tokenizer, monkeypatch, bound):
    monkeypatch.setattr(words, bound, 3)
    monkeypatch.setattr(packing, "TEXT_CHARS", 40)
    texts = ["one two, two.\nthree", "", " two  don't é 12 ", "\t\t\t\t one", "three " * 20, "it's <|endoftext|>", "日本 one"]
    found = packing.WordTokens(WORDS).encode(texts)
    assert [x.tolist() for x in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_words_take_little_memory():
    known = packing.WordTokens(WORDS)
    known.encode(["a"])
    texts = [" ".join(f"w{hashlib.md5(bytes([row, n % 256, n // 256])).hexdigest()[:9].translate(str.maketrans('0123456789', 'ghijklmnop'))}" for n in range(500)) for row in range(80)]
    tracemalloc.start()
    try:
        for text in texts:
            known.encode([text])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 4_000_000


def test_workers_drop_the_tokeniser_once_all_texts_are_tokenised(spark):
    """Its words would stay beside the steps that follow, in the worker's memory."""
    packing.word_tokens(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.word_tokens.cache_info().currsize == 1

    class Table:
        def where(self, _):
            return self

        def select(self, _):
            return self

        def mapInArrow(self, entries, shape):
            assert list(entries(iter([]))) == []
            return spark.createDataFrame([], shape)

    seen, rows, tokens = packing.document_frequencies(Table(), 5)
    assert seen.tolist() == [0] * 5 and (rows, tokens) == (0, 0)
    assert packing.word_tokens.cache_info().currsize == 0
