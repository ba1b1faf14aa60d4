"""Merge replay against the tiktoken library, and exact round trips."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from vulnwave.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["a", "b", "aa", "ab", " ", "  ", "\n", "1", "é", "日", "'s", "​", "\x1c", "\x85", "́", "🙂", "ß", "\t"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def encoded(texts):
    replay, pattern, known = bpe._ready(PATH, P.PATTERN)
    flat, ends = bpe._encoded(texts, replay, pattern, known)
    return [flat[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_random_texts(library):
    r = random.Random(1)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_long_and_repetitive_texts(library):
    texts = ["a" * 5000, "ab" * 3000, " " * 3000, "", "x y " * 50_000, "lorem1 " * 400]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_windows_of_a_long_text(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_BYTES", 100)
    monkeypatch.setattr(bpe, "WINDOW_WORDS", 7)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    texts = ["one two  three four 'll five\n\nsix " * 20, "short", None, "a b c d e f g"]
    assert encoded(texts) == [library.encode_ordinary(t or "") for t in texts]


def test_a_lower_merge_that_comes_up_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 400, b"ab": 300, b"abc": 260, b"ca": 310}
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    replay = bpe.MergeReplay(ranks)
    r = random.Random(2)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(3000)}
    words = sorted(words)
    assert replay.encode([w.encode() for w in words]) == [library.encode_ordinary(w) for w in words]


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.digests(docs, PATH, P.PATTERN).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "x y", 3), (1, "x y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.encode(docs, PATH, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in out) == [(0, 0), (1, 0), (1, 2), (1, 2)]
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)
    assert bpe.decode(docs.selectExpr("cast(null as array<int>) ids"), PATH).first()["decoded"] == b""
    assert bpe.digests(docs, PATH, P.PATTERN).count() == 4
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0
