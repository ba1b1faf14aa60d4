"""Near words against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vulnwave.llm import spelling
from vulnwave.llm.queries import QUERIES


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}) - {word}


def plain_vocabulary(docs):
    counts = Counter()
    for doc, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain(counts):
    letters = {c for w in counts for c in w}
    out = {}
    for w, n in counts.items():
        near = [x for x in edits(w, letters) if x in counts]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= 10 * n else None, n, len(near))
    rows = {}
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, near, counts[form] if form else None)
    return rows


def collected(df):
    return {r["word"]: tuple(r)[1:] for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_query_equals_plain_python(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(plain_vocabulary(docs))
    assert collected(QUERIES["op13_spelling"](spark, sf_dir)) == want
    assert any(w[0] for w in want.values())


@pytest.mark.parametrize("hot", [200, 3])
@pytest.mark.parametrize("letters", ["abc", "abcdefghijklmnopqrstuvwxyzéÿ×"])
def test_random_vocabularies(spark, hot, letters):
    r = random.Random(len(letters) + hot)
    words = {"".join(r.choice(letters) for _ in range(r.choice([7, 8, 9, 30]))) for _ in range(150)}
    for w in sorted(words):
        words |= set(r.sample(sorted(edits(w, letters)), 3))
    counts = {w: r.choice([2, 3, 25, 40, 500, 6_000]) for w in words if len(w) >= 7}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert collected(spelling.groups(df, hot)) == plain(counts)


def test_neighbourhoods_are_whole():
    r = np.random.default_rng(1)
    for symbols in (4, 6):
        words = r.integers(1, symbols + 1, (20, 8)).astype(np.uint64)
        got = spelling.neighbours(words, symbols)
        for row, word in zip(got, words):
            want = set()
            w = word.tolist()
            each = range(1, symbols + 1)
            for x in edits(bytes(w).decode("latin-1"), [chr(c) for c in each]):
                want.add(int(spelling.values(np.array([[ord(c) for c in x]], np.uint64))[0]))
            assert set(row.tolist()) - {int(spelling.values(word[None])[0])} == want


def test_chain_of_forms(spark):
    counts = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2_000, "aaaabbbb": 20_000, "aaabbbbb": 200_000}
    got = collected(spelling.groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == plain(counts)
    assert {v[1] for v in got.values()} == {"aaabbbbb"}


def test_odd_rows(spark):
    text = "Straßenbahn naïveté×x NAÏVETÉ naïveté " * 3
    docs = [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, "z" * 300 + " " + "z" * 300), (31, "abcdefg " * 40)]
    df = spark.createDataFrame([(*d, "w", 5) for d in docs], "doc_id long, text string, word string, n int")
    assert collected(spelling.corpus_variants(df)) == plain(plain_vocabulary(docs))
    assert spelling.corpus_variants(df.where("false")).count() == 0
    long = spark.createDataFrame([(d, "z" * 20_000 + " " + "z" * 20_001) for d in (1, 2)], "doc_id long, text string")
    assert sorted(len(r["word"]) for r in spelling.corpus_variants(long).collect()) == [20_000, 20_001]
