"""Removed bytes against a count of all strings, and the merge against sorting."""

import collections
import hashlib
import os
import random

import numpy as np
import pytest

from vulnwave.llm import suffixes, util


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(spark, texts, length, gram, ids=None):
    rows = list(zip(range(len(texts)) if ids is None else ids, texts))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(4)
    got = suffixes.remove_repeats(docs, length=length, gram=gram).collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    return [(r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in got]


def passages(seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcé \n") for _ in range(r.randint(20, 200))) for _ in range(6)]
    texts = []
    for _ in range(50):
        text = ""
        for _ in range(r.randint(0, 5)):
            if r.random() < 0.5:
                p = r.choice(pool)
                a = r.randint(0, len(p) // 2)
                text += p[a : r.randint(a, len(p))]
            else:
                text += "".join(r.choice("abcdef ") for _ in range(r.randint(0, 60)))
        texts.append(text)
    return [*texts, texts[3], texts[4], texts[4], None, "", "ab" * 100, "ab" * 90 + "x", "a" * 150, "c" + "a" * 60]


@pytest.mark.parametrize("seed, strings", [(5, 20_000), (6, 7)])
def test_passages(spark, seed, strings, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE", strings)
    texts = passages(seed)
    assert found(spark, texts, 40, 16) == brute(texts, 40)


def test_runs_and_pieces_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE", 11)
    monkeypatch.setattr(suffixes, "RUN_BYTES", 300)
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 150)
    texts = passages(8)
    assert found(spark, texts, 40, 16) == brute(texts, 40)


def test_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120).collect()
    texts = [r["text"] for r in rows]
    got = found(spark, texts, suffixes.LENGTH, suffixes.GRAM)
    assert got == brute(texts, suffixes.LENGTH) and sum(r[1] for r in got) > 0


def test_few_very_long_documents(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE", 50)
    r = random.Random(9)
    common = ["".join(r.choice("abcdefgh") for _ in range(300)) for _ in range(30)]
    texts = ["".join(r.choice(common) + "".join(r.choice("abcdefgh") for _ in range(80)) for _ in range(40)) for _ in range(3)]
    drawn = []
    own = suffixes._drawn

    def watched(anchored, share, *rest):
        out = own(anchored, share, *rest)
        drawn.append((share * anchored.selectExpr("sum(size(places))").first()[0], out.groupBy("row").count().collect()))
        return out

    monkeypatch.setattr(suffixes, "_drawn", watched)
    assert found(spark, texts, 40, 16) == brute(texts, 40)
    (want, by_row), = drawn
    assert len(by_row) == 3 and 0.6 * want < sum(x["count"] for x in by_row) < 1.4 * want


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(util, "HOT_ROWS", 10)
    texts = passages(11) + ["".join(chr(97 + i * i % 23) for i in range(120))] * 40 + [f"{k}" * 9 + "the same passage in forty documents, of over forty bytes" + f"{k}" * 9 for k in range(40)]
    assert found(spark, texts, 40, 16) == brute(texts, 40)


def test_odd_rows(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(900))
    assert found(spark, [text, text, None, "x"], 400, 128, [7, 7, None, None])[:2] == [(900, 900, 1, hashlib.sha256().hexdigest())] * 2
    assert found(spark, ["q", ""], 400, 128) == brute(["q", ""], 400)
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_are_shared():
    r = random.Random(1)
    for _ in range(200):
        common = bytes(r.choice(b"abc") for _ in range(60))
        texts = [bytes(r.choice(b"abc") for _ in range(r.randint(0, 80))) + common + bytes(r.choice(b"abc") for _ in range(r.randint(0, 80))) for _ in range(2)]
        sets = []
        for t, places in zip(texts, suffixes._anchors_of(texts, 60, 20)):
            at = t.index(common)
            sets.append({p - at for p in places.tolist() if at <= p <= at + 40})
        assert sets[0] & sets[1]


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(3)
    for n in (1, 2, 3, 8, 13):
        runs = [sorted((bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))), r.randint(0, 9), r.randint(0, 9)) for _ in range(r.randint(0, 30))) for _ in range(n)]
        coded = []
        for run in runs:
            shared = ([0] + [len(os.path.commonprefix([a[0], b[0]])) for a, b in zip(run, run[1:])])[: len(run)]
            assert suffixes.front_decode(suffixes.front_code(run, shared)) == (run, shared)
            coded.append((run, shared))
        out = list(suffixes.LoserTree(coded))
        want = sorted(x for run in runs for x in run)
        assert [x for x, _ in out] == want
        assert [k for _, k in out[1:]] == [len(os.path.commonprefix([a[0], b[0]])) for a, b in zip(want, want[1:])]


def test_depths_over_ranges():
    r = random.Random(4)
    for _ in range(60):
        runs = [sorted((bytes(r.choice(b"ab") for _ in range(r.randint(1, 8))), 10 * k, i) for i in range(r.randint(1, 12))) for k in range(3)]
        everything = sorted(x for run in runs for x in run)
        splitters = sorted(r.sample(everything, min(len(everything), 4)))
        parts = collections.defaultdict(lambda: ([], set(), set()))
        for run in runs:
            for k, blob, lower, upper in suffixes.cut_run(run, splitters, 1):
                if blob:
                    parts[k][0].append(blob)
                parts[k][1].update(lower)
                parts[k][2].update(upper)
        got = []
        for k in range(len(splitters) + 1):
            blobs, before, after = parts[k]
            got += zip(*suffixes.merge_range(blobs, splitters[k - 1] if k else None, splitters[k] if k < len(splitters) else None, before, after, 1))
        assert [x for x, _ in got] == [x[1:] for x in everything]
        for i, (x, (_, depths)) in enumerate(zip(everything, got)):
            others = {len(os.path.commonprefix([x[0], y[0]])) for j, y in enumerate(everything) if j != i}
            assert suffixes.unpack(depths) == sorted(d for d in others if d >= 1)
