"""Hit words against every window tried at every place."""

import hashlib
import random
import re

import pytest

from vulnwave.llm import decontaminate
from vulnwave.llm.queries import QUERIES


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain(docs, items, size=10):
    """(n_words, hit positions, item ids) of each text by a table of all windows."""
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= {str(i) for i in ids if i is not None}
        out.append((len(w), hit, sorted(found)))
    return out


def test_query_equals_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = {}
    for r, (n, hit, ids) in zip(docs, plain([d["text"] for d in docs], items)):
        want[r["doc_id"]] = (n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_decontaminate"](spark, sf_dir).collect()}
    assert got == want
    assert any(w[4] for w in want.values())


@pytest.mark.parametrize("part_words", [200_000, 60])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts(spark, part_words, seed):
    r = random.Random(seed)

    def some(most):
        return " ".join(r.choice("a b c d é".split()) for _ in range(r.randrange(most)))

    items = [(i % 13, some(14)) for i in range(30)] + [(None, "a b a b c"), (20, None), (21, "..."), (22, "A b, a B c")]
    texts = [some(60) for _ in range(60)] + [None, "", "--", "a b a b c", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x for x in decontaminate.matches(rows, bench, window=6, part_words=part_words).collect()}
    for i, (n, hit, ids) in enumerate(plain(texts, items, 6)):
        spans = [(s["start"], s["end"]) for s in got[i]["hit_spans"]]
        assert got[i]["n_words"] == n and got[i]["items"] == ids
        assert {p for a, b in spans for p in range(a, b)} == hit
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_long_items_are_cut_without_losing_windows(spark):
    r = random.Random(4)
    long = [f"w{r.randrange(300)}" for _ in range(3_000)]
    bench = spark.createDataFrame([("a", " ".join(long)), ("b", " ".join(long[::-1]))], "item_id string, text string")
    texts = [" ".join(["q", *long[i : i + 10], "q"]) for i in range(0, 2_990, 23)] + [" ".join(long)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.matches(rows, bench, part_words=500).orderBy("doc_id").collect()
    want = plain(texts, [("a", " ".join(long)), ("b", " ".join(long[::-1]))])
    assert [x["items"] for x in got] == [w[2] for w in want]
    assert [sum(s["end"] - s["start"] for s in x["hit_spans"]) for x in got] == [len(w[1]) for w in want]


def test_removal(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [f"Before, {item.upper()}! after it stand many other words, more than there are in the item", f"{item} x", "clean", None]
    rows = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, items string, n int")
    bench = spark.createDataFrame([(1, item, "z")], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(rows, bench).collect()}
    assert sorted(got) == [0, 2, 3]
    assert got[0]["text"] == "Before, ! after it stand many other words, more than there are in the item"
    assert got[2]["text"] == "clean" and got[3]["text"] is None and got[0]["n"] == 1
    kept = decontaminate.decontaminate(rows, bench, longest=10, coverage=1.0).where("doc_id = 1").first()
    assert kept["text"] == texts[1]


def test_empty_tables_and_odd_rows(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.digest(none, bench).count() == 0
    rows = spark.createDataFrame([(None, "x a b"), (1, "a b"), (1, "a b"), (2, "word " * 300_000 + "a b")], "doc_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.digest(rows, empty).collect()} == {0}
    got = sorted((r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.digest(rows, bench).collect())
    assert got == [(2, 2, 1, True), (2, 2, 1, True), (3, 2, 1, True), (300_002, 2, 1, True)]
