"""Automata and parses against plain substring search; accuracy on held-out documents."""

import random

import numpy as np
from pyspark.sql import functions as F

from vulnwave.llm import langid

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then the other things that they have",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und dann die anderen Dinge",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et puis les autres choses",
}


def model():
    return langid.build({k: [langid.normalise(v)] for k, v in SAMPLES.items()})


def parse(text, corpus):
    """Phrases of a greedy parse by substring search, block by block."""
    count = 0
    for i in range(0, len(text), langid.BLOCK):
        block = text[i : i + langid.BLOCK]
        while block:
            n = next((n for n in range(len(block), 0, -1) if block[:n] in corpus), 1)
            count, block = count + 1, block[n:]
    return count


def test_normalise():
    as_text = lambda t: "".join(chr(c) if c else " " for c in langid.normalise(t))
    assert as_text("  Ab--c1d É!") == "ab c d é "
    assert as_text("") == as_text("12 3") == ""


def test_automaton_holds_all_substrings():
    r = random.Random(1)
    for _ in range(50):
        s = [r.randint(1, 3) for _ in range(r.randint(1, 30))]
        a = langid.SuffixAutomaton(s)
        assert len(a.next) <= 2 * len(s) + 1
        seen = set()
        todo = [(0, ())]
        while todo:
            state, path = todo.pop()
            seen.add(path)
            todo += [(t, (*path, c)) for c, t in a.next[state].items()]
        assert seen == {tuple(s[i:j]) for i in range(len(s) + 1) for j in range(i, len(s) + 1)}


def test_phrases_are_longest_matches(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 16)
    m = model()
    r = random.Random(3)
    words = " ".join(SAMPLES.values()).split() + ["zq", "öä", "日本"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 20))) for _ in range(100)]
    ready = [langid.normalise(t) for t in texts]
    found = m.phrases(ready)
    to_text = lambda points: "".join(chr(c) if c else " " for c in points)
    for k, language in enumerate(m.languages):
        corpus = to_text(np.append(langid.normalise(SAMPLES[language]), 0))
        assert found[k].tolist() == [parse(to_text(t), corpus) for t in ready]


def test_predict():
    names, scores, _ = model().predict(["the lazy dog", "der faule Hund", "le chien", "123 !?", "", None])
    assert names == ["en", "de", "fr", "und", "und", "und"]
    assert all(0 <= s <= 1 for s in scores) and scores[3:] == [0, 0, 0]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.95


def test_learns_from_labelled_rows_that_are_not_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lied = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    key = lambda r: r["doc_id"]
    a, b = (sorted(langid.predictions(d).collect(), key=key) for d in (docs, lied))
    assert a == b


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "", "en", 2), (2, "the dog the dog", None, 3), (3, "12", "en", 1), (4, "the dog", "en", 1), (4, "the dog", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.predictions(docs).collect()
    assert len(got) == 6 and {r["lang_pred"] for r in got if r["doc_id"] in (None, 1, 3)} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] == 2} == {"en"}
    assert langid.predictions(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predictions(unlabelled).collect()} == {"und"}
