"""Texts and edits against plain Python, estimates against all shingles."""

import hashlib
import re

from pyspark.sql import functions as F

from vulnwave.llm import fingerprints as fp


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def in_order(rows):
    """Rows by descending id, null last."""
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1]))
    return known


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    rows = in_order([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    assert len(got) == len(rows)
    errors, by_text = [], {}
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        r, n = got[key], len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(following)
        errors.append((abs(r["near_edited"] - jaccard(a, b)), abs(r["near_next"] - jaccard(a, c))))
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert sum(e for e, _ in errors) / len(errors) < 0.08 and sum(e for _, e in errors) / len(errors) < 0.01


def test_one_shuffle_of_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = fp.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("hashpartitioning(__cell") <= 2  # texts, and first ids of the ranges


def test_odd_rows(spark):
    rows = [(None, "n1"), (None, "n2"), (3, ""), (5, "a b c d e f " * 30_000), (4, None), (4, "x\x1cy"), (4, "x\x1cy")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, sketch int, __tie string")
    got = fp.fingerprints(docs).collect()
    assert len(got) == 7
    by = {r["n_chars"]: r for r in got if r["doc_id"] is not None}
    big = rows[3][1]
    third = len(big) // 3
    assert by[len(big)]["edited_sha256"] == hashlib.sha256(big[: len(big) - third].encode()).hexdigest()  # the next is empty
    assert by[3]["near_next"] in (0.0, 1.0) and by[0]["fingerprint"] == ""
    assert fp.fingerprints(docs.limit(0)).count() == 0
    only = fp.fingerprints(docs.where("doc_id = 5")).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0


def test_containment_of_unequal_documents_and_merging(spark):
    words = [f"w{i * 7919 % 10007}" for i in range(6000)]
    docs = spark.createDataFrame([(" ".join(words[:600]), " ".join(words), " ".join(words[3000:]))], "a string, b string, c string")
    for c in "abc":
        docs = fp.with_sketch(docs, c, f"s{c}")
    r = docs.select(
        fp.containment(F.col("sa"), F.col("sb")).alias("in_all"), fp.containment(F.col("sa"), F.col("sc")).alias("in_rest"),
        fp.likeness(F.col("sa"), F.col("sb")).alias("like"), fp.merged(F.col("sa"), F.col("sc")).alias("m"), "sb",
    ).first()
    assert r["in_all"] == 1.0 and r["in_rest"] == 0.0 and abs(r["like"] - 0.1) < 0.04
    assert set(r["m"]) <= set(r["sb"]) and abs(len(r["sb"]) - 1499) < 150


def test_without_a_hash_below_the_threshold_the_least_is_kept(spark):
    docs = spark.createDataFrame([(f"t{i}",) for i in range(60)], "text string")
    sizes = [len(r["s"]) for r in fp.with_sketch(docs, "text", "s").collect()]
    assert set(sizes) == {1}
