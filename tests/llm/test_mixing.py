"""The mix against its SQL, and targets against resharing in a loop."""

import random

import duckdb
import pytest

from verify import compare
from vulnwave.llm import mixing


def by_loop(sizes, weights, share=1.5, repeats=2):
    """Targets by resharing the excess until none is above."""
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = repeats * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def test_targets(spark):
    r = random.Random(1)
    for _ in range(4):
        sizes = [r.choice([0, 1, 10, 1000, 50_000]) for _ in range(r.randint(1, 12))]
        table = spark.createDataFrame([(f"s{i:02d}" if i < len(sizes) - 1 else None, n) for i, n in enumerate(sizes)], "__source string, __size long")
        want = by_loop(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        found = {x["__source"]: x["target"] for x in mixing.targets(table).collect()}
        assert [found[f"s{i:02d}" if i < len(sizes) - 1 else None] for i in range(len(sizes))] == pytest.approx(want)
        assert len(found) == len(sizes)


def same_as_sql(docs):
    df = mixing.mix(docs)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    documents = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    want = duckdb.sql(mixing.MIX_SQL).project(", ".join(cols)).fetchall()
    assert compare(got, want) is None
    return df.collect()


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = same_as_sql(docs)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sums, largest = {}, max(r["size"] for r in rows)
    for r in rows:
        s = sums.setdefault(source[r["doc_id"]], [0, r["target"]])
        s[0] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(a - b) <= largest / 2 for a, b in sums.values())


def test_odd_rows(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (None, None, "x"), (2, "", "x"), (3, "w " * 100_000, "y"), (4, "one\x1ctwo three", "x"), (None, "%%% ###", "x")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, __size int")
    assert len(same_as_sql(docs.select("doc_id", "text", "source"))) == 7
    assert mixing.mix(docs).count() == 7 and mixing.mix(docs.limit(0)).count() == 0
    got = mixing.sample(docs)
    assert got.columns == docs.columns and got.where("text is null or text = ''").count() == 0


def test_heavier_documents_are_taken_more_often(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "case when id % 2 = 0 then 'good words here now' else '%%%%%%%%%%%%%%%% #### $$$$$ a' end text", "'s' source")
    taken = {r["k"]: r["n"] for r in mixing.mix(docs).selectExpr("doc_id % 2 k", "taken").groupBy("k").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    assert taken[0] > 1.15 * taken[1]
