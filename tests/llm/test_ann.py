"""Recall against brute force, exact scores, the stopping test's quantiles."""

import numpy as np
import pytest

from vulnwave.llm import ann


def brute(ids, vectors, query, k=20):
    score = vectors @ vectors[query]
    score[ids == ids[query]] = -np.inf
    return ids[np.lexsort((ids, -score))[:k]].tolist()


def test_quantiles():
    # P(chi-square of 2 degrees <= x) = 1 - exp(-x / 2)
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991464, abs=1e-5)
    assert ann.chi_square_quantile(0.95, 10) == pytest.approx(18.307038, abs=1e-5)
    with pytest.raises(ValueError):
        ann.chi_square_quantile(0.5, 3)


def test_lifting_keeps_the_order_of_inner_products():
    r = np.random.default_rng(1)
    x, q = r.normal(size=(200, 8)) * r.uniform(0.1, 3, size=(200, 1)), r.normal(size=(1, 8))
    most = np.linalg.norm(x, axis=1).max()
    far = ((ann.lifted(x, most) - ann.aimed(q, most)) ** 2).sum(1)
    assert (np.argsort(far) == np.argsort(-(x @ q[0]))).all()


@pytest.mark.parametrize("part", [20_000, 300])
def test_recall(spark, sf_dir, part, monkeypatch):
    monkeypatch.setattr(ann, "PART", part)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in ann.neighbours(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    hits = 0
    for q, found in got.items():
        at = int(np.nonzero(ids == q)[0][0])
        assert [r["rank"] for r in found] == list(range(1, 21))
        for r in found:
            other = vectors[np.nonzero(ids == r["vec_id"])[0][0]]
            assert r["score"] == pytest.approx(float(vectors[at] @ other), abs=1e-12)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        hits += len({r["vec_id"] for r in found} & set(brute(ids, vectors.copy(), at)))
    assert hits / (20 * len(got)) >= 0.9


def test_odd_rows_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 10)
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, [0.5, 0.5]), (101, None), (102, []), (103, [0.0, 0.0]), (104, [float("nan"), 1.0])]
    rows += [(105, [float("inf"), 1.0]), (106, [None, 1.0]), (107, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (120, [1.0]), (140, None)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.neighbours(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == [0, 20, 40, 100]
    assert got[0] == list(range(1, 21)) and got[20] == [i for i in range(21) if i != 20] and got[100] == list(range(20))
    assert ann.neighbours(table.limit(0)).count() == 0
    few = ann.neighbours(table.where("vec_id in (0, 1, 100)")).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in few] == [1, 100]
    twice = ann.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>"))
    assert [r["vec_id"] for r in twice.collect()] == [1, 1]


def asked_of(spark, rows):
    got = {}
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_components_of_any_size(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1.0]), (20, [3.0, 4.0]), (21, [1.0, 1.0]), (22, [5e-324, 0.0]), (40, [-1.7e308, 1.7e308])]
    got = asked_of(spark, rows)
    assert sorted(got) == [0, 20, 40]
    assert [v for v, _ in got[0]] == [1, 20, 21, 22, 40] and got[0][1] == (20, 3e-200)
    # 3 * -1.7e308 + 4 * 1.7e308 leaves the range on the way only
    assert [v for v, _ in got[20]] == [40, 1, 21, 0, 22] and got[20][0][1] == pytest.approx(1.7e308) and got[20][1:3] == [(1, 3e200), (21, 7.0)]
    assert [v for v, _ in got[40]] == [20, 21, 22, 0, 1] and got[40][4][1] == -np.inf


@pytest.mark.parametrize("seed", [1, 2])
def test_one_huge_vector_does_not_blur_the_others(spark, seed, monkeypatch):
    monkeypatch.setattr(ann, "PART", 150)
    r = np.random.default_rng(seed)
    vectors = r.normal(size=(400, 6))
    vectors[7] *= 1e180
    vectors[9] *= 1e-170
    got = asked_of(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    ids = np.arange(400)
    hits = sum(len({v for v, _ in got[q]} & set(brute(ids, vectors.copy(), q))) for q in range(0, 400, 20))
    assert sorted(got) == list(range(0, 400, 20)) and hits >= 0.9 * 20 * 20
