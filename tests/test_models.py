import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnwave.functions.draws import draw
from vulnwave.operators import classify
from vulnwave.operators.isolation import SPACE, IsolationForest, average_path, grow_tree, node_draw, path_lengths


def _cloud(spark, n=2000):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    x[:20] += 8
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "i int, v array<double>")


def test_average_path():
    assert float(average_path(1)) == 0 and float(average_path(2)) == 1
    assert abs(float(average_path(256)) - 10.2448) < 1e-3


def test_tree_isolates_every_point():
    points = np.arange(8.0).reshape(-1, 1)
    tree = grow_tree(points, 0, 0, 20)
    assert sum(n[1] < 0 for n in tree) == 8
    assert path_lengths(tree, points).min() >= 1
    assert len(grow_tree(np.ones((5, 2)), 0, 0, 8)) == 1


def test_space_is_prime_and_node_draws_are_those_of_columns(spark):
    witnesses = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    odd, twos = SPACE - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for w in witnesses:
        x = pow(w, odd, SPACE)
        assert x in (1, SPACE - 1) or any((x := x * x % SPACE) == SPACE - 1 for _ in range(twos - 1))
    got = spark.range(1).select(draw(42, F.lit(3), F.lit(17), F.lit("cut"))).first()[0]
    assert got == node_draw(42, 3, 17, "cut")


def test_scores_equal_a_walk_by_hand(spark):
    """Scores of the JVM are those of plain Python; null vectors have none, NaN goes right, and no Python worker scores."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(rng.normal(size=(300, 4)))] + [(300, None), (301, [float("nan")] * 4), (302, [1e9] * 4)]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    forest = IsolationForest(trees=20, sample=64).fit(df, "i", "v")
    scored = forest.score(df, "v")
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    assert forest.fitted == 64 and len(forest.model) == 20
    norm = float(average_path(64))
    for i, v, got in scored.collect():
        if v is None:
            assert got is None
            continue
        mean = sum(path_lengths(t, np.array([v]))[0] for t in forest.model) / 20
        assert abs(got - 2 ** (-mean / norm)) < 1e-9


def test_scores_in_batches_are_those_of_the_walk(spark):
    """To the last bit, for odd vectors too; batches of more rows than are walked at once."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(rng.normal(size=(1300, 5)))]
    fitted = spark.createDataFrame(rows, "i int, v array<double>")
    odd = [(2000, None), (2001, [float("nan")] * 5), (2002, [1e9] * 5), (2003, []), (2004, [0.1, None, 0.2, 0.3, -0.4]), (2005, [0.5]), (2006, [0.0] * 9)]
    forest = IsolationForest(trees=25, sample=64).fit(fitted, "i", "v")
    for df in (spark.createDataFrame(rows + odd, "i int, v array<double>").coalesce(1), fitted.coalesce(1), fitted.where("i < 0")):
        got = forest.score(df, "v", "batches", batches=True)
        assert "Python" in got._jdf.queryExecution().executedPlan().toString()
        both = forest.score(got, "v", "walk").collect()
        assert [r["batches"] for r in both] == [r["walk"] for r in both]


def test_projected_rows_are_walked_in_batches(spark, monkeypatch):
    from vulnwave.operators import emerging

    calls, score = [], IsolationForest.score
    monkeypatch.setattr(IsolationForest, "score", lambda *args, **how: calls.append(how) or score(*args, **how))
    df = spark.createDataFrame([(f"k{i}", f"word{i % 7} other{i % 3} common") for i in range(60)], "k string, clean_text string")
    assert emerging.with_isolation_flag(df, "k", trees=5).where("anomaly_score IS NULL").count() == 0
    assert calls == [{"batches": True}]


def test_a_forest_of_no_rows_scores_nothing(spark):
    df = spark.createDataFrame([], "i int, v array<double>")
    assert IsolationForest(trees=3).fit(df, "i", "v").score(df, "v").columns == ["i", "v", "anomaly_score"]
    one = spark.createDataFrame([(1, [2.0]), (2, [2.0])], "i int, v array<double>")
    scores = {r["anomaly_score"] for r in IsolationForest(trees=3).fit(one, "i", "v").score(one, "v").collect()}
    assert len(scores) == 1


def test_outliers_score_highest(spark):
    df = _cloud(spark)
    forest = IsolationForest(trees=40).fit(df, "i", "v")
    scored = forest.score(df, "v")
    top = [r["i"] for r in scored.orderBy(F.desc("anomaly_score")).limit(20).collect()]
    assert len(set(top) & set(range(20))) >= 18
    flagged = forest.flag(scored, "anomaly_score", 0.03).filter("if_flag").count()
    assert 55 <= flagged <= 60


def test_fit_is_repeatable(spark):
    df = _cloud(spark)
    a, b = (IsolationForest(trees=5).fit(d, "i", "v") for d in (df, df.repartition(3)))
    assert a.model == b.model and len(a.model) == 5


@pytest.mark.parametrize("n", [40, 1_000, 50_000])
def test_one_sampling_rule(spark, n):
    """Each tree draws for itself, at every size: the rows of the lowest hashes."""
    df = spark.range(n).select(F.col("id").alias("i"))
    rows = IsolationForest(trees=4, sample=64).sample_rows(df, "i")
    got = {}
    for r in rows.collect():
        got.setdefault(r["tree"], set()).add(r["i"])
    def lowest(t):
        def of(i):
            h = hashlib.md5(f"42:{i}".encode()).hexdigest()
            return (int(h[:13], 16) + t * int(h[13:26], 16)) % SPACE, i

        return set(sorted(range(n), key=of)[:64])

    assert got == {t: lowest(t) for t in range(4)}


def test_hash_split(spark):
    df = spark.range(10_000)
    train, test = classify.hash_split(df, "id")
    assert train.count() + test.count() == 10_000 and 1800 < test.count() < 2200
    assert train.intersect(test).count() == 0


def _labelled(spark):
    rows = []
    for i in range(300):
        a, b = i % 3 == 0, i % 2 == 0
        rows.append((f"d{i}", ("phish lure " if a else "plain talk ") + ("worm code" if b else "other code"), 0.1, None, int(a), int(b), 0))
    return spark.createDataFrame(
        rows, "key string, clean_text string, sentiment double, cvss_score double, label_A int, label_B int, label_C int"
    )


def test_classifier_learns_rules(spark, tmp_path):
    df = _labelled(spark)
    features = classify.FeatureModel.fit(df, max_features=50)
    assert features.numeric == ["sentiment", "cvss_score"]
    ready = features.assemble(features.transform(df))
    train, test = classify.hash_split(ready, "key")
    model = classify.ThreatClassifier.fit(train, "key", ["A", "B", "C"], trees=8, max_depth=5)
    out = model.predict(test)
    assert out.filter("pred_A <> label_A or pred_B <> label_B or pred_C <> 0").count() == 0
    assert out.filter("prob_A < 0 or prob_A > 1 or prob_C <> 0").count() == 0
    model.save(str(tmp_path / "m"))
    again = classify.ThreatClassifier.load(spark, str(tmp_path / "m")).predict(test)
    cols = ["key", "prob_A", "prob_B", "prob_C"]
    assert sorted(again.select(*cols).collect()) == sorted(out.select(*cols).collect())
    top = classify.feature_importance(spark, model, features.names(), 3)
    best = {r["category"]: r["feature"] for r in top.filter("rank = 1").collect()}
    assert best["A"] in {"phish", "lure", "plain", "talk", "phish lure", "plain talk", "lure worm", "lure other", "talk worm", "talk other"}
    groups = classify.importance_by_group(classify.feature_importance(spark, model, features.names(), None))
    assert all(abs(r[1] - 1) < 1e-6 for r in groups.groupBy("category").agg(F.sum("importance")).collect())


def test_tune_and_compare(spark):
    df = _labelled(spark)
    features = classify.FeatureModel.fit(df, max_features=30)
    ready = features.assemble(features.transform(df))
    table = classify.tune_forest(ready, "key", ["A", "B"], trees=[2], depths=[1, 4], min_splits=[2])
    rows = table.collect()
    assert len(rows) == 2 and rows[0]["f1_macro"] >= rows[1]["f1_macro"] > 0.9
    sets = classify.compare_feature_sets(df, features, "key", classes=["A", "B"], trees=3, max_depth=4)
    assert {r["feature_set"] for r in sets.collect()} == {"text", "text+numeric"}
