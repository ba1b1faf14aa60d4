import datetime as dt
import math
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vulnwave.functions.aggregates import exact_quantiles, latest
from vulnwave.functions.bins import level_bin, severity_bin
from vulnwave.operators import clustering, emerging, evaluation, labels, linking, reports, sentiment, sweeps, tfidf, urgency
from vulnwave.plans import assess as plan

DAY = dt.date(2024, 1, 1)


def test_severity_bin(spark):
    values = [3.9, 4.0, 6.9, 7.0, 8.9, 9.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    got = [r[0] for r in df.select(severity_bin("s")).collect()]
    assert got == ["low", "medium", "medium", "high", "high", "critical", "unknown", "unknown"]


def test_level_bin(spark):
    df = spark.createDataFrame([(v,) for v in [-0.1, 0.0, 0.33, 0.66, 1.0, 1.01, None]], "s double")
    assert [r[0] for r in df.select(level_bin("s")).collect()] == [None, "Low", "Medium", "High", "High", None, None]


# --- linking -----------------------------------------------------------------
def test_upsert(spark):
    schema = "cve_id string, last_modified date, v string"
    day = lambda n: dt.date(2024, 1, n)
    old = spark.createDataFrame([("A", day(2), "old")], schema)
    batch = spark.createDataFrame([("A", day(1), "x"), ("A", day(3), "new"), ("B", day(1), "b")], schema)
    once = linking.upsert(old, batch)
    rows = {r["cve_id"]: (r["last_modified"], r["v"]) for r in once.collect()}
    assert rows == {"A": (day(3), "new"), "B": (day(1), "b")}
    assert linking.upsert_counts(old, batch).first().asDict() == {"new_rows": 1, "modified_rows": 1}
    assert sorted(linking.upsert(once, batch).collect()) == sorted(once.collect())
    same = spark.createDataFrame([("A", day(2), "tie")], schema)
    assert linking.upsert(old, same).first()["v"] == "old"


def test_append_new(spark):
    schema = "url string, published_date date"
    batch = spark.createDataFrame([("u", DAY), ("u", DAY), ("v", DAY)], schema)
    got = linking.append_new(spark.createDataFrame([("v", DAY)], schema), batch)
    assert sorted(r["url"] for r in got.collect()) == ["u", "v"]


def test_links_of_a_hot_cve(spark):
    """A third of all edges on one CVE: nothing lost, lists stay bounded."""
    hot = spark.range(5_000).select(F.lit("HOT").alias("cve_id"), F.concat(F.lit("u"), "id").alias("url"))
    rest = spark.range(10_000).select(
        F.concat(F.lit("C"), F.col("id") % 3_000).alias("cve_id"), F.concat(F.lit("u"), "id").alias("url")
    )
    edges = hot.unionByName(rest).withColumn("published_date", F.lit(DAY))
    chunks = linking.link_chunks(edges, chunk=500)
    back = chunks.select("cve_id", F.explode("linked_articles").alias("url"))
    assert back.count() == 15_000 and back.exceptAll(edges.select("cve_id", "url")).count() == 0
    assert chunks.agg(F.max(F.size("linked_articles"))).first()[0] < 700
    nvd = spark.createDataFrame([("HOT",), ("C1",), ("none",)], "cve_id string")
    rows = {}
    for r in linking.link(nvd, edges, chunk=500).collect():
        rows.setdefault(r["cve_id"], []).append(r)
    urls = [u for r in rows["HOT"] for u in r["linked_articles"]]
    assert len(urls) == len(set(urls)) == 5_000 and {r["n_articles"] for r in rows["HOT"]} == {5_000}
    assert sorted(r["part"] for r in rows["HOT"]) == list(range(10))
    assert [(r["n_articles"], len(r["linked_articles"])) for r in rows["C1"]] == [(4, 4)]
    assert [(r["n_articles"], r["part"], r["linked_articles"]) for r in rows["none"]] == [(0, 0, [])]


def test_link_counts_add_up(spark):
    a = spark.createDataFrame(
        [("u1", DAY, ["CVE-2020-0001", "cve-2020-0001"], "x CVE-2020-0002"), ("u2", DAY, None, "cve-2020-0001")],
        "url string, published_date date, cves array<string>, text string",
    )
    edges = linking.article_cve_edges(a)
    assert {(r["cve_id"], r["url"]) for r in edges.collect()} == {
        ("CVE-2020-0001", "u1"), ("CVE-2020-0002", "u1"), ("CVE-2020-0001", "u2"),
    }
    assert linking.link_counts(edges).agg(F.sum("n_articles")).first()[0] == edges.count()


def test_latest_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y")], "k string, v int, s string")
    assert {tuple(r) for r in latest(df, ["k"], [F.col("v")]).collect()} == {("a", 2, "x"), ("b", 1, "y")}


def test_fetch_ranges(spark):
    marks = linking.high_water(spark.createDataFrame([], "published_date date, last_modified date"))
    assert marks.first()["latest_published"] == dt.date(2000, 1, 1)
    rows = linking.fetch_ranges(marks, "latest_published", "2000-06-01").orderBy("range_start").collect()
    assert rows[0]["range_start"] == dt.datetime(2000, 1, 1, 0, 0, 1)
    assert rows[-1]["range_end"] == dt.datetime(2000, 6, 1)
    for a, b in zip(rows, rows[1:]):
        assert b["range_start"] - a["range_end"] == dt.timedelta(milliseconds=1)
    assert linking.fetch_ranges(marks, "latest_published", "1999-01-01").count() == 0


# --- urgency -----------------------------------------------------------------
def test_factors_of_nothing(spark):
    df = spark.createDataFrame(
        [(None, None, None, None)], "cvss_score double, sentiment double, clean_text string, published_date date"
    )
    r = urgency.urgency_factors(df, "2024-01-01").first()
    assert (r["f_severity"], r["f_sentiment"], r["f_exploit"], r["f_patch"], r["f_articles"]) == (0, 0.5, 0, 1, 0)
    assert math.isclose(r["f_recency"], math.exp(-365 / 30)) and r["f_days_old"] == 365


def test_urgency_like_pandas(spark):
    rng = np.random.default_rng(3)
    n = 200
    pdf = pd.DataFrame(
        {
            "cvss_score": np.where(rng.random(n) < 0.1, np.nan, rng.uniform(0, 10, n).round(1)),
            "sentiment": rng.uniform(-1, 1, n),
            "clean_text": rng.choice(["exploit here", "patch out", "nothing", "poc and fix"], n),
            "published_date": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 400, n), unit="D"),
            "n_articles": rng.integers(0, 30, n),
        }
    )
    now = pd.Timestamp("2024-08-01")
    want = (
        pdf.cvss_score.fillna(0) / 10 * 0.45 + (pdf.sentiment + 1) / 2 * 0.15
        + pdf.clean_text.str.contains("exploit|poc") * 0.05 + (1 - pdf.clean_text.str.contains("patch|fix")) * 0.25
        + np.exp(-((now - pdf.published_date).dt.days.clip(lower=0)) / 30) * 0.05
        + np.log1p(pdf.n_articles) / np.log1p(10) * 0.05
    )
    df = spark.createDataFrame(pdf.assign(i=range(n)))
    got = plan.assess(df, "2024-08-01").orderBy("i").toPandas()
    assert np.allclose(got.urgency_score, want)


def test_a_text_that_fails_leaves_the_others_alone(spark):
    def load():
        def model(texts):
            if texts.str.contains("bad").any():
                raise ValueError("bad text")
            return texts.str.len() / 10.0

        return model

    df = spark.createDataFrame([(i, "bad" if i == 7 else "x" * (i % 5)) for i in range(100)], "i int, clean_text string").coalesce(1)
    rows = sentiment.sentiment(df, scorer=load, failed="failed").collect()
    assert [r["i"] for r in rows if r["failed"]] == [7]
    assert all(r["sentiment"] == (0.0 if r["i"] == 7 else min(1.0, r["i"] % 5 / 10)) for r in rows)


def test_sentiment_sign(spark):
    df = spark.createDataFrame([(-1.0, "t", DAY, 0.0)], "sentiment double, clean_text string, published_date date, cvss_score double")
    assert urgency.urgency_factors(df, DAY, sentiment_sign=-1).first()["f_sentiment"] == 1.0
    assert urgency.urgency_factors(df, DAY).first()["f_sentiment"] == 0.0


# --- labels and evaluation ---------------------------------------------------
def test_seed_labels(spark):
    rows = [("CWE-79: Cross-site Scripting", "a worm"), ("CWE-1", "nothing"), (None, "zero-day ransom"), ("CWE-89", None)]
    df = spark.createDataFrame(rows, "cwe string, t string")
    got = [r[0] for r in df.select(labels.seed_labels("t")).collect()]
    assert got == [["Malware", "XSS"], ["Other"], ["Ransomware", "ZeroDay"], ["SQLInjection"]]
    assert [r[0] for r in df.select(labels.seed_labels("t", None)).collect()][0] == ["Malware"]


def test_report_of_perfect_and_empty(spark):
    df = spark.createDataFrame([(1, 0, 1, 0), (0, 0, 0, 0)], "label_A int, label_B int, pred_A int, pred_B int")
    rows = {r["name"]: r for r in evaluation.classification_report(df, ["A", "B"]).collect()}
    assert (rows["A"]["f1"], rows["B"]["f1"], rows["B"]["support"]) == (1.0, 0.0, 0)
    assert rows["micro avg"]["f1"] == 1.0 and rows["macro avg"]["f1"] == 0.5 and rows["samples avg"]["f1"] == 0.5


def test_cooccurrence_and_correlation(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (0, 0, 0)], "label_A int, label_B int, label_C int")
    co = {(r[0], r[1]): r[2] for r in labels.cooccurrence(df, ["A", "B", "C"]).collect()}
    assert co[("A", "A")] == 2 and co[("A", "B")] == co[("B", "A")] == 1 and co[("C", "C")] == 0
    corr = {(r[0], r[1]): r[2] for r in labels.label_correlation(df, ["A", "B", "C"]).collect()}
    assert math.isclose(corr[("A", "B")], np.corrcoef([1, 1, 0], [1, 0, 0])[0, 1]) and corr[("A", "C")] is None


# --- emerging ----------------------------------------------------------------
def _days(spark, counts):
    rows = [(DAY + dt.timedelta(days=i), c) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "day date, x bigint")


def test_spike_needs_ten_days_before(spark):
    assert emerging.spike_days(_days(spark, [1] * 10 + [100])).count() == 1
    assert emerging.spike_days(_days(spark, [1] * 9 + [100])).count() == 0


def test_spike_exact_for_huge_counts(spark):
    big = 10**12
    assert emerging.spike_days(_days(spark, [big] * 10 + [big + 1])).count() == 1
    assert emerging.spike_days(_days(spark, [big, big + 1] * 10)).count() == 0


def test_spikes_like_pandas(spark):
    rng = np.random.default_rng(5)
    counts = rng.poisson(5, 200)
    counts[rng.choice(200, 6, replace=False)] += 40
    s = pd.Series(counts)
    roll = s.rolling(30, min_periods=5)
    want = set(s[(s - roll.mean()) > 3 * roll.std()].index)
    got = {(r["day"] - DAY).days for r in emerging.spike_days(_days(spark, [int(c) for c in counts])).collect()}
    assert got == want


def test_fill_gaps(spark):
    daily = spark.createDataFrame([(DAY, 3), (DAY + dt.timedelta(days=3), 1)], "day date, x bigint")
    assert [r["x"] for r in emerging.fill_days(daily).orderBy("day").collect()] == [3, 0, 0, 1]


def test_overlaps_add_up(spark):
    df = spark.range(64).select(
        (F.col("id") % 2 == 0).alias("zero_day_flag"), (F.col("id") % 3 == 0).alias("spike_flag"),
        (F.col("id") % 5 == 0).alias("if_flag"),
    )
    r = emerging.detection_overlap(emerging.emerging(df)).first().asDict()
    parts = ["only_zero_day", "only_spike", "only_isolation", "zero_day_spike", "zero_day_isolation", "spike_isolation", "all_three"]
    assert sum(r[p] for p in parts) == r["emerging"]


# --- aggregates --------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 3, 50, 25_000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = rng.choice([rng.normal(), 1.0, 2.5], n) if n == 50 else rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert math.isclose(got[p], np.quantile(values, p), rel_tol=1e-12, abs_tol=1e-12)


def test_exact_quantiles_with_a_hot_value(spark):
    values = np.concatenate([np.zeros(20_000), np.random.default_rng(1).normal(size=20_001)])
    pdf = pd.DataFrame({"v": values, "g": ["a"] * 20_000 + [None] * 20_001})
    df = spark.createDataFrame(pdf)
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "v", [0.3, 0.5, 0.8]).collect()}
    assert all(math.isclose(got[p], np.quantile(values, p), abs_tol=1e-12) for p in got)
    by = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert by[("a", 0.5)] == 0.0 and math.isclose(by[(None, 0.5)], np.quantile(values[20_000:], 0.5))


def test_histogram_counts_all(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    rows = reports.histogram(df, "v", 10).orderBy("bin").collect()
    assert sum(r["n"] for r in rows) == 101 and rows[-1]["n"] == 11
    flat = spark.createDataFrame([(1.0,)] * 3, "v double")
    assert reports.histogram(flat, "v", 3).agg(F.sum("n")).first()[0] == 3


def test_week_end(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 1, 8),)], "d date")
    assert [r[0] for r in df.select(reports.week_end("d")).collect()] == [dt.date(2024, 1, 7), dt.date(2024, 1, 14)]


# --- sweeps ------------------------------------------------------------------
def test_weight_grids():
    combos = sweeps.weight_combinations()
    assert len(combos) == 70
    assert all(math.isclose(sum(v for k, v in c.items() if k != "combo"), 1.0) for c in combos)
    assert len(sweeps.sensitivity_settings(sweeps.fixed.TUNING_WEIGHTS)) == 66


def test_elbow_on_a_bend(spark):
    rows = [(0.01 * i, 10.0 - i if i < 5 else 5.0) for i in range(10)]
    e = sweeps.elbow(spark.createDataFrame(rows, "contamination double, cut double")).first()
    assert math.isclose(e["elbow"], 0.05) and math.isclose(e["level_off"], 0.05)


def test_elbow_of_a_flat_curve(spark):
    rows = [(0.01 * i, 1.0) for i in range(5)]
    e = sweeps.elbow(spark.createDataFrame(rows, "contamination double, cut double")).first()
    assert math.isclose(e["elbow"], 0.01) and math.isclose(e["level_off"], 0.01)


# --- text features -----------------------------------------------------------
def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "flaw flaw patch"), (2, "flaw")], "i int, t string")
    vocab = tfidf.vocabulary(docs, "t")
    got = {(r["doc_key"], r["term"]): r["weight"] for r in tfidf.tfidf(docs, vocab, "i", "t").collect()}
    a, b = 2.0 * 1.0, math.log(3 / 2) + 1
    assert math.isclose(got[(1, "flaw")], a / math.hypot(a, b)) and math.isclose(got[(2, "flaw")], 1.0)
    bounded = tfidf.tfidf(docs, vocab, "i", "t", max_features=10)
    assert {(r["doc_key"], r["term"]): round(r["weight"], 9) for r in bounded.collect()} == {k: round(v, 9) for k, v in got.items()}


def _hot_docs(spark, n=400):
    """One word in every document, others in a few: the word holds a third of all postings."""
    return spark.range(n).select("id", F.concat(F.lit("common word"), F.col("id") % 40, F.lit(" rare"), "id").alias("t"))


def test_unbounded_vocabulary_joins_every_posting(spark, monkeypatch):
    docs = _hot_docs(spark)
    vocab = tfidf.vocabulary(docs, "t")
    want = {(r["doc_key"], r["term"]): round(r["weight"], 9) for r in tfidf.tfidf(docs, vocab, "id", "t").collect()}
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(tfidf, "HOT_SHARE", 10)
    split = tfidf.tfidf(docs, vocab, "id", "t")
    assert {(r["doc_key"], r["term"]): round(r["weight"], 9) for r in split.collect()} == want
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and len(want) == 1200


def test_broadcast_only_when_small(spark):
    from vulnwave.session import checked_broadcast

    df = spark.range(20)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(checked_broadcast(df, 20)) and not hinted(checked_broadcast(df, 19))


def test_lookup_without_broadcast(spark, monkeypatch):
    from vulnwave.sources import nvd

    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, "CWE-1").otherwise(F.concat(F.lit("CWE-"), "id")).alias("cwe"))
    catalog = spark.createDataFrame([("CWE-1", "one"), ("CWE-1", "one"), ("CWE-4", "four")], "cwe_id string, text string")
    monkeypatch.setattr(nvd, "checked_broadcast", lambda d: d)
    got = {r["cwe"]: r["n"] for r in nvd.describe_cwe(df, catalog).groupBy("cwe").agg(F.count("*").alias("n")).collect()}
    assert got["CWE-1: one"] == 101 and got["CWE-4: four"] == 1 and sum(got.values()) == 300


def test_vector_and_long_form_agree(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma{i % 5} alpha") for i in range(30)], "i int, t string")
    model = tfidf.TfidfModel.fit(docs, "t", min_df=1, max_df=1.0)
    vectors = {r["i"]: r["tfidf"] for r in model.transform(docs, "t").collect()}
    for r in tfidf.tfidf(docs, tfidf.vocabulary(docs, "t"), "i", "t").collect():
        assert math.isclose(vectors[r["doc_key"]][model.terms.index(r["term"])], r["weight"])


def test_projection_of_a_batch_in_pieces():
    r = np.random.default_rng(4)
    lengths = np.array([0, 3, 500, 1, 0, 40] * 300)
    slots = np.concatenate([np.sort(r.choice(500, n, replace=False)) for n in lengths])
    weights = r.normal(size=len(slots))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (slots.astype(np.int32), weights)]
    vectors = pa.StructArray.from_arrays(lists, names=["indices", "values"])
    dense = np.zeros((len(lengths), 500))
    dense[np.repeat(np.arange(len(lengths)), lengths), slots] = weights
    want = dense @ tfidf.projection_matrix(500, 16, 42)
    for entries in (1, 100, 10**9):
        got = tfidf.projected(vectors, tfidf.projection_signs(500, 16, 42), 16, entries)
        assert np.allclose(got.flatten().to_numpy().reshape(-1, 16), want)
    tracemalloc.start()
    tfidf.projected(vectors, tfidf.projection_signs(500, 256, 42), 256, 1_000)
    assert tracemalloc.get_traced_memory()[1] < 12_000_000  # the result is 3.7 MB
    tracemalloc.stop()


def test_projection_is_linear(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma{i % 5}") for i in range(30)] + [(30, "")], "i int, t string")
    model = tfidf.TfidfModel.fit(docs, "t", min_df=1, max_df=1.0)
    rows = tfidf.random_projection(model.transform(docs, "t"), "tfidf", len(model.terms), 16).collect()
    matrix = tfidf.projection_matrix(len(model.terms), 16, 42)
    for r in rows:
        assert np.allclose(r["projected"], r["tfidf"].toArray() @ matrix)


def test_lexicon_and_scorer(spark):
    df = spark.createDataFrame([("patched and secure",), ("malware attack fixed",), ("plain",), (None,)], "clean_text string")
    assert [round(r["sentiment"], 6) for r in sentiment.sentiment(df).collect()] == [1.0, round(-1 / 3, 6), 0.0, 0.0]

    def load():
        return lambda s: s.str.len() / 10.0 if not s.str.contains("malware").any() else 1 / 0

    got = [r["sentiment"] for r in sentiment.sentiment(df.filter("clean_text = 'plain'"), scorer=load).collect()]
    assert got == [0.5]
    assert [r["sentiment"] for r in sentiment.sentiment(df.filter("clean_text like 'mal%'"), scorer=load).collect()] == [0.0]


# --- clusters ----------------------------------------------------------------
def _points(spark, n=60, k=3):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 4)) + np.repeat(np.eye(4)[:k] * 4, n // k, axis=0)
    lab = np.repeat(np.arange(k), n // k)
    lab[0] = 99
    return x, lab, spark.createDataFrame([(i, int(c), [float(v) for v in p]) for i, (p, c) in enumerate(zip(x, lab))], "vec_id int, label int, embedding array<double>")


def _silhouette(d, lab):
    s = []
    for i in range(len(lab)):
        own = (lab == lab[i]) & (np.arange(len(lab)) != i)
        if not own.any():
            s.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouettes(spark):
    x, lab, df = _points(spark)
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert math.isclose(clustering.silhouette(df, "label").first()[0], _silhouette(d2, lab), abs_tol=1e-9)
    got = clustering.silhouette_sample(df, "vec_id", "label", n=100).first()
    assert got["n"] == 60 and math.isclose(got["silhouette"], _silhouette(np.sqrt(d2), lab), abs_tol=1e-9)


def test_kmeans_finds_clusters(spark):
    _, _, df = _points(spark)
    found = clustering.kmeans(df, k=3).filter("label < 99").groupBy("label").agg(F.count_distinct("cluster")).collect()
    assert all(r[1] == 1 for r in found)


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert clustering.sample(df, "id", 10).collect() == clustering.sample(df.repartition(7), "id", 10).collect()
    assert {r["count"] for r in clustering.sample(df, "id", 4, by=["g"]).groupBy("g").count().collect()} == {4}


def test_postings_of_frequent_terms_stay_with_their_documents(spark, monkeypatch):
    r = np.random.default_rng(2)
    words = [f"w{int(x)}" for x in r.zipf(1.3, 3_000) if x < 400]
    docs = spark.createDataFrame([(i % 97, " ".join(words[i : i + 25])) for i in range(0, len(words), 20)], "id long, t string")
    vocab = tfidf.vocabulary(docs, "t", min_df=1)
    read = lambda df: sorted((*x[:3], round(x["weight"], 9)) for x in df.collect())
    want = read(tfidf.tfidf(docs, vocab, "id", "t"))
    tops = lambda: sorted((*x[:3], round(x["mean_weight"], 9)) for x in sweeps.tfidf_sweep_top_terms(docs, "id", "t").select("min_df", "max_df", "term", "mean_weight").collect())
    best = tops()
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(tfidf, "HOT_SHARE", 50)
    parted = tfidf.tfidf(docs, vocab, "id", "t")
    assert "Union" in parted._jdf.queryExecution().optimizedPlan().toString() and read(parted) == want
    assert tops() == best
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan_ = tfidf.tfidf(docs, vocab, "id", "t")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    back = [x for x in plan_.splitlines() if "hashpartitioning(doc_key" in x and "ENSURE_REQUIREMENTS" in x]
    assert not back  # neither the frequent terms' postings nor all of them are shuffled for the lengths
