"""Fitted models: isolation forest, classifier, clusters, projections, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.draws import draw_sql
from ..operators import classify, clustering, emerging, evaluation
from ..operators.isolation import EULER, SPACE, IsolationForest
from ..plans import assess as plan
from ..session import cut_lineage, scratch_path
from . import tables as t
from .registry import query
from .scoring import CONTAMINATION_SELECT, contamination_rows, contamination_sql


def _r(c: str, places: int = 6):
    return F.round(c, places).alias(c)


# --- isolation forest --------------------------------------------------------
def _forest_sql(table: str, key: str, vector: str, contamination: float, forest: IsolationForest, final: str = "") -> str:
    """Samples, trees level by level, walks and flags in SQL: key, anomaly_score, if_flag."""
    deep, piece = forest.depth_limit, "('0x' || substr(md5('{seed}:' || {key}), {at}, 13))::BIGINT"
    a, b = (piece.format(seed=forest.seed, key=key, at=at) for at in (1, 14))
    parts = [
        f"rows AS MATERIALIZED (SELECT {key} AS key, {vector}::DOUBLE[] AS x, {a} AS a, {b} AS b FROM {table} WHERE {vector} IS NOT NULL)",
        f"trees AS (SELECT unnest(range({forest.trees})) AS tree)",
        f"""level0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS node, x FROM (SELECT tree, x, row_number() OVER
            (PARTITION BY tree ORDER BY (a + tree * b) % {SPACE}, key) AS place FROM rows, trees) WHERE place <= {forest.sample})""",
        "walk0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS node, key, x FROM rows, trees)",
    ]
    child = "CASE WHEN x[feature] <= cut THEN 2 * node ELSE 2 * node + 1 END"
    u = {w: draw_sql(forest.seed, "tree", "node", f"'{w}'") for w in ("feature", "cut")}
    for d in range(deep):
        parts += [
            f"sides{d} AS (SELECT tree, node, i, min(v) AS low, max(v) AS high FROM (SELECT tree, node, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM level{d}) GROUP BY ALL)",
            f"spread{d} AS (SELECT tree, node, list({{'i': i, 'low': low, 'high': high}} ORDER BY i) AS s FROM sides{d} WHERE high > low GROUP BY ALL)",
            f"picked{d} AS (SELECT tree, node, s[1 + floor({u['feature']} * len(s))::BIGINT] AS p, {u['cut']} AS u FROM spread{d})",
            f"""inner{d} AS MATERIALIZED (SELECT tree, node, p.i AS feature,
                CASE WHEN p.low + u * (p.high - p.low) < p.high THEN p.low + u * (p.high - p.low) ELSE p.low END AS cut FROM picked{d})""",
            f"level{d + 1} AS MATERIALIZED (SELECT tree, {child} AS node, x FROM level{d} JOIN inner{d} USING (tree, node))",
            f"walk{d + 1} AS MATERIALIZED (SELECT tree, CASE WHEN cut IS NULL THEN node ELSE {child} END AS node, key, x FROM walk{d} LEFT JOIN inner{d} USING (tree, node))",
        ]
    mean = f"2 * (ln(n - 1) + {t.dbl(EULER)}) - 2 * (n - 1) / n::DOUBLE"
    c = f"CASE WHEN n > 2 THEN {mean} WHEN n = 2 THEN 1 ELSE 0 END"
    leaves = [
        f"SELECT tree, node, {d} + {c} AS path FROM (SELECT tree, node, count(*) AS n FROM level{d}"
        + (f" ANTI JOIN inner{d} USING (tree, node)" if d < deep else "") + " GROUP BY ALL)"
        for d in range(deep + 1)
    ]
    parts += [
        f"leaves AS MATERIALIZED ({' UNION ALL '.join(leaves)})",
        f"norm AS (SELECT {c} AS norm FROM (SELECT least(count(*), {forest.sample}) AS n FROM rows))",
        f"means AS (SELECT key, list_sum(list(path ORDER BY tree)) / {t.dbl(float(forest.trees))} AS path FROM walk{deep} JOIN leaves USING (tree, node) GROUP BY key)",
        "scores AS MATERIALIZED (SELECT key, pow(2, -path / norm) AS score FROM means, norm)",
        f"cut AS (SELECT quantile_cont(score, {t.dbl(1.0 - contamination)}) AS bound FROM scores)",
    ]
    final = final or f"SELECT key AS {key}, round(score, 9) AS anomaly_score, score > bound AS if_flag FROM scores, cut"
    return f"WITH {', '.join(parts)} {final}"


@query(_forest_sql("embeddings", "vec_id", "embedding", 0.03, IsolationForest()))
def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    """Scores and flags of all embeddings."""
    e = t.read(spark, d, "embeddings")
    forest = IsolationForest().fit(e, "vec_id", "embedding")
    scored = forest.score(e.select("vec_id", "embedding"), "embedding").drop("embedding")
    return forest.flag(cut_lineage(scored), "anomaly_score", 0.03).select("vec_id", _r("anomaly_score", 9), "if_flag")


@query(
    contamination_sql(CONTAMINATION_SELECT, events=_forest_sql("embeddings", "vec_id", "embedding", 0.03, IsolationForest(), "SELECT score AS value FROM scores"))
)
def contamination_forest(spark: SparkSession, d: str) -> DataFrame:
    """The sweep of contaminations over the scores of a forest of all embeddings."""
    e = t.read(spark, d, "embeddings")
    return contamination_rows(IsolationForest().fit(e, "vec_id", "embedding").score(e, "embedding"), "anomaly_score")


@query()
def isolation_flag_text(spark: SparkSession, d: str) -> DataFrame:
    """Scores and flags of all documents, from projected TF-IDF vectors."""
    docs = t.documents(spark, d).select("doc_id", F.col("text").alias("clean_text"))
    flagged = emerging.with_isolation_flag(docs, "doc_id")
    return flagged.select("doc_id", "anomaly_score", "if_flag")


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tagged = t.edges(spark, d).groupBy("url").agg(F.collect_set("cve_id").alias("cves"))
    news = t.articles(spark, d).select("source", "text", "published_date", "url").join(tagged, "url", "left")
    news = news.withColumn("source", F.lit(fixed.SOURCE_NEWS))
    return t.vuln(spark, d, spread=True).drop("sentiment"), news


def _master(spark: SparkSession, d: str) -> DataFrame:
    return plan.build_master(*_raw(spark, d))


@query()
def detect_emerging(spark: SparkSession, d: str) -> DataFrame:
    """All stages from raw rows: master, urgency, flags."""
    found = plan.detect(plan.assess(_master(spark, d), t.AS_OF))
    return found.select(
        "doc_key", "source", "urgency_score", "urgency_level", "zero_day_flag", "spike_flag", "if_flag", "emerging"
    )


@query(  # an article of which cleaning leaves nothing isn't in the master
    t.with_views("edges", f"SELECT cve_id AS doc_key, url FROM edges JOIN articles USING (url) WHERE trim({t.sql_clean('articles.text')}) <> ''")
)
def master_links(spark: SparkSession, d: str) -> DataFrame:
    """Every link of the master's CVEs, a row each."""
    return plan.links_of(*_raw(spark, d)).select("doc_key", F.explode("linked_articles").alias("url"))


# --- classifier --------------------------------------------------------------
def _features(spark: SparkSession, d: str) -> tuple[classify.FeatureModel, DataFrame]:
    rows = t.labelled(spark, d).select(
        "k", "cve_id", "clean_text", "sentiment", "cvss_score", "n_articles", *[f"label_{c}" for c in fixed.CATEGORIES]
    )
    vectors = t.read(spark, d, "embeddings").select("vec_id", "embedding")
    rows = rows.withColumn("vec_id", F.col("k") % F.lit(vectors.count())).join(vectors, "vec_id").drop("k", "vec_id")
    rows = cut_lineage(rows)
    return classify.FeatureModel.fit(rows, embedding="embedding"), rows


@query()
def assemble_features(spark: SparkSession, d: str) -> DataFrame:
    """Text, numeric and embedding parts in one vector; its length and number of filled slots."""
    from pyspark.ml.functions import vector_to_array

    model, rows = _features(spark, d)
    ready = model.assemble(model.transform(rows))
    values = vector_to_array("features")
    return ready.select("cve_id", F.size(values).alias("size"), F.size(F.filter(values, lambda x: x != 0)).alias("filled"))


@query(
    t.with_views("vuln", f"SELECT cve_id, CASE WHEN {draw_sql(42, 'cve_id')} >= 0.2 THEN 'train' ELSE 'test' END AS part FROM vuln")
)
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    train, test = classify.hash_split(t.vuln(spark, d).select("cve_id"), "cve_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _trained(spark: SparkSession, d: str):
    model, rows = _features(spark, d)
    ready = model.assemble(model.transform(rows))
    train, test = classify.hash_split(ready, "cve_id")
    return model, classify.ThreatClassifier.fit(train, "cve_id"), test


@query()
def threat_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities and answers on the hold-out rows."""
    _, fitted, test = _trained(spark, d)
    scored = fitted.predict(test)
    return scored.select("cve_id", *[f"{p}{c}" for c in fixed.CATEGORIES for p in ("prob_", "pred_")])


@query(t.with_views("vuln", f"SELECT cve_id, true AS same FROM vuln WHERE {draw_sql(42, 'cve_id')} < 0.2"))
def saved_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Features and forests saved and loaded again: new rows, from their texts on, score as before."""
    features, rows = _features(spark, d)
    train, test = classify.hash_split(rows, "cve_id")
    fitted = classify.ThreatClassifier.fit(features.assemble(features.transform(train)), "cve_id")
    path = scratch_path(spark, "classifier")
    features.save(f"{path}/features")
    fitted.save(f"{path}/forests")
    again = classify.FeatureModel.load(spark, f"{path}/features")
    forests = classify.ThreatClassifier.load(spark, f"{path}/forests")
    # Each row is scored twice where it is: an id may stand on several rows, so a join by id would pair them all.
    before = fitted.predict(features.assemble(features.transform(test)))
    texts = before.select(*test.columns, *[f"prob_{c}" for c in fixed.CATEGORIES])
    both = forests.predict(again.assemble(again.transform(texts)), prob="again_", pred="answer_")
    same = reduce(lambda a, b: a & b, [F.col(f"prob_{c}") == F.col(f"again_{c}") for c in fixed.CATEGORIES])
    return both.select("cve_id", same.alias("same"))


@query()
def threat_classifier_report(spark: SparkSession, d: str) -> DataFrame:
    _, fitted, test = _trained(spark, d)
    return evaluation.classification_report(fitted.predict(test))


@query()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    model, fitted, _ = _trained(spark, d)
    return classify.feature_importance(spark, fitted, model.names())


@query()
def importance_by_group(spark: SparkSession, d: str) -> DataFrame:
    model, fitted, _ = _trained(spark, d)
    return classify.importance_by_group(classify.feature_importance(spark, fitted, model.names(), None))


@query()
def term_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = cut_lineage(t.flagged(spark, d).select("cve_id", "clean_text", "emerging"))
    return classify.term_importance(rows, "emerging", "cve_id")


@query()
def compare_feature_sets(spark: SparkSession, d: str) -> DataFrame:
    model, rows = _features(spark, d)
    return classify.compare_feature_sets(rows, model, "cve_id")


@query()
def tune_forest(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid over three hash folds of all rows, for all categories."""
    model, rows = _features(spark, d)
    return classify.tune_forest(model.assemble(model.transform(rows)), "cve_id")


# --- clusters ----------------------------------------------------------------
@query()
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    return clustering.kmeans(t.read(spark, d, "embeddings")).select("vec_id", "cluster")


_E = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(
    f"""{_E}, p AS (SELECT a.vec_id, a.label, b.label AS other, sum(pow(list_distance(a.v, b.v), 2)) AS s, count(*) AS n FROM e a, e b GROUP BY 1, 2, 3),
    ab AS (SELECT vec_id, max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b
      FROM p GROUP BY vec_id)
    SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab"""
)
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return clustering.silhouette(t.read(spark, d, "embeddings"), "label").select(_r("silhouette"))


@query()
def silhouette_sample(spark: SparkSession, d: str) -> DataFrame:
    """Plain-distance silhouette of the 500-row sample the tuning report takes."""
    return clustering.silhouette_sample(t.read(spark, d, "embeddings"), "vec_id", "label")


@query(
    f"""{_E}, x AS (SELECT label, unnest(range(1, 65)) AS i, v FROM e), l AS (SELECT label, i, v[i] AS x FROM x),
    m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM l GROUP BY 1, 2), o AS (SELECT i, avg(x) AS o FROM l GROUP BY 1),
    w AS (SELECT sum(pow(x - m, 2)) AS w FROM l JOIN m USING (label, i)), b AS (SELECT sum(n * pow(m - o, 2)) AS b FROM m JOIN o USING (i)),
    c AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM e)
    SELECT round(b / w * (n - k) / (k - 1)::DOUBLE, 6) AS calinski_harabasz FROM w, b, c"""
)
def calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    return clustering.calinski_harabasz(t.read(spark, d, "embeddings"), "label").select(_r("calinski_harabasz"))


@query(
    f"""{_E}, s AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
    p AS (SELECT a.label, sum(list_cosine_similarity(a.v, b.v)) AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1)
    SELECT s.label AS cluster, n, round(CASE WHEN n > 1 THEN c / (n * (n - 1)) ELSE 0 END, 6) AS mean_cosine FROM s LEFT JOIN p USING (label)"""
)
def within_cluster_cosine(spark: SparkSession, d: str) -> DataFrame:
    w = clustering.within_cluster_cosine(t.read(spark, d, "embeddings"), "label")
    return w.select("cluster", "n", _r("mean_cosine"))


@query(
    f"""{_E}, s AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
    p AS (SELECT a.label, sum(list_cosine_similarity(a.v, b.v)) AS c FROM e a JOIN e b ON a.label = b.label GROUP BY 1)
    SELECT s.label AS cluster, n, round(CASE WHEN n > 1 THEN c / (n * (n - 1)) ELSE 0 END, 6) AS mean_cosine FROM s JOIN p USING (label)"""
)
def within_cluster_cosine_compat(spark: SparkSession, d: str) -> DataFrame:
    w = clustering.within_cluster_cosine(t.read(spark, d, "embeddings"), "label", reference_compat=True)
    return w.select("cluster", "n", _r("mean_cosine"))


@query()
def project_2d(spark: SparkSession, d: str) -> DataFrame:
    return clustering.project_2d(t.read(spark, d, "embeddings")).select("vec_id", "label", "x", "y")


@query(f"SELECT doc_id, lang FROM documents ORDER BY {draw_sql(42, 'doc_id')}, doc_id LIMIT 50")
def sample(spark: SparkSession, d: str) -> DataFrame:
    return clustering.sample(t.documents(spark, d), "doc_id", 50).select("doc_id", "lang")


@query(
    f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source
        ORDER BY {draw_sql(42, 'doc_id')}, doc_id) AS nth FROM documents) WHERE nth <= 5"""
)
def sample_per_source(spark: SparkSession, d: str) -> DataFrame:
    return clustering.sample(t.documents(spark, d), "doc_id", 5, by=["source"]).select("doc_id", "source")
