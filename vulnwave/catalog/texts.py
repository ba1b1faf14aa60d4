"""Text cleaning, terms, TF-IDF and embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.draws import draw_sql
from ..operators import clustering, sentiment, sweeps, tfidf
from ..session import cut_lineage
from . import tables as t
from .registry import query


def _r(c: str, places: int = 6):
    return F.round(c, places).alias(c)


# --- cleaning ----------------------------------------------------------------
@query(f"SELECT page_id, {t.sql_clean_html('html')} AS text FROM pages")
def clean_html(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "pages", spread=True).select("page_id", tx.clean_html("html").alias("text"))


@query(f"SELECT doc_id, {t.sql_mask_generic('text')} AS masked FROM documents")
def mask_generic(spark: SparkSession, d: str) -> DataFrame:
    return t.documents(spark, d).select("doc_id", tx.mask_generic("text").alias("masked"))


@query(t.with_views("vuln", f"SELECT cve_id, {t.sql_mask_domain('description')} AS masked FROM vuln"))
def mask_domain(spark: SparkSession, d: str) -> DataFrame:
    return t.vuln(spark, d).select("cve_id", tx.mask_domain("description").alias("masked"))


@query(
    t.with_views("vuln", f"SELECT cve_id, {t.sql_mask_domain('description', True)} AS masked FROM vuln")
)
def mask_domain_reference_order(spark: SparkSession, d: str) -> DataFrame:
    masked = tx.mask_domain("description", reference_order=True)
    return t.vuln(spark, d).select("cve_id", masked.alias("masked"))


@query(f"SELECT doc_id, array_to_string({t.sql_tokens('text')}, ' ') AS words FROM documents")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_join(tx.tokens("text"), " ")
    return t.documents(spark, d).select("doc_id", words.alias("words"))


_EXCEPTIONS = "MAP {" + ", ".join(f"{t.q(k)}: {t.q(v)}" for k, v in fixed.LEMMA_EXCEPTIONS.items()) + "}"


@query(
    f"""SELECT doc_id, array_to_string(list_transform({t.sql_tokens('text')}, lambda w: CASE
        WHEN w IN {t.sql_list(list(fixed.LEMMA_EXCEPTIONS))} THEN ({_EXCEPTIONS})[w]
        WHEN NOT regexp_matches(w, '^[a-z]{{4,}}$') THEN w
        WHEN regexp_matches(w, '(?:ss|us|is)$') OR NOT ends_with(w, 's') THEN w
        WHEN ends_with(w, 'ies') THEN regexp_replace(w, 'ies$', 'y')
        WHEN regexp_matches(w, '(?:sses|xes|zzes|ches|shes)$') THEN regexp_replace(w, 'es$', '')
        ELSE regexp_replace(w, 's$', '') END), ' ') AS words FROM documents"""
)
def lemmatise(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_join(tx.lemmatise(tx.tokens("text")), " ")
    return t.documents(spark, d).select("doc_id", words.alias("words"))


@query(
    t.with_views(
        "cleaned",
        "SELECT cve_id, clean_text FROM cleaned WHERE trim(clean_text) <> ''",
    )
)
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return tx.clean_text(t.vuln(spark, d, spread=True), "description", lemmas=False).select("cve_id", "clean_text")


@query(
    f"""SELECT doc_id, clean_text FROM (SELECT doc_id, {t.sql_clean('text')} AS clean_text FROM documents)
        WHERE trim(clean_text) <> ''"""
)
def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return tx.clean_text(t.documents(spark, d), "text", lemmas=False).select("doc_id", "clean_text")


@query(
    """SELECT doc_id, text FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS text
       FROM documents) WHERE trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g')) <> ''"""
)
def drop_blank(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 7 != 0, F.col("text"))
    return tx.drop_blank(t.documents(spark, d).select("doc_id", text.alias("text")), "text")


@query(
    t.with_views(
        "vuln",
        f"""SELECT cve_id, {t.sql_flag('description', fixed.EXPLOIT_PATTERN)} AS exploit,
            {t.sql_flag('description', fixed.PATCH_PATTERN)} AS patch,
            {t.sql_flag('description', fixed.ZERO_DAY_PATTERN)} AS zero_day FROM vuln""",
    )
)
def keyword_flag(spark: SparkSession, d: str) -> DataFrame:
    return t.vuln(spark, d).select(
        "cve_id",
        tx.keyword_flag("description", fixed.EXPLOIT_PATTERN).alias("exploit"),
        tx.keyword_flag("description", fixed.PATCH_PATTERN).alias("patch"),
        tx.keyword_flag("description", fixed.ZERO_DAY_PATTERN).alias("zero_day"),
    )


@query(
    t.with_views(
        "vuln",
        r"""SELECT cve_id, array_to_string(list_sort(list_distinct(list_transform(
            regexp_extract_all(lower(cve_id) || ' and ' || description, '(?i)CVE-[0-9]{4}-[0-9]{4,7}'),
            lambda c: upper(c)))), ',') AS cves FROM vuln""",
    )
)
def extract_cves(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lower("cve_id"), F.lit(" and "), "description")
    return t.vuln(spark, d).select("cve_id", F.array_join(tx.extract_cves(text), ",").alias("cves"))


@query("SELECT doc_id, round(coalesce(length(text), 0) / CAST(1000 AS DOUBLE), 6) AS text_length FROM documents")
def text_length(spark: SparkSession, d: str) -> DataFrame:
    return t.documents(spark, d).select("doc_id", F.round(tx.text_length("text"), 6).alias("text_length"))


# --- sentiment, terms --------------------------------------------------------
_POS, _NEG = t.sql_list(fixed.POSITIVE_WORDS), t.sql_list(fixed.NEGATIVE_WORDS)


@query(
    t.with_views(
        "vuln",
        f"""SELECT cve_id, round(CASE WHEN p + n > 0 THEN (p - n) / CAST(p + n AS DOUBLE) ELSE 0 END, 6) AS sentiment FROM (
          SELECT cve_id, len(list_filter(w, lambda x: x IN {_POS})) AS p, len(list_filter(w, lambda x: x IN {_NEG})) AS n
          FROM (SELECT cve_id, {t.sql_terms('description')} AS w FROM vuln))""",
    )
)
def sentiment_lexicon(spark: SparkSession, d: str) -> DataFrame:
    scored = sentiment.sentiment(t.vuln(spark, d).drop("sentiment"), "description")
    return scored.select("cve_id", _r("sentiment"))


_DOC_TERMS = f"SELECT doc_id, unnest({t.sql_terms('text')}) AS term FROM documents"
_TERM_COUNTS = "SELECT term, count(*) AS corpus_count, count(DISTINCT doc_id) AS doc_count FROM doc_terms GROUP BY term"
_N = "(SELECT count(*) FROM documents)"


@query(
    f"""WITH doc_terms AS ({_DOC_TERMS}), tc AS ({_TERM_COUNTS})
    SELECT term, CAST(corpus_count AS BIGINT) AS corpus_count, doc_count FROM tc
    WHERE doc_count >= 3 AND doc_count <= CAST(0.8 AS DOUBLE) * {_N}
    ORDER BY corpus_count DESC, term LIMIT 2000"""
)
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d)
    return tfidf.vocabulary(docs, "text", min_df=3, max_df=0.8, max_features=2000)


@query(
    f"""WITH w AS (SELECT doc_id, {t.sql_terms('text')} AS w FROM documents),
    doc_terms AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL
      SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
    tc AS ({_TERM_COUNTS})
    SELECT term, CAST(corpus_count AS BIGINT) AS corpus_count, doc_count FROM tc
    WHERE doc_count >= 2 AND doc_count <= CAST(0.7 AS DOUBLE) * {_N}"""
)
def vocabulary_word_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d)
    return tfidf.vocabulary(docs, "text", min_df=2, max_df=0.7, ngrams=(1, 2))


_TFIDF = f"""WITH doc_terms AS ({_DOC_TERMS}), tc AS ({_TERM_COUNTS}),
    v AS (SELECT * FROM tc WHERE doc_count >= 3 AND doc_count <= CAST(0.8 AS DOUBLE) * {_N}),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY 1, 2),
    w AS (SELECT doc_id, term, tf, tf * (ln((1 + {_N}) / (1 + doc_count)::DOUBLE) + 1) AS w FROM tf JOIN v USING (term)),
    l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id),
    weights AS (SELECT doc_id, term, tf, w / l AS weight FROM w JOIN l USING (doc_id))"""


def _weights(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d)
    vocab = tfidf.vocabulary(docs, "text", min_df=3, max_df=0.8)
    return tfidf.tfidf(docs, vocab, "doc_id", "text")


@query(f"{_TFIDF} SELECT doc_id AS doc_key, term, tf, round(weight, 6) AS weight FROM weights")
def tfidf_long(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).select("doc_key", "term", "tf", _r("weight"))


@query(
    f"""{_TFIDF} SELECT term, round(sum(weight) / {_N}, 6) AS mean_weight FROM weights GROUP BY term
    ORDER BY round(sum(weight) / {_N}, 9) DESC, term LIMIT 20"""
)
def top_terms_tfidf(spark: SparkSession, d: str) -> DataFrame:
    n = tfidf.n_docs(t.documents(spark, d))
    return tfidf.top_terms_tfidf(_weights(spark, d), n, 20).select("term", _r("mean_weight"))


@query(
    f"""WITH v AS (SELECT doc_id, {t.sql_terms('text')} AS w FROM documents), dt AS ({_DOC_TERMS}),
    doc_terms AS (SELECT * FROM dt), tc AS ({_TERM_COUNTS}),
    kept AS (SELECT * FROM tc WHERE doc_count >= 2 AND doc_count <= CAST(0.8 AS DOUBLE) * {_N}
      ORDER BY corpus_count DESC, term LIMIT 500),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY 1, 2),
    w AS (SELECT doc_id, term, tf * (ln((1 + {_N}) / (1 + doc_count)::DOUBLE) + 1) AS w FROM tf JOIN kept USING (term))
    SELECT d.doc_id, coalesce(n.filled, 0) AS filled, round(coalesce(n.total, 0), 6) AS total FROM documents d LEFT JOIN (
      SELECT doc_id, count(*) AS filled, sum(w) / sqrt(sum(w * w)) AS total FROM w GROUP BY doc_id) n USING (doc_id)"""
)
def tfidf_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vector form: filled slots and sum of each document's vector."""
    from pyspark.ml.functions import vector_to_array

    docs = t.documents(spark, d)
    model = tfidf.TfidfModel.fit(docs, "text", max_features=500)
    values = vector_to_array("tfidf")
    return model.transform(docs, "text").select(
        "doc_id",
        F.size(F.filter(values, lambda x: x != 0)).cast("bigint").alias("filled"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query(
    f"""WITH words AS (SELECT doc_id, unnest(regexp_split_to_array({t.sql_squeeze('text')}, ' ')) AS term FROM documents)
    SELECT term, count(*) AS count, round(count(*) * CAST(100 AS DOUBLE) / {_N}, 6) AS document_percent,
      round(count(DISTINCT doc_id) * CAST(100 AS DOUBLE) / {_N}, 6) AS doc_freq_pct
    FROM words WHERE term <> '' GROUP BY term ORDER BY count DESC, term LIMIT 50"""
)
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    top = tfidf.top_terms(t.documents(spark, d), "text", 50)
    return top.select("term", "count", _r("document_percent"), _r("doc_freq_pct"))


@query()
def random_projection(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d)
    model = tfidf.TfidfModel.fit(docs, "text")
    vectors = model.transform(docs, "text")
    return tfidf.random_projection(vectors, "tfidf", len(model.terms)).select("doc_id", "projected")


@query(
    f"""WITH doc_terms AS ({_DOC_TERMS}), tc AS ({_TERM_COUNTS}),
    v AS (SELECT * FROM tc WHERE doc_count >= 2 AND doc_count <= CAST(0.8 AS DOUBLE) * {_N} ORDER BY corpus_count DESC, term LIMIT 5000),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY 1, 2),
    w AS (SELECT doc_id, term, tf * (ln((1 + {_N}) / (1 + doc_count)::DOUBLE) + 1) AS w FROM tf JOIN v USING (term)),
    l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id),
    u AS (SELECT term, component, {draw_sql(42, 'term', 'component')} AS u FROM v, (SELECT unnest(range(256))::INTEGER AS component)),
    s AS (SELECT term, component, CASE WHEN u < 0.5 / sqrt(5000) THEN 1 ELSE -1 END / sqrt(256 / sqrt(5000)) AS sign FROM u WHERE u < 1 / sqrt(5000))
    SELECT doc_id AS doc_key, component, round(sum(w / l * sign), 6) AS value FROM w JOIN l USING (doc_id) JOIN s USING (term) GROUP BY 1, 2"""
)
def project_long(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d)
    vocab = cut_lineage(tfidf.vocabulary(docs, "text", min_df=2, max_df=0.8, max_features=5000))  # read twice
    weights = tfidf.tfidf(docs, vocab, "doc_id", "text", max_features=5000)
    return tfidf.project_long(weights, tfidf.projection_terms(vocab, 5000)).select("doc_key", "component", _r("value"))


@query()
def embed(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.embed(t.documents(spark, d), "text").select("doc_id", "embedding")


# --- parameter study of the vocabulary ---------------------------------------
_GRID = """grid AS (SELECT min_df, max_df FROM (VALUES (1), (2), (3), (5), (10)) a(min_df),
    (VALUES (CAST(0.7 AS DOUBLE)), (CAST(0.8 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.95 AS DOUBLE)), (CAST(1.0 AS DOUBLE))) b(max_df))"""
_SWEEP = f"""WITH doc_terms AS ({_DOC_TERMS}), tc AS ({_TERM_COUNTS}), {_GRID}, n AS (SELECT count(*) AS n FROM documents),
    m AS (SELECT min_df, max_df, count(*) FILTER (doc_count >= min_df AND doc_count <= max_df * n) AS vocab_size,
        sum(CASE WHEN doc_count >= min_df AND doc_count <= max_df * n THEN doc_count ELSE 0 END) AS nnz,
        count(*) FILTER (doc_count >= min_df AND doc_count <= max_df * n AND doc_count >= max_df * n) AS removed_high_freq,
        count(*) AS reference FROM tc, grid, n GROUP BY 1, 2),
    words AS (SELECT word, count(*) AS c FROM (SELECT unnest(regexp_split_to_array(text, '[\\s\\p{{Z}}]+')) AS word FROM documents)
        WHERE word <> '' GROUP BY 1),
    sweep AS (SELECT min_df, max_df, vocab_size, 100 * vocab_size / (SELECT count(*) FROM words)::DOUBLE AS vocab_coverage_pct,
        100 * (1 - nnz / ((SELECT n FROM n) * vocab_size)::DOUBLE) AS sparsity_pct,
        (SELECT count(*) FROM words WHERE c < min_df) AS removed_low_freq, removed_high_freq,
        100 * vocab_size / reference::DOUBLE AS vocab_percent_of_reference FROM m)"""
_SWEEP_COLS = ["min_df", "max_df", "vocab_size", "removed_low_freq", "removed_high_freq"]
_SWEEP_PCT = ["vocab_coverage_pct", "sparsity_pct", "vocab_percent_of_reference"]


@query(f"{_SWEEP} SELECT {', '.join(_SWEEP_COLS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _SWEEP_PCT)} FROM sweep")
def tfidf_sweep(spark: SparkSession, d: str) -> DataFrame:
    sweep = sweeps.tfidf_sweep(t.documents(spark, d), "text")
    return sweep.select(*_SWEEP_COLS, *[_r(c) for c in _SWEEP_PCT])


@query(
    f"""{_SWEEP} SELECT min_df, max_df, round(CAST(0.4 AS DOUBLE) * vocab_coverage_pct + CAST(0.3 AS DOUBLE) * (100 - sparsity_pct)
    + CAST(0.3 AS DOUBLE) * vocab_percent_of_reference, 6) AS score FROM sweep ORDER BY score DESC, min_df, max_df LIMIT 1"""
)
def tfidf_best_setting(spark: SparkSession, d: str) -> DataFrame:
    best = sweeps.best_tfidf(sweeps.tfidf_sweep(t.documents(spark, d), "text"))
    return best.select("min_df", "max_df", _r("score"))


@query(
    f"""WITH doc_terms AS ({_DOC_TERMS}), tc AS ({_TERM_COUNTS}), {_GRID}, n AS (SELECT count(*) AS n FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY 1, 2),
    w AS (SELECT doc_id, term, doc_count, tf * (ln((1 + n) / (1 + doc_count)::DOUBLE) + 1) AS w FROM tf JOIN tc USING (term), n),
    g AS (SELECT min_df, max_df, doc_id, term, w, n FROM w, grid, n WHERE doc_count >= min_df AND doc_count <= max_df * n),
    u AS (SELECT min_df, max_df, term, n, w / sqrt(sum(w * w) OVER (PARTITION BY min_df, max_df, doc_id)) AS u FROM g),
    s AS (SELECT min_df, max_df, term, sum(u) / any_value(n) AS mean_weight FROM u GROUP BY 1, 2, 3)
    SELECT min_df, max_df, rank, term, round(mean_weight, 6) AS mean_weight FROM (SELECT *, row_number() OVER (
      PARTITION BY min_df, max_df ORDER BY round(mean_weight, 9) DESC, term) AS rank FROM s) WHERE rank <= 10"""
)
def tfidf_sweep_top_terms(spark: SparkSession, d: str) -> DataFrame:
    top = sweeps.tfidf_sweep_top_terms(t.documents(spark, d), "doc_id", "text")
    return top.select("min_df", "max_df", F.col("rank").cast("bigint").alias("rank"), "term", _r("mean_weight"))


# --- pairs of embeddings -----------------------------------------------------
_PAIRS = """WITH p AS (SELECT a.vec_id, CASE WHEN a.label = b.label THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS expected,
    list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = t.read(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("_l"))
    pairs = e.join(nxt, "vec_id").withColumn("expected", F.when(F.col("label") == F.col("_l"), 0.8).otherwise(0.2))
    return clustering.pair_similarity(pairs, "embedding", "other", "expected")


@query(f"{_PAIRS} SELECT vec_id, expected, round(similarity, 6) AS similarity, round(abs(similarity - expected), 6) AS delta FROM p")
def pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", "expected", _r("similarity"), _r("delta"))


@query(
    f"""{_PAIRS}, m AS (SELECT avg(abs(similarity - expected)) AS avg_delta, avg(similarity) FILTER (expected >= 0.6) AS high_avg,
    avg(similarity) FILTER (expected <= 0.3) AS low_avg FROM p)
    SELECT round(avg_delta, 6) AS avg_delta, round(high_avg, 6) AS high_avg, round(low_avg, 6) AS low_avg,
    CASE WHEN low_avg > 0 THEN round(high_avg / low_avg, 4) ELSE CAST('inf' AS DOUBLE) END AS contrast_ratio FROM m"""
)
def similarity_report(spark: SparkSession, d: str) -> DataFrame:
    report = clustering.similarity_report(_pairs(spark, d))
    return report.select(_r("avg_delta"), _r("high_avg"), _r("low_avg"), _r("contrast_ratio", 4))
