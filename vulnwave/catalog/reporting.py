"""Dashboard, report and data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import linking, quality, reports
from . import tables as t
from .registry import query


def _r(c: str, places: int = 6):
    return F.round(c, places).alias(c)


def _rsql(*cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols)


# --- search and filters ------------------------------------------------------
@query(
    t.with_views(
        "nvd",
        """SELECT cve_id, published_date, severity FROM nvd WHERE severity = 'HIGH' AND source = 'nvd'
           AND published_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
           AND (regexp_matches(cve_id, '(?i)inject') OR regexp_matches(description, '(?i)inject') OR regexp_matches(clean_text, '(?i)inject'))
           ORDER BY published_date DESC NULLS LAST, cve_id LIMIT 20""",
    )
)
def search(spark: SparkSession, d: str) -> DataFrame:
    found = reports.search(
        t.nvd(spark, d), "INJECT", severity="HIGH", source="nvd", start="1996-01-01", end="1998-12-31"
    )
    return found.select("cve_id", "published_date", "severity")


@query(
    t.with_views(
        "assessed",
        """SELECT cve_id, round(urgency_score, 6) AS urgency_score FROM assessed
           WHERE contains(lower(description), 'http://a.example/x') ORDER BY assessed.urgency_score DESC, cve_id LIMIT 20""",
    )
)
def search_literal(spark: SparkSession, d: str) -> DataFrame:
    found = reports.search(t.assessed(spark, d), "http://A.example/x", literal=True, sort="urgency")
    return found.select("cve_id", _r("urgency_score"))


@query(t.with_views("vuln", f"SELECT cve_id, published_date FROM vuln WHERE published_date >= DATE '{t.AS_OF}' - 90"))
def recent(spark: SparkSession, d: str) -> DataFrame:
    return reports.recent(t.vuln(spark, d), 90, t.AS_OF).select("cve_id", "published_date")


@query(t.with_views("vuln", "SELECT DISTINCT severity FROM vuln WHERE severity IS NOT NULL ORDER BY 1"))
def filter_options(spark: SparkSession, d: str) -> DataFrame:
    return reports.filter_options(t.vuln(spark, d), "severity")


@query(
    t.with_views(
        "vuln",
        "SELECT cve_id, CAST(0.5 AS DOUBLE) AS urgency_score, 'Medium' AS urgency_level, false AS emerging FROM vuln",
    )
)
def with_defaults(spark: SparkSession, d: str) -> DataFrame:
    return reports.with_defaults(t.vuln(spark, d).select("cve_id"))


# --- overview ----------------------------------------------------------------
def _all_rows(spark: SparkSession, d: str) -> DataFrame:
    return linking.combine(t.flagged(spark, d), t.articles(spark, d))


@query(
    t.with_views(
        "flagged articles",
        """SELECT count(*) AS cves, (SELECT count(*) FROM articles) AS articles, count(*) FILTER (urgency_level = 'High') AS high_urgency,
           count(*) FILTER (emerging) AS emerging FROM flagged""",
    )
)
def overview(spark: SparkSession, d: str) -> DataFrame:
    return reports.overview(_all_rows(spark, d))


@query(t.with_views("vuln", "SELECT severity, count(*) AS n FROM vuln WHERE severity IS NOT NULL GROUP BY 1"))
def severity_distribution(spark: SparkSession, d: str) -> DataFrame:
    return reports.severity_distribution(t.vuln(spark, d))


def _recent_sql(words: str, k: int) -> str:
    return t.with_views(
        "vuln",
        f"""SELECT cve_id, published_date, severity FROM vuln WHERE source = 'nvd' AND lower(severity) IN {words}
            ORDER BY published_date DESC NULLS LAST, cve_id LIMIT {k}""",
    )


@query(_recent_sql("('critical')", 5))
def recent_critical(spark: SparkSession, d: str) -> DataFrame:
    return reports.recent_critical(t.vuln(spark, d)).select("cve_id", "published_date", "severity")


@query(_recent_sql("('critical', 'high')", 10))
def recent_high(spark: SparkSession, d: str) -> DataFrame:
    return reports.recent_high(t.vuln(spark, d)).select("cve_id", "published_date", "severity")


# --- categories --------------------------------------------------------------
@query(
    t.with_views(
        "vuln",
        " UNION ALL ".join(
            f"SELECT {t.q(theme)} AS theme, count(*) FILTER ({t.sql_flag('description', '|'.join(words))}) AS n FROM vuln"
            for theme, words in fixed.THEME_KEYWORDS.items()
        ),
    )
)
def keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.keyword_counts(t.vuln(spark, d), "description")


@query(
    t.with_views(
        "labelled",
        " UNION ALL ".join(
            f"SELECT {t.q(c)} AS category, CAST(sum(label_{c}) AS BIGINT) AS n FROM labelled" for c in fixed.CATEGORIES
        ),
    )
)
def category_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.category_totals(t.labelled(spark, d))


@query(
    t.with_views(
        "labelled",
        "SELECT CAST(date_trunc('month', published_date) AS DATE) AS month, count(*) AS n FROM labelled WHERE label_Phishing = 1 GROUP BY 1",
    )
)
def category_monthly(spark: SparkSession, d: str) -> DataFrame:
    return reports.category_monthly(t.labelled(spark, d), "Phishing")


# --- urgency -----------------------------------------------------------------
@query(
    t.with_views(
        "assessed",
        """SELECT urgency_level, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM assessed
           WHERE urgency_level IS NOT NULL GROUP BY 1""",
    )
)
def level_distribution(spark: SparkSession, d: str) -> DataFrame:
    dist = reports.by_level(reports.level_distribution(t.assessed(spark, d)))
    return dist.select("urgency_level", "n", _r("share"))


def _histogram_sql(bins: int) -> str:
    return f"""WITH s AS (SELECT min(value) AS a, max(value) AS b, (max(value) - min(value)) / CAST({bins} AS DOUBLE) AS w FROM events),
        c AS (SELECT least(CAST(floor((value - a) / w) AS INTEGER), {bins - 1}) AS bin, count(*) AS n FROM events, s GROUP BY 1)
        SELECT CAST(i AS INTEGER) AS bin, round(a + i * w, 6) AS low, round(a + (i + 1) * w, 6) AS high, coalesce(n, 0) AS n
        FROM s, (SELECT unnest(range({bins})) AS i) LEFT JOIN c ON c.bin = i"""


def _histogram(spark: SparkSession, d: str, bins: int) -> DataFrame:
    return reports.histogram(t.read(spark, d, "events"), "value", bins).select("bin", _r("low"), _r("high"), "n")


@query(_histogram_sql(30))
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return _histogram(spark, d, 30)


@query(_histogram_sql(50))
def histogram_50_bins(spark: SparkSession, d: str) -> DataFrame:
    return _histogram(spark, d, 50)


_BOX_COLS = ["min", "q1", "median", "q3", "max", "whisker_low", "whisker_high"]


def _box_sql(by: str) -> str:
    return t.with_views(
        "flagged",
        f"""SELECT {by}, {', '.join(f'round({c}, 6) AS {c}' for c in ('q1', 'median', 'q3'))}, round(min(urgency_score), 6) AS min,
            round(max(urgency_score), 6) AS max, round(min(urgency_score) FILTER (urgency_score >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
            round(max(urgency_score) FILTER (urgency_score <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, count(*) AS n
            FROM flagged JOIN qq USING ({by}) GROUP BY {by}, q1, median, q3""",
        qq=f"""SELECT {by}, quantile_cont(urgency_score, 0.25) AS q1, quantile_cont(urgency_score, 0.5) AS median,
            quantile_cont(urgency_score, 0.75) AS q3 FROM flagged WHERE {by} IS NOT NULL GROUP BY 1""",
    )


@query(_box_sql("urgency_level"))
def boxplot_by_level(spark: SparkSession, d: str) -> DataFrame:
    box = reports.boxplot_stats(t.assessed(spark, d), "urgency_level")
    return box.select("urgency_level", *[_r(c) for c in _BOX_COLS], "n")


@query(_box_sql("emerging"))
def boxplot_by_emerging(spark: SparkSession, d: str) -> DataFrame:
    box = reports.boxplot_stats(t.flagged(spark, d), "emerging")
    return box.select("emerging", *[_r(c) for c in _BOX_COLS], "n")


_ALL_FACTORS = [f"f_{f}" for f in fixed.FACTORS] + ["f_days_old", "f_n_articles_raw", "f_text_length"]


@query(
    t.with_views(
        "factors",
        " UNION ALL ".join(
            f"""SELECT {t.q(c)} AS factor, round(avg({c}), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, round(min({c})::DOUBLE, 6) AS min,
                round(max({c})::DOUBLE, 6) AS max, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median FROM factors"""
            for c in _ALL_FACTORS
        ),
    )
)
def describe_factors(spark: SparkSession, d: str) -> DataFrame:
    stats = reports.describe_factors(t.factors(spark, d), _ALL_FACTORS)
    return stats.select("factor", *[_r(c) for c in ("mean", "std", "min", "max", "median")])


_CORR = " UNION ALL ".join(
    f"SELECT {t.q(a)} AS a, {t.q(b)} AS b, corr({a}::DOUBLE, {b}::DOUBLE) AS corr FROM factors"
    for a in _ALL_FACTORS for b in _ALL_FACTORS
)


@query(t.with_views("factors", "SELECT a, b, round(corr, 6) AS corr FROM m", m=_CORR))
def factor_correlations(spark: SparkSession, d: str) -> DataFrame:
    return reports.factor_correlations(t.factors(spark, d), _ALL_FACTORS).select("a", "b", _r("corr"))


@query(
    t.with_views(
        "factors",
        "SELECT a, b, round(corr, 6) AS corr FROM m WHERE a < b AND NOT isnan(corr) ORDER BY round(abs(m.corr), 9) DESC, a, b LIMIT 3",
        m=_CORR,
    )
)
def top_correlations(spark: SparkSession, d: str) -> DataFrame:
    matrix = reports.factor_correlations(t.factors(spark, d), _ALL_FACTORS)
    return reports.top_correlations(matrix).select("a", "b", _r("corr"))


_WORDS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "Unknown"]


@query(
    t.with_views(
        "vuln",
        f"""SELECT cwe, {', '.join(f'round(avg(cvss_score) FILTER (severity = {t.q(w)}), 6) AS "{w}"' for w in _WORDS)} FROM vuln GROUP BY cwe""",
    )
)
def pivot_metric(spark: SparkSession, d: str) -> DataFrame:
    p = reports.pivot_metric(t.vuln(spark, d), "cwe", "severity", "cvss_score", _WORDS)
    return p.select("cwe", *[_r(w) for w in _WORDS])


# --- emerging ----------------------------------------------------------------
@query(
    t.with_views(
        "flagged",
        """SELECT count(*) FILTER (emerging) AS emerging, count(*) FILTER (zero_day_flag) AS zero_day,
           count(*) FILTER (spike_flag) AS spikes, count(*) FILTER (if_flag) AS anomalies FROM flagged""",
    )
)
def emerging_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.emerging_summary(t.flagged(spark, d))


@query(
    t.with_views(
        "flagged",
        "SELECT cve_id, published_date FROM flagged WHERE emerging ORDER BY published_date DESC NULLS LAST, cve_id LIMIT 10",
    )
)
def emerging_recent(spark: SparkSession, d: str) -> DataFrame:
    return reports.emerging_recent(t.flagged(spark, d)).select("cve_id", "published_date")


# --- trends ------------------------------------------------------------------
_WEEK = "CAST(date_trunc('week', published_date) AS DATE) + 6"


@query(t.with_views("vuln", f"SELECT {_WEEK} AS week, severity, count(*) AS n FROM vuln GROUP BY 1, 2"))
def weekly_severity(spark: SparkSession, d: str) -> DataFrame:
    return reports.weekly_severity(t.vuln(spark, d))


@query(
    t.with_views(
        "flagged",
        """SELECT round(100 * avg(CASE WHEN lower(severity) = 'critical' THEN 1 ELSE 0 END), 6) AS critical_pct,
           round(avg(urgency_score), 6) AS avg_urgency, round(100 * avg(CASE WHEN emerging THEN 1 ELSE 0 END), 6) AS emerging_pct FROM flagged""",
    )
)
def insights(spark: SparkSession, d: str) -> DataFrame:
    return reports.insights(t.flagged(spark, d)).select(_r("critical_pct"), _r("avg_urgency"), _r("emerging_pct"))


@query(
    """SELECT p_name AS product, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, product LIMIT 3"""
)
def top_products(spark: SparkSession, d: str) -> DataFrame:
    parts = t.read(spark, d, "part").select(F.array("p_name").alias("products"))
    return reports.top_products(parts)


def _weeks(view: str, aggregates: str) -> dict[str, str]:
    return {
        "weekly": f"SELECT {_WEEK} AS week, {aggregates} FROM {view} GROUP BY 1",
        "weeks": "SELECT CAST(unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week FROM weekly",
    }


# Rows of the first ten days of each quarter only, so that there are empty weeks.
# All rows, with their dates moved to the first ten days of the quarter, so that most weeks are empty.
_GAPPY = "CAST(date_trunc('quarter', published_date) AS DATE) + CAST(day(published_date) % 10 AS INTEGER)"


@query(
    t.with_views(
        "flagged",
        """SELECT week, coalesce(emerging, 0) AS emerging, coalesce(total, 0) AS total, round(100 * emerging / nullif(total, 0)::DOUBLE, 6) AS pct
           FROM weeks LEFT JOIN weekly USING (week)""",
        part_rows=f"SELECT * REPLACE ({_GAPPY} AS published_date) FROM flagged",
        **_weeks("part_rows", "count(*) FILTER (emerging) AS emerging, count(*) AS total"),
    )
)
def weekly_emerging(spark: SparkSession, d: str) -> DataFrame:
    w = reports.weekly_emerging(t.flagged(spark, d).withColumn("published_date", F.expr(_GAPPY)))
    return w.select("week", "emerging", "total", _r("pct"))


@query(
    t.with_views(
        "assessed",
        "SELECT week, round(avg_urgency, 6) AS avg_urgency FROM weeks LEFT JOIN weekly USING (week)",
        part_rows=f"SELECT * REPLACE ({_GAPPY} AS published_date) FROM assessed",
        **_weeks("part_rows", "avg(urgency_score) AS avg_urgency"),
    )
)
def weekly_mean_urgency(spark: SparkSession, d: str) -> DataFrame:
    return reports.weekly_mean_urgency(t.assessed(spark, d).withColumn("published_date", F.expr(_GAPPY))).select("week", _r("avg_urgency"))


@query(
    t.with_views(
        "flagged",
        """SELECT CAST(date_trunc('month', published_date) AS DATE) AS month, count(*) AS total, count(*) FILTER (emerging) AS emerging,
           round(100 * count(*) FILTER (emerging) / count(*)::DOUBLE, 6) AS pct FROM flagged GROUP BY 1""",
    )
)
def monthly_emerging(spark: SparkSession, d: str) -> DataFrame:
    return reports.monthly_emerging(t.flagged(spark, d)).select("month", "total", "emerging", _r("pct"))


# --- data quality ------------------------------------------------------------
# Flawed on purpose: missing dates, unknown sources, blank texts, raw texts, scores out
# of range, missing mentions.
_FLAWED = f"""SELECT cve_id, CASE WHEN k % 50 = 0 THEN 'blog' ELSE source END AS source,
    CASE WHEN k % 40 = 0 THEN NULL ELSE published_date END AS published_date,
    CASE WHEN k % 30 = 0 THEN '  ' WHEN k % 30 = 1 THEN NULL WHEN k % 4 = 1 THEN description ELSE {t.sql_mask_domain('description')} END AS clean_text,
    CASE WHEN k % 70 = 0 THEN CAST(2 AS DOUBLE) ELSE sentiment END AS sentiment,
    CASE WHEN k % 90 = 1 THEN CAST(11 AS DOUBLE) ELSE cvss_score END AS cvss_score, k % 12 <> 0 AS mentions FROM vuln"""


def _flawed(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import mask_domain

    k = F.col("k")
    text = F.when(k % 30 == 0, "  ").when(k % 30 == 1, F.lit(None).cast("string")).when(k % 4 == 1, F.col("description"))
    return t.vuln(spark, d).select(
        "cve_id", F.when(k % 50 == 0, "blog").otherwise(F.col("source")).alias("source"),
        F.when(k % 40 != 0, F.col("published_date")).alias("published_date"),
        text.otherwise(mask_domain("description")).alias("clean_text"),
        F.when(k % 70 == 0, 2.0).otherwise(F.col("sentiment")).alias("sentiment"),
        F.when(k % 90 == 1, 11.0).otherwise(F.col("cvss_score")).alias("cvss_score"),
        F.when(k % 12 != 0, F.array("cve_id")).otherwise(F.array().cast("array<string>")).alias("mentioned_cves"),
    )


def _flawed_sql(sql: str) -> str:
    return t.with_views("vuln", sql, flawed=_FLAWED)


_BLANK = "clean_text IS NOT NULL AND trim(clean_text) = ''"
_SOURCE = "coalesce(source, '') NOT IN ('nvd', 'thehackernews')"
_HTML = "coalesce(regexp_matches(clean_text, '<[^>]+>'), false)"
_CVE = f"coalesce(regexp_matches(clean_text, {t.q(fixed.CVE_PATTERN)}), false)"


@query(
    _flawed_sql(
        " UNION ALL ".join(f"""SELECT {t.q(c)} AS "column", count(*) FILTER ({c} IS NULL) AS nulls FROM flawed""" for c in quality.CRITICAL)
    )
)
def check_nulls(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_nulls(_flawed(spark, d))


@query(_flawed_sql(f"SELECT count(*) FILTER ({_BLANK}) AS blank_texts FROM flawed"))
def check_blank_text(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_blank_text(_flawed(spark, d))


@query(_flawed_sql(f"SELECT count(*) FILTER ({_SOURCE}) AS invalid_sources FROM flawed"))
def check_sources(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_sources(_flawed(spark, d))


@query(
    _flawed_sql(
        f"SELECT round(avg(CASE WHEN {_HTML} THEN 1 ELSE 0 END), 6) AS html_rate, avg(CASE WHEN {_HTML} THEN 1 ELSE 0 END) <= 0.01 AS passed FROM flawed"
    )
)
def check_html_remnants(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_html_remnants(_flawed(spark, d)).select(_r("html_rate"), "passed")


@query(
    """SELECT avg(CASE WHEN regexp_matches(html, '<[^>]+>') THEN 1 ELSE 0 END) AS html_rate,
       avg(CASE WHEN regexp_matches(html, '<[^>]+>') THEN 1 ELSE 0 END) <= 0.01 AS passed FROM pages"""
)
def check_html_remnants_pages(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_html_remnants(t.read(spark, d, "pages"), "html")


@query(
    _flawed_sql(
        f"SELECT round(avg(CASE WHEN {_CVE} THEN 1 ELSE 0 END), 6) AS unmasked_rate, avg(CASE WHEN {_CVE} THEN 1 ELSE 0 END) <= 0.05 AS passed FROM flawed"
    )
)
def check_unmasked_cves(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_unmasked_cves(_flawed(spark, d)).select(_r("unmasked_rate"), "passed")


@query(
    _flawed_sql(
        """SELECT count(*) FILTER (sentiment NOT BETWEEN -1 AND 1) AS sentiment_out,
           count(*) FILTER (source = 'nvd' AND cvss_score NOT BETWEEN 0 AND 10) AS cvss_out FROM flawed"""
    )
)
def check_ranges(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_ranges(_flawed(spark, d))


@query(
    _flawed_sql(
        """SELECT round(avg(CASE WHEN mentions THEN 0 ELSE 1 END), 6) AS mismatch_rate, avg(CASE WHEN mentions THEN 0 ELSE 1 END) <= 0.05 AS passed
           FROM flawed WHERE source = 'nvd'"""
    )
)
def check_cve_in_mentions(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_cve_in_mentions(_flawed(spark, d)).select(_r("mismatch_rate"), "passed")


_CHECKS = [
    *[(f"null_{c}", "issue", f"{c} IS NULL", "true", 0) for c in quality.CRITICAL],
    ("blank_text", "issue", _BLANK, "true", 0),
    ("invalid_source", "issue", _SOURCE, "true", 0),
    ("html_remnants", "issue", _HTML, "true", 0.01),
    ("unmasked_cves", "warning", _CVE, "true", 0.05),
    ("sentiment_range", "issue", "sentiment NOT BETWEEN -1 AND 1", "true", 0),
    ("cvss_range", "issue", "source = 'nvd' AND cvss_score NOT BETWEEN 0 AND 10", "source = 'nvd'", 0),
    ("cve_in_mentions", "issue", "source = 'nvd' AND NOT mentions", "source = 'nvd'", 0.05),
]


@query(
    _flawed_sql(
        " UNION ALL ".join(
            f"""SELECT {t.q(name)} AS "check", {t.q(level)} AS level, count(*) FILTER ({cond}) AS count,
                round(count(*) FILTER ({cond}) / nullif(count(*) FILTER ({base}), 0)::DOUBLE, 6) AS rate,
                count(*) FILTER ({cond}) / nullif(count(*) FILTER ({base}), 0)::DOUBLE <= {allowed} AS passed FROM flawed"""
            for name, level, cond, base, allowed in _CHECKS
        )
    )
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    report = quality.quality_report(_flawed(spark, d))
    return report.select("check", "level", "count", _r("rate"), "passed")


@query(
    t.with_views(
        "vuln articles",
        """SELECT source, CAST(year(published_date) AS INTEGER) AS year, count(*) AS n FROM (
           SELECT source, published_date FROM vuln UNION ALL SELECT source, published_date FROM articles) GROUP BY 1, 2""",
    )
)
def rows_by_source_year(spark: SparkSession, d: str) -> DataFrame:
    cols = ["source", "published_date"]
    return quality.rows_by_source_year(t.vuln(spark, d).select(*cols).unionByName(t.articles(spark, d).select(*cols)))


_STATS = ["sentiment_min", "sentiment_max", "sentiment_mean", "sentiment_median", "cvss_min", "cvss_max", "cvss_mean",
          "cvss_null_pct", "exploit_mention_pct", "patch_mention_pct"]


@query(
    _flawed_sql(
        f"""SELECT {_rsql(*_STATS)} FROM (SELECT min(sentiment) AS sentiment_min, max(sentiment) AS sentiment_max, avg(sentiment) AS sentiment_mean,
            quantile_cont(sentiment, 0.5) AS sentiment_median, min(cvss_score) FILTER (source = 'nvd') AS cvss_min,
            max(cvss_score) FILTER (source = 'nvd') AS cvss_max, avg(cvss_score) FILTER (source = 'nvd') AS cvss_mean,
            100 * count(*) FILTER (source = 'nvd' AND cvss_score IS NULL) / count(*) FILTER (source = 'nvd')::DOUBLE AS cvss_null_pct,
            100 * count(*) FILTER ({t.sql_flag('clean_text', fixed.EXPLOIT_PATTERN)}) / count(*)::DOUBLE AS exploit_mention_pct,
            100 * count(*) FILTER ({t.sql_flag('clean_text', fixed.PATCH_PATTERN)}) / count(*)::DOUBLE AS patch_mention_pct FROM flawed)"""
    )
)
def value_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.value_statistics(_flawed(spark, d)).select(*[_r(c) for c in _STATS])
