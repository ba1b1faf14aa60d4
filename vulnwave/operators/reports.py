"""Dashboard and report queries: filters, counts, trends, top-k.

Every top-k orders by the row's key last, so ties do not move.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.aggregates import count_if, exact_quantiles, melt, rows_of, share, sql_value
from ..functions.bins import level_rank
from ..functions.text import keyword_flag
from ..session import checked_broadcast, cut_lineage
from ..sources.articles import as_date

SORTS = {"recent": "published_date", "cvss": "cvss_score", "urgency": "urgency_score"}


def _date(col: str) -> Column:
    return F.col(col).cast("date")


def _newest(df: DataFrame, k: int, key: str, date: str = "published_date") -> DataFrame:
    return df.orderBy(F.col(date).desc_nulls_last(), key).limit(k)


# --- filters -----------------------------------------------------------------
def search(
    df: DataFrame,
    query: str | None = None,
    *,
    severity: str | None = None,
    source: str | None = None,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    sort: str = "recent",
    limit: int | None = 20,
    literal: bool = False,
    key: str = "cve_id",
) -> DataFrame:
    """Rows that match a text query and filters, best ``limit`` rows first.

    The query is a case-insensitive regular expression on id, description and clean
    text, or a plain text with ``literal=True``. Dates are inclusive; a row without
    a date is dropped once a bound is given.
    """
    if severity:
        df = df.filter(F.col("severity") == severity)
    if source:
        df = df.filter(F.col("source") == source)
    if start is not None:
        df = df.filter(F.col("published_date") >= as_date(start))
    if end is not None:
        df = df.filter(F.col("published_date") <= as_date(end))
    if query:
        hit = F.lit(False)
        for c in ("cve_id", "description", "clean_text"):
            if c in df.columns:
                if literal:
                    one = F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False))
                else:
                    one = keyword_flag(c, query)
                hit = hit | one
        df = df.filter(hit)
    if limit is None:
        return df
    by = SORTS[sort]
    return df.orderBy(F.col(by).desc_nulls_last(), key).limit(limit)


def recent(df: DataFrame, days: int | None, as_of: str | dt.date, date: str = "published_date") -> DataFrame:
    """Rows of the last ``days`` days; None keeps every dated row."""
    if days is None:
        return df.filter(F.col(date).isNotNull())
    return df.filter(F.col(date) >= F.date_sub(as_date(as_of), days))


def filter_options(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a column, without NULL."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def with_defaults(df: DataFrame) -> DataFrame:
    """Add urgency and emerging columns with default values where they are missing."""
    if "urgency_score" not in df.columns:
        df = df.withColumns({"urgency_score": F.lit(0.5), "urgency_level": F.lit("Medium")})
    if "emerging" not in df.columns:
        df = df.withColumn("emerging", F.lit(False))
    return df


# --- overview ----------------------------------------------------------------
def overview(df: DataFrame) -> DataFrame:
    """One row: CVEs, articles, high urgency, emerging."""
    return df.agg(
        count_if(F.col("source") == fixed.SOURCE_NVD).alias("cves"),
        count_if(F.col("source") == fixed.SOURCE_NEWS).alias("articles"),
        count_if(F.col("urgency_level") == "High").alias("high_urgency"),
        count_if(F.col("emerging")).alias("emerging"),
    )


def severity_distribution(df: DataFrame) -> DataFrame:
    """CVEs per severity, largest first."""
    nvd = df.filter((F.col("source") == fixed.SOURCE_NVD) & F.col("severity").isNotNull())
    return nvd.groupBy("severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "severity")


def timeline(df: DataFrame) -> DataFrame:
    """Rows per date and source."""
    dated = df.select(_date("published_date").alias("date"), "source").filter("date is not null")
    return dated.groupBy("date", "source").agg(F.count("*").alias("n"))


def recent_by_severity(df: DataFrame, severities: Sequence[str], k: int, key: str = "cve_id") -> DataFrame:
    nvd = df.filter((F.col("source") == fixed.SOURCE_NVD) & F.lower("severity").isin(list(severities)))
    return _newest(nvd, k, key)


def recent_critical(df: DataFrame, k: int = 5, key: str = "cve_id") -> DataFrame:
    return recent_by_severity(df, ["critical"], k, key)


def recent_high(df: DataFrame, k: int = 10, key: str = "cve_id") -> DataFrame:
    return recent_by_severity(df, ["critical", "high"], k, key)


# --- categories --------------------------------------------------------------
def keyword_counts(
    df: DataFrame, text: str = "clean_text", themes: Mapping[str, Sequence[str]] = fixed.THEME_KEYWORDS
) -> DataFrame:
    """(theme, n): rows naming any keyword of the theme."""
    sums = df.agg(*[count_if(keyword_flag(text, "|".join(w))).alias(t) for t, w in themes.items()])
    return melt(sums, {t: f"`{t}`" for t in themes}, "theme", "n")


def category_totals(
    df: DataFrame, classes: Sequence[str] = tuple(fixed.CATEGORIES), prefix: str = "label_"
) -> DataFrame:
    sums = df.agg(*[F.coalesce(F.sum(f"{prefix}{c}"), F.lit(0)).alias(c) for c in classes])
    return melt(sums, {c: f"`{c}`" for c in classes}, "category", "n")


def category_monthly(df: DataFrame, category: str, prefix: str = "label_") -> DataFrame:
    """(month, n) of rows labelled with one category."""
    rows = df.filter((F.col(f"{prefix}{category}") == 1) & F.col("published_date").isNotNull())
    return rows.groupBy(F.trunc("published_date", "month").alias("month")).agg(F.count("*").alias("n"))


# --- urgency -----------------------------------------------------------------
def level_distribution(df: DataFrame) -> DataFrame:
    """(urgency_level, n, share) over the rows that have a level."""
    counts = df.filter("urgency_level is not null").groupBy("urgency_level").agg(F.count("*").alias("n"))
    # At most one row per level reaches the window.
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal-width bins, the last one closed; empty bins are kept."""
    value = F.col(col).cast("double")
    rows = df.select(value.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    span = rows.agg(F.struct(F.min("_v").alias("a"), F.max("_v").alias("b")).alias("s")).scalar()
    low, high = span["a"], span["b"]
    width = (high - low) / float(bins)
    index = F.when(width > 0, F.least(F.floor((F.col("_v") - low) / width), F.lit(bins - 1))).otherwise(0)
    counts = rows.groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    numbers = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), low.alias("a"), width.alias("w"))
    edges = numbers.filter("a is not null")
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.col("a") + F.col("bin") * F.col("w")).alias("low"),
        (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def top_urgent(df: DataFrame, k: int = 10, key: str = "cve_id") -> DataFrame:
    return df.orderBy(F.col("urgency_score").desc_nulls_last(), key).limit(k)


def boxplot_stats(df: DataFrame, by: str, value: str = "urgency_score") -> DataFrame:
    """(by, min, q1, median, q3, max, whisker_low, whisker_high, n) per group.

    Quartiles are exact with linear interpolation; whiskers are the outermost values
    within 1.5 quartile ranges. The two columns are stored first: they are read three
    times, and what made the score should run once.
    """
    rows = df.select(by, F.col(value).cast("double").alias("_v")).filter(
        F.col(by).isNotNull() & F.col("_v").isNotNull()
    )
    rows = cut_lineage(rows)
    q = exact_quantiles(rows, "_v", [0.25, 0.5, 0.75], [by])
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    quartiles = q.groupBy(by).agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"))
    quartiles = checked_broadcast(cut_lineage(quartiles))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = lambda c: F.when(c, F.col("_v"))
    return (
        rows.join(quartiles, by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.min("_v").alias("min"), F.max("_v").alias("max"),
            F.min(inside(F.col("_v") >= F.col("q1") - reach)).alias("whisker_low"),
            F.max(inside(F.col("_v") <= F.col("q3") + reach)).alias("whisker_high"),
            F.count("*").alias("n"),
        )
    )


def describe_factors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(factor, mean, median, std, min, max), medians exact; the columns are stored first."""
    df = cut_lineage(df.select(*cols))
    names = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    stats = df.agg(
        *[F.expr(f"{fn}(CAST(`{c}` AS DOUBLE)) AS {k}{i}") for i, c in enumerate(cols) for k, fn in names.items()]
    ).select(rows_of([{"factor": sql_value(c)} | {k: f"{k}{i}" for k in names} for i, c in enumerate(cols)]))
    long = melt(df, {c: f"CAST(`{c}` AS DOUBLE)" for c in cols}, "factor", "_v")
    medians = exact_quantiles(long, "_v", [0.5], ["factor"]).select("factor", F.col("quantile").alias("median"))
    return stats.join(medians, "factor", "left")


def factor_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr): the full Pearson matrix from one aggregate."""
    idx = range(len(cols))
    name = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
    value = [f"CAST(`{c}` AS DOUBLE)" for c in cols]
    sums = df.agg(*[F.expr(f"corr({value[i]}, {value[j]}) AS {name(i, j)}") for i in idx for j in idx if i <= j])
    return sums.select(
        rows_of([{"a": sql_value(cols[i]), "b": sql_value(cols[j]), "corr": name(i, j)} for i in idx for j in idx])
    )


def top_correlations(matrix: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` pairs with the largest absolute correlation, each pair once."""
    once = matrix.filter((F.col("a") < F.col("b")) & F.col("corr").isNotNull() & ~F.isnan("corr"))
    return once.orderBy(F.round(F.abs("corr"), 9).desc(), "a", "b").limit(k)


def pivot_metric(df: DataFrame, index: str, columns: str, value: str, values: Sequence[object]) -> DataFrame:
    """Mean of ``value`` with one column per entry of ``values``."""
    return df.groupBy(index).pivot(columns, list(values)).agg(F.avg(value))


# --- emerging ----------------------------------------------------------------
def emerging_summary(df: DataFrame) -> DataFrame:
    """One row: emerging rows and rows per flag."""
    return df.agg(
        count_if(F.col("emerging")).alias("emerging"),
        count_if(F.col("zero_day_flag")).alias("zero_day"),
        count_if(F.col("spike_flag")).alias("spikes"),
        count_if(F.col("if_flag")).alias("anomalies"),
    )


def emerging_recent(df: DataFrame, k: int = 10, key: str = "cve_id") -> DataFrame:
    return _newest(df.filter(F.col("emerging")), k, key)


# --- trends ------------------------------------------------------------------
def week_end(date: str) -> Column:
    """The Sunday that closes the week."""
    return F.date_add(F.date_trunc("week", _date(date)).cast("date"), 6)


def weekly_severity(df: DataFrame) -> DataFrame:
    """(week, severity, n)."""
    dated = df.filter(F.col("published_date").isNotNull() & F.col("severity").isNotNull())
    return dated.groupBy(week_end("published_date").alias("week"), "severity").agg(F.count("*").alias("n"))


def insights(df: DataFrame) -> DataFrame:
    """One row: share of critical rows, mean urgency, share of emerging rows."""
    return df.agg(
        (100.0 * share(F.lower("severity") == "critical")).alias("critical_pct"),
        F.avg("urgency_score").alias("avg_urgency"),
        (100.0 * share(F.col("emerging"))).alias("emerging_pct"),
    )


def top_products(df: DataFrame, k: int = 3, col: str = "products") -> DataFrame:
    return (
        df.select(F.explode(col).alias("product"))
        .groupBy("product")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "product")
        .limit(k)
    )


def _all_weeks(weekly: DataFrame) -> DataFrame:
    # The calendar bounds the number of weeks.
    span = weekly.agg(F.min("week").alias("a"), F.max("week").alias("b")).filter("a is not null")
    weeks = span.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    return weeks.join(weekly, "week", "left")


def weekly_emerging(df: DataFrame, date: str = "published_date") -> DataFrame:
    """(week, emerging, total, pct) with empty weeks; their pct is NULL."""
    weekly = (
        df.filter(F.col(date).isNotNull())
        .groupBy(week_end(date).alias("week"))
        .agg(count_if(F.col("emerging")).alias("emerging"), F.count("*").alias("total"))
    )
    full = _all_weeks(weekly).na.fill(0, ["emerging", "total"])
    return full.withColumn("pct", F.try_divide(100.0 * F.col("emerging"), F.col("total")))


def weekly_mean_urgency(df: DataFrame, date: str = "published_date") -> DataFrame:
    """(week, avg_urgency), NULL for an empty week."""
    weekly = df.filter(F.col(date).isNotNull()).groupBy(week_end(date).alias("week")).agg(
        F.avg("urgency_score").alias("avg_urgency")
    )
    return _all_weeks(weekly)


def monthly_emerging(df: DataFrame, date: str = "published_date") -> DataFrame:
    """(month, total, emerging, pct)."""
    return (
        df.filter(F.col(date).isNotNull())
        .groupBy(F.trunc(date, "month").alias("month"))
        .agg(F.count("*").alias("total"), count_if(F.col("emerging")).alias("emerging"))
        .withColumn("pct", 100.0 * F.col("emerging") / F.col("total"))
    )


def by_level(df: DataFrame) -> DataFrame:
    """Order a level table Low, Medium, High."""
    return df.orderBy(level_rank("urgency_level"))
