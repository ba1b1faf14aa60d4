"""Data-quality checks: one aggregate pass over the whole table, then rows per check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.aggregates import count_if, exact_quantiles, melt, share
from ..functions.text import is_blank, keyword_flag

CRITICAL = ["source", "clean_text", "published_date"]
HTML_TAG = "<[^>]+>"


def check_nulls(df: DataFrame, cols: Sequence[str] = tuple(CRITICAL)) -> DataFrame:
    """(column, nulls)."""
    return melt(df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in cols]), {c: f"`{c}`" for c in cols}, "column", "nulls")


def check_blank_text(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """One row: texts that are blank, NULL not counted."""
    return df.agg(count_if(F.col(text).isNotNull() & is_blank(text)).alias("blank_texts"))


def check_sources(df: DataFrame) -> DataFrame:
    """One row: rows of an unknown source."""
    return df.agg(count_if(_bad_source()).alias("invalid_sources"))


def _bad_source() -> Column:
    return ~F.coalesce(F.col("source").isin(fixed.SOURCE_NVD, fixed.SOURCE_NEWS), F.lit(False))


def check_html_remnants(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """One row: rate of texts with tags; more than 1 % fails."""
    rate = share(keyword_flag(text, HTML_TAG))
    return df.agg(rate.alias("html_rate")).withColumn("passed", F.col("html_rate") <= 0.01)


def check_unmasked_cves(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """One row: rate of texts that still hold a CVE id; more than 5 % warns."""
    rate = share(F.coalesce(F.col(text).rlike(fixed.CVE_PATTERN), F.lit(False)))
    return df.agg(rate.alias("unmasked_rate")).withColumn("passed", F.col("unmasked_rate") <= 0.05)


def _out_of(col: str, low: float, high: float) -> Column:
    c = F.col(col).cast("double")
    return c.isNotNull() & ((c < low) | (c > high) | F.isnan(c))


def check_ranges(df: DataFrame) -> DataFrame:
    """One row: sentiment outside [-1, 1], CVSS of CVE rows outside [0, 10]."""
    nvd = F.col("source") == fixed.SOURCE_NVD
    return df.agg(
        count_if(_out_of("sentiment", -1.0, 1.0)).alias("sentiment_out"),
        count_if(nvd & _out_of("cvss_score", 0.0, 10.0)).alias("cvss_out"),
    )


def _missing_mention() -> Column:
    return (
        (F.col("source") == fixed.SOURCE_NVD)
        & F.col("cve_id").isNotNull()
        & ~F.coalesce(F.array_contains("mentioned_cves", F.col("cve_id")), F.lit(False))
    )


def check_cve_in_mentions(df: DataFrame) -> DataFrame:
    """One row: rate of CVE rows that do not mention their own id; more than 5 % fails."""
    nvd = df.filter(F.col("source") == fixed.SOURCE_NVD)
    rate = share(_missing_mention())
    return nvd.agg(F.coalesce(rate, F.lit(0.0)).alias("mismatch_rate")).withColumn(
        "passed", F.col("mismatch_rate") <= 0.05
    )


def quality_report(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """(check, level, count, rate, passed) of all checks, from one pass."""
    nvd = F.col("source") == fixed.SOURCE_NVD
    # check -> (level, condition, population, allowed rate)
    everything = F.lit(True)
    checks: dict[str, tuple[str, Column, Column, float]] = {
        f"null_{c}": ("issue", F.col(c).isNull(), everything, 0.0) for c in CRITICAL if c in df.columns
    }
    checks["blank_text"] = ("issue", F.col(text).isNotNull() & is_blank(text), everything, 0.0)
    checks["invalid_source"] = ("issue", _bad_source(), everything, 0.0)
    checks["html_remnants"] = ("issue", keyword_flag(text, HTML_TAG), everything, 0.01)
    checks["unmasked_cves"] = (
        "warning", F.coalesce(F.col(text).rlike(fixed.CVE_PATTERN), F.lit(False)), everything, 0.05
    )
    checks["sentiment_range"] = ("issue", _out_of("sentiment", -1.0, 1.0), everything, 0.0)
    checks["cvss_range"] = ("issue", nvd & _out_of("cvss_score", 0.0, 10.0), nvd, 0.0)
    if "mentioned_cves" in df.columns:
        checks["cve_in_mentions"] = ("issue", _missing_mention(), nvd, 0.05)
    sums = df.agg(
        F.count("*").alias("_all"), count_if(nvd).alias("_nvd"),
        *[count_if(cond).alias(name) for name, (_, cond, _, _) in checks.items()],
    )
    entries = []
    for name, (level, _, population, allowed) in checks.items():
        size = F.col("_nvd") if population is nvd else F.col("_all")
        rate = F.coalesce(F.try_divide(F.col(name).cast("double"), size), F.lit(0.0))
        entries.append(
            F.struct(
                F.lit(name).alias("check"), F.lit(level).alias("level"), F.col(name).alias("count"),
                rate.alias("rate"), (rate <= allowed).alias("passed"),
            )
        )
    return sums.select(F.inline(F.array(*entries)))


def rows_by_source_year(df: DataFrame, date: str = "published_date") -> DataFrame:
    """(source, year, n)."""
    return df.groupBy("source", F.year(date).alias("year")).agg(F.count("*").alias("n"))


def value_statistics(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """One row: sentiment and CVSS figures and the share of texts naming exploits or patches."""
    nvd = F.col("source") == fixed.SOURCE_NVD
    cvss = F.when(nvd, F.col("cvss_score"))
    median = exact_quantiles(df, "sentiment", [0.5]).select("quantile").scalar()
    stats = df.agg(
        F.min("sentiment").alias("sentiment_min"), F.max("sentiment").alias("sentiment_max"),
        F.avg("sentiment").alias("sentiment_mean"),
        F.min(cvss).alias("cvss_min"), F.max(cvss).alias("cvss_max"), F.avg(cvss).alias("cvss_mean"),
        F.try_divide(100.0 * count_if(nvd & F.col("cvss_score").isNull()), count_if(nvd)).alias("cvss_null_pct"),
        (100.0 * share(keyword_flag(text, fixed.EXPLOIT_PATTERN))).alias("exploit_mention_pct"),
        (100.0 * share(keyword_flag(text, fixed.PATCH_PATTERN))).alias("patch_mention_pct"),
    )
    return stats.withColumn("sentiment_median", median)
