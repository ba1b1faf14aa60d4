"""The stages composed: raw rows -> master -> urgency -> emerging -> labels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import latest
from ..functions.bins import nan_to_null, severity_bin
from ..functions.text import clean_text, extract_cves, is_cleaned_to_text
from ..operators.emerging import emerging, with_isolation_flag, with_keyword_and_spike
from ..operators.labels import binarise, seed_labels
from ..operators.linking import article_cve_edges, combine, dedupe_latest, doc_key, link_chunks, with_link_counts
from ..operators.sentiment import Scorer, sentiment
from ..operators.urgency import assess_urgency
from ..session import stored


def prepare_nvd(nvd: DataFrame, scorer: Callable[[], Scorer] | None = None, **clean: bool) -> DataFrame:
    """Clean, binned and scored CVE rows; one row per CVE."""
    rows = dedupe_latest(nvd).withColumn("cvss_score", nan_to_null(F.col("cvss_score").cast("double")))
    rows = clean_text(rows, "description", **clean)
    rows = rows.withColumns(
        {"severity_category": severity_bin("cvss_score"), "mentioned_cves": F.array(F.col("cve_id"))}
    )
    return sentiment(rows, scorer=scorer)


def prepare_articles(articles: DataFrame, scorer: Callable[[], Scorer] | None = None, **clean: bool) -> DataFrame:
    """Clean and scored article rows; CVE ids are taken from the raw text."""
    rows = dedupe_latest(articles, "url", "published_date")
    rows = clean_text(rows, "text", **clean)
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        {
            "mentioned_cves": F.array_sort(F.array_distinct(F.transform(F.coalesce("cves", none), F.upper))),
            "cves_from_text": extract_cves("text"),
        }
    ).withColumn("all_cves", F.array_sort(F.array_union("mentioned_cves", "cves_from_text")))
    return sentiment(rows, scorer=scorer)


def build_master(
    nvd: DataFrame, articles: DataFrame, scorer: Callable[[], Scorer] | None = None, **clean: bool
) -> DataFrame:
    """The wide table of CVEs and articles, keyed by ``doc_key``; `build_links` has the lists of links.

    The cleaned articles are stored, as both the link counts and the table read them.
    """
    cves = prepare_nvd(nvd, scorer, **clean)
    news = stored(prepare_articles(articles, scorer, **clean), "articles")
    edges = article_cve_edges(news, cves="all_cves", text=None)
    master = combine(with_link_counts(cves, edges), news)
    return master.withColumn("doc_key", doc_key())


def build_links(master: DataFrame) -> DataFrame:
    """(doc_key, part, linked_articles): every article linked to a CVE of the master, in lists of bounded size."""
    edges = article_cve_edges(master.filter("url IS NOT NULL"), cves="all_cves", text=None)
    links = link_chunks(edges).join(master.filter("cve_id IS NOT NULL").select("cve_id"), "cve_id", "left_semi")
    return links.withColumnRenamed("cve_id", "doc_key")


def links_of(nvd: DataFrame, articles: DataFrame, **clean: bool) -> DataFrame:
    """What ``build_links`` gives for the master of these rows, without the master.

    Of an article only its ids go on, and whether cleaning leaves anything of it; whole texts are neither moved nor stored.
    """
    cves = clean_text(dedupe_latest(nvd), "description", **clean).select("cve_id")
    rest = [c for c in articles.columns if c != "url"]
    tagged = F.transform(F.coalesce("cves", F.array().cast("array<string>")), F.upper)
    narrow = articles.filter("url IS NOT NULL").select(
        "url",
        "published_date",
        F.array_distinct(F.concat(tagged, extract_cves("text"))).alias("all_cves"),
        is_cleaned_to_text("text", **clean).alias("_any"),
        F.xxhash64(*rest).alias("_tie"),
    )
    order = [F.col("published_date").isNotNull(), F.col("published_date"), F.col("_tie")]
    news = stored(latest(narrow, ["url"], order).filter("_any").select("url", "published_date", "all_cves"), "linked")
    links = link_chunks(article_cve_edges(news, cves="all_cves", text=None))
    return links.join(cves, "cve_id", "left_semi").withColumnRenamed("cve_id", "doc_key")


def assess(master: DataFrame, as_of: str | dt.date | Column, **options: object) -> DataFrame:
    """Master plus ``urgency_score`` and ``urgency_level``."""
    return assess_urgency(master, as_of, **options)


def detect(assessed: DataFrame, *, isolation: bool = True, **forest: object) -> DataFrame:
    """Assessed rows plus the three flags and ``emerging``.

    The days' counts and the isolation forest read their input again, so the rows are
    stored in the shared folder first; the flags before the forest are cheap.
    """
    flagged = with_keyword_and_spike(stored(assessed, "assessed") if isolation else assessed)
    if isolation:
        flagged = with_isolation_flag(flagged, "doc_key", **forest)
    else:
        flagged = flagged.withColumn("if_flag", F.lit(False))
    return emerging(flagged)


def label(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """Add the label list and one 0/1 column per category."""
    return binarise(df.withColumn("labels", seed_labels(text, "cwe")), "labels")
