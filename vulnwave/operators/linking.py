"""Joins, merges and unions of CVE rows and articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.aggregates import count_if, latest
from ..functions.text import extract_cves
from ..session import checked_broadcast, cut_lineage

# A CVE's list of articles is kept in rows of about this many urls.
CHUNK = 1_000


def article_cve_edges(articles: DataFrame, cves: str = "cves", text: str | None = "text") -> DataFrame:
    """Distinct (cve_id, url, published_date) of the ids tagged on or found in an article."""
    tagged = F.transform(F.coalesce(F.col(cves), F.array().cast("array<string>")), F.upper)
    ids = F.array_union(tagged, extract_cves(text)) if text else F.array_distinct(tagged)
    # Distinct within the row; copies of an article are reduced by the aggregate.
    return (
        articles.select(F.explode(F.array_compact(ids)).alias("cve_id"), "url", "published_date")
        .groupBy("cve_id", "url")
        .agg(F.min("published_date").alias("published_date"))
    )


def link_counts(edges: DataFrame) -> DataFrame:
    """(cve_id, n_articles, earliest_article_date); combined before the shuffle.

    ``edges`` holds each (cve_id, url) pair once, so a plain count is exact.
    """
    return edges.groupBy("cve_id").agg(
        F.count("*").alias("n_articles"), F.min("published_date").alias("earliest_article_date")
    )


def link_chunks(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(cve_id, part, linked_articles): all urls of a CVE in lists of bounded size.

    A CVE with at most ``chunk`` articles has the single part 0. The urls of one with
    more are spread over as many parts as its count asks for, by hash. The number of
    parts of those CVEs is looked up before the shuffle (at most one of them per
    ``chunk`` edges), so a CVE holding a third of all edges is never collected in one task.
    """
    hot = (
        link_counts(edges)
        .filter(F.col("n_articles") > chunk)
        .select(F.col("cve_id").alias("_hot"), F.ceil(F.col("n_articles") / chunk).alias("_parts"))
    )
    met = edges.select("cve_id", "url").join(checked_broadcast(hot), F.col("cve_id") == F.col("_hot"), "left")
    part = F.coalesce(F.pmod(F.xxhash64("url", F.lit("part")), F.col("_parts")), F.lit(0))
    return (
        met.groupBy("cve_id", part.cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list("url")).alias("linked_articles"))
    )


def link(nvd: DataFrame, edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """CVE rows with ``n_articles``, ``earliest_article_date``, ``part`` and ``linked_articles``.

    Every article of every CVE is there: a CVE with more than ``chunk`` articles has a
    row for each part of its list (see `link_chunks`), numbered from 0; all others have
    one row. A CVE without articles has an empty list.
    """
    lists = link_chunks(edges, chunk)
    found = with_link_counts(nvd, edges).join(lists, "cve_id", "left")
    return found.withColumns(
        {
            "part": F.coalesce("part", F.lit(0)),
            "linked_articles": F.coalesce("linked_articles", F.array().cast("array<string>")),
        }
    )


def with_link_counts(nvd: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per CVE with ``n_articles`` and ``earliest_article_date``, for scoring."""
    return nvd.join(link_counts(edges), "cve_id", "left").withColumn(
        "n_articles", F.coalesce("n_articles", F.lit(0)).cast("int")
    )


def linked_only(master: DataFrame) -> DataFrame:
    """CVE rows with at least one article."""
    return master.filter((F.col("source") == fixed.SOURCE_NVD) & (F.col("n_articles") > 0))


def link_histogram(master: DataFrame) -> DataFrame:
    """Number of CVEs per number of linked articles."""
    return (
        linked_only(master)
        .groupBy(F.col("n_articles").cast("bigint").alias("n_articles"))
        .agg(F.count("*").alias("n_cves"))
    )


def combine(nvd: DataFrame, articles: DataFrame) -> DataFrame:
    """One table by column name; what one side lacks is NULL there."""
    return nvd.unionByName(articles, allowMissingColumns=True)


def doc_key(cve_id: Column | None = None, url: Column | None = None) -> Column:
    """Key shared by features and scores: the CVE id, else a hash of the url."""
    return F.coalesce(
        cve_id if cve_id is not None else F.col("cve_id"),
        F.sha2(url if url is not None else F.col("url"), 256),
    )


def upsert(
    existing: DataFrame, batch: DataFrame, key: str = "cve_id", version: str = "last_modified"
) -> DataFrame:
    """New keys are added, newer versions replace, everything else stays.

    The existing row wins a tie, so a second run with the same batch changes nothing.
    ``existing`` has one row per key, as this function leaves it. The batch is reduced to
    its newest rows, and their keys are looked up in the existing table: for a batch
    that can be broadcast the existing rows are neither shuffled nor sorted.
    """
    newest = dedupe_latest(batch, key, version)
    keys = checked_broadcast(newest.select(F.col(key).alias("_key")))
    known = existing.join(keys, F.col(key) == F.col("_key")).select("_key", F.col(version).alias("_old"))
    newer = F.col("_key").isNull() | (F.col(version) > F.col("_old")) | (F.col("_old").isNull() & F.col(version).isNotNull())
    winners = newest.join(known, F.col(key) == F.col("_key"), "left").filter(newer).select(*newest.columns)
    replaced = checked_broadcast(winners.select(F.col(key).alias("_key")))
    kept = existing.join(replaced, F.col(key) == F.col("_key"), "left_anti")
    return kept.unionByName(winners, allowMissingColumns=True)


def _newest_first(df: DataFrame, key: str, version: str) -> list[Column]:
    # NULL versions sort lowest; the hash makes the pick among equals repeatable.
    rest = [F.col(c) for c in df.columns if c != key]
    return [F.col(version).isNotNull(), F.col(version), F.xxhash64(*rest)]


def upsert_counts(
    existing: DataFrame, batch: DataFrame, key: str = "cve_id", version: str = "last_modified"
) -> DataFrame:
    """One row: keys the batch adds (``new_rows``) and replaces (``modified_rows``)."""
    old = existing.groupBy(key).agg(F.max(version).alias("_old"), F.lit(1).alias("_known"))
    new = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(version).alias("_new"))
    newer = (F.col("_new") > F.col("_old")) | (F.col("_old").isNull() & F.col("_new").isNotNull())
    return new.join(old, key, "left").agg(
        count_if(F.col("_known").isNull()).alias("new_rows"),
        count_if(F.col("_known").isNotNull() & newer).alias("modified_rows"),
    )


def dedupe_latest(raw: DataFrame, key: str = "cve_id", version: str = "last_modified") -> DataFrame:
    """Last record per key wins; rows without a key go."""
    keyed = raw.filter(F.col(key).isNotNull())
    return latest(keyed, [key], _newest_first(keyed, key, version))


def append_new(existing: DataFrame, batch: DataFrame, key: str = "url", date: str = "published_date") -> DataFrame:
    """Existing rows plus batch rows of unseen keys, each key once.

    Write with ``orderBy(date desc)`` if the file should be newest first. The
    existing side is reduced to its distinct keys for the anti join, so a key with
    many copies does not make one large task.
    """
    seen = existing.select(key).distinct()
    fresh = latest(batch.filter(F.col(key).isNotNull()), [key], _newest_first(batch, key, date))
    return existing.unionByName(fresh.join(seen, key, "left_anti").select(*batch.columns), allowMissingColumns=True)


def high_water(df: DataFrame, published: str = "published_date", modified: str = "last_modified") -> DataFrame:
    """One row: latest published and modified date, 2000-01-01 on an empty table."""
    start = F.lit("2000-01-01").cast("date")
    return df.agg(
        F.coalesce(F.max(published), start).alias("latest_published"),
        F.coalesce(F.max(modified), start).alias("latest_modified"),
    )


def fetch_ranges(marks: DataFrame, col: str, until: str, max_days: int = 120) -> DataFrame:
    """(range_start, range_end) from one second after the mark to ``until``.

    Ranges span at most ``max_days``; they meet without overlap, one millisecond
    apart.
    """
    first = F.col(col).cast("timestamp_ntz") + F.expr("interval 1 second")
    last = F.lit(until).cast("timestamp_ntz")
    step = F.expr(f"interval {max_days} days")
    starts = F.when(first < last, F.sequence(first, last, step))
    return (
        marks.select(F.explode(starts).alias("range_start"), last.alias("_last"))
        .filter(F.col("range_start") < F.col("_last"))
        .select(
            "range_start",
            F.least(F.col("range_start") + step - F.expr("interval 1 millisecond"), "_last").alias("range_end"),
        )
    )


def in_spike_days(
    df: DataFrame, spikes: DataFrame, date: str = "published_date", out: str = "spike_flag",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Flag rows published on a spike day.

    ``spikes`` has one row per day (and key of ``keys``). Without keys the calendar
    bounds it and it is broadcast; with keys it is stored and broadcast if small.
    """
    days = spikes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("day").alias("_day"), F.lit(True).alias(out))
    on = F.col(date).cast("date") == F.col("_day")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    side = checked_broadcast(cut_lineage(days)) if keys else F.broadcast(days)
    return (
        df.join(side, on, "left")
        .withColumn(out, F.coalesce(out, F.lit(False)))
        .drop("_day", *[f"_{k}" for k in keys])
    )
