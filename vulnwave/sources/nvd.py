"""Nested CVE records to flat rows, all with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import checked_broadcast

_CVSS_NEWEST_FIRST = ["cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2"]


def cvss_pick(metrics: Column) -> Column:
    """STRUCT<score, severity> of the newest CVSS version that has a score.

    Only the first metric of a version counts. Version 2 states the severity beside
    its data, later ones inside. Without any score the severity is that of the
    oldest version present.
    """
    with_score, without = [], []
    for version in _CVSS_NEWEST_FIRST:
        metric = F.get(metrics[version], F.lit(0))
        data = metric["cvssData"]
        inside = version != "cvssMetricV2"
        severity = F.coalesce((data if inside else metric)["baseSeverity"], F.lit("Unknown"))
        pick = F.struct(data["baseScore"].alias("score"), severity.alias("severity"))
        with_score.append(F.when(data["baseScore"].isNotNull(), pick))
        without.append(F.when(data.isNotNull(), pick))
    unknown = F.struct(F.lit(None).cast("double").alias("score"), F.lit("Unknown").alias("severity"))
    return F.coalesce(*with_score, *reversed(without), unknown)


def title_case(name: Column) -> Column:
    """Underscores as blanks; each run of letters with a capital first, also after digits and signs."""
    runs = F.regexp_extract_all(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, F.initcap), "")


def cpe_products(configurations: Column) -> Column:
    """Sorted distinct readable names of the vulnerable CPE matches."""
    nodes = F.flatten(F.transform(F.filter(configurations, lambda c: c["nodes"].isNotNull()), lambda c: c["nodes"]))
    matches = F.flatten(F.transform(F.filter(nodes, lambda n: n["cpeMatch"].isNotNull()), lambda n: n["cpeMatch"]))

    def name(m: Column) -> Column:
        parts = F.split(m["criteria"], ":")
        vendor, product, version = (F.get(parts, F.lit(i)) for i in (3, 4, 5))
        with_version = (
            F.when(version.isin("*", "-"), title_case(product))
            .when(
                m["versionEndIncluding"].isNotNull(),
                F.concat(title_case(product), F.lit(" (up to "), m["versionEndIncluding"], F.lit(")")),
            )
            .otherwise(F.concat_ws(" ", title_case(product), version))
        )
        redundant = F.contains(F.lower(product), vendor) | (vendor == "*")
        full = F.when(redundant, with_version).otherwise(F.concat_ws(" ", title_case(vendor), with_version))
        return F.when(F.size(parts) > 5, full)

    names = F.transform(F.filter(matches, lambda m: m["vulnerable"]), name)
    empty = F.array().cast("array<string>")
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(names))), empty)


def english_description(descriptions: Column) -> Column:
    first = F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(0))
    return F.coalesce(first["value"], F.lit(""))


def cwe_id(weaknesses: Column) -> Column:
    """First weakness id, NULL when the record names none."""
    entry = F.get(F.get(weaknesses, F.lit(0))["description"], F.lit(0))
    return F.when(entry.isNotNull(), F.coalesce(entry["value"], F.lit("Unknown")))


def date_part(stamp: Column) -> Column:
    """Date of an ISO time stamp text, NULL if it is none."""
    return F.try_to_timestamp(F.substring(stamp, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def describe_cwe(df: DataFrame, catalog: DataFrame | None, col: str = "cwe") -> DataFrame:
    """Turn a CWE id into ``id: text`` where the catalogue (cwe_id, text) knows it.

    Without a catalogue the built-in list of common weaknesses is used, as a map
    literal. A catalogue table is broadcast after its size is checked.
    """
    none = F.lit("No CWE Identified")
    if catalog is None:
        lookup = F.create_map(*[F.lit(x) for kv in fixed.CWE_FALLBACK.items() for x in kv])
        text = F.try_element_at(lookup, F.col(col))
        return df.withColumn(col, F.coalesce(F.concat_ws(": ", F.col(col), text), none)).withColumn(
            col, F.when(F.col(col) == "", none).otherwise(F.col(col))
        )
    side = catalog.groupBy(F.col("cwe_id").alias("_cwe")).agg(F.min("text").alias("_text"))
    joined = df.join(checked_broadcast(side), F.col(col) == F.col("_cwe"), "left")
    named = F.when(F.col(col).isNotNull(), F.concat_ws(": ", F.col(col), F.col("_text"))).otherwise(none)
    return joined.withColumn(col, named).drop("_cwe", "_text")


def flatten_cve(raw: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """One flat row per nested record in column ``cve``."""
    c = F.col("cve")
    flat = raw.select(
        F.lit(fixed.SOURCE_NVD).alias("source"),
        c["id"].alias("cve_id"),
        english_description(c["descriptions"]).alias("description"),
        date_part(c["published"]).alias("published_date"),
        date_part(c["lastModified"]).alias("last_modified"),
        cvss_pick(c["metrics"]).alias("_cvss"),
        cwe_id(c["weaknesses"]).alias("cwe"),
        cpe_products(c["configurations"]).alias("products"),
    )
    flat = flat.select(
        "source", "cve_id", "description", "published_date", "last_modified",
        F.col("_cvss.severity").alias("severity"), F.col("_cvss.score").alias("cvss_score"),
        "cwe", "products",
    )
    return describe_cwe(flat, catalog)
