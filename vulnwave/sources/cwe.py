"""Weakness catalogue from XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import squeeze


def read_cwe_xml(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, text) of every Weakness and Category element of the XML files."""

    def rows(tag: str, text: str) -> DataFrame:
        schema = T.StructType([T.StructField("_ID", T.StringType()), T.StructField(text, T.StringType())])
        return (
            spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
            .select(F.lit(tag.lower()).alias("kind"), F.col("_ID").alias("id"), F.col(text).alias("text"))
        )

    return rows("Weakness", "Description").unionByName(rows("Category", "Name"))


def short_description(c: Column) -> Column:
    """Tags stripped, white space collapsed, cut to 97 characters and dots past 100."""
    t = squeeze(F.regexp_replace(c, r"(?s)<.*?>", ""))
    return F.when(F.length(t) > 100, F.concat(F.substring(t, 1, 97), F.lit("..."))).otherwise(t)


def cwe_catalog(elements: DataFrame) -> DataFrame:
    """(cwe_id, text) from (kind, id, text) rows, plus the two special ids.

    A category overrides a weakness of the same number.
    """
    spark = elements.sparkSession
    text = F.when(F.col("kind") == "category", squeeze("text")).otherwise(short_description(F.col("text")))
    named = (
        elements.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
        .select(F.concat(F.lit("CWE-"), "id").alias("cwe_id"), "kind", text.alias("text"))
        .groupBy("cwe_id")
        .agg(F.min(F.struct("kind", "text")).alias("_first"))
        .select("cwe_id", F.col("_first.text").alias("text"))
    )
    special = spark.createDataFrame(list(fixed.CWE_SPECIAL.items()), "cwe_id string, text string")
    return named.unionByName(special)
