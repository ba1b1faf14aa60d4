"""Costly steps stand in a plan as often as they're needed."""

import datetime as dt

from pyspark.sql import functions as F

from vulnwave.catalog import QUERIES
from vulnwave.catalog import tables as t
from vulnwave.catalog.ingest import _tagged_articles
from vulnwave.plans import assess


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_days_are_counted_without_cleaning_again(spark, sf_dir):
    assert _plan(t.flagged(spark, sf_dir)).count("explode(filter(") == 1


def test_master_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("date")
    def day(i):
        made.add(1)
        return dt.date(2001, 7, 1 + i % 9)

    rows = [(f"a flaw {'found' if i % 2 else 'seen'} here", f"CVE-{i}", i) for i in range(40)]
    master = spark.createDataFrame(rows, "clean_text string, doc_key string, i int").withColumn("published_date", day("i"))
    assert assess.detect(master, trees=2, components=2).count() == 40
    assert made.value == 40


def test_texts_are_joined_once(spark, sf_dir):
    plan = _plan(_tagged_articles(spark, sf_dir).select("text", "cves"))
    assert sum("text#" in line for line in plan.split("\n") if "Join LeftOuter" in line or "Relation" in line) <= 2
    assert plan.count("LeftOuter") == 1


def test_products_are_dealt_out(spark, sf_dir):
    assert QUERIES["product_mentions"](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
