"""Joins with counts: every row gets its key's columns, whichever way it goes."""

import collections

import pytest
from pyspark.sql import functions as F

from vulnwave.llm import util


@pytest.mark.parametrize("hot_rows, hot_keys", [(2_000, 50_000), (5, 50_000), (1, 3)])
def test_join_counts(spark, monkeypatch, hot_rows, hot_keys):
    monkeypatch.setattr(util, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(util, "HOT_KEYS", hot_keys)
    keys = [7] * 60 + [8] * 9 + list(range(20)) * 2 + [100, 101, None, None]
    rows = spark.createDataFrame(list(enumerate(keys)), "row long, key long").repartition(4)
    counts = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1")
    # a salt that is a key itself does no harm
    for salt in (F.xxhash64("row"), F.lit(3).cast("long")):
        got = util.join_counts(rows, counts, "key", "n", salt).select("row", "key", "n", "first").collect()
        n = collections.Counter(keys)
        want = {(r, k, n[k], keys.index(k)) for r, k in enumerate(keys) if k is not None and n[k] > 1}
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_join_counts_splits_the_hot_key(spark, monkeypatch):
    monkeypatch.setattr(util, "HOT_ROWS", 50)
    rows = spark.range(4_000).select(F.col("id").alias("row"), F.when(F.col("id") < 3_000, 5).otherwise(F.col("id") % 100).cast("long").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = util.join_counts(rows, counts, "key", "n", F.xxhash64("row")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in dealt) == 4_000 and max(r["count"] for r in dealt) < 1_200
