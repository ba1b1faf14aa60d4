import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructType

from vulnwave.streaming import feeds as sf

SCHEMA = StructType().add("cve_id", StringType()).add("last_modified", DateType()).add("v", StringType())


def _day(n):
    return dt.date(2024, 1, n)


def _land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def test_upsert_over_runs(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    log = sf.BatchLog(spark, str(tmp_path / "t"))
    assert log.newest(["cve_id"], "last_modified") is None

    def land(*rows):
        _land(spark, src, list(rows))
        sf.stream_upsert(sf.stream_feed(spark, src, SCHEMA), log, state).awaitTermination()
        return {(r["cve_id"], r["v"]) for r in log.newest(["cve_id"], "last_modified").collect()}

    assert land(("A", _day(1), "a"), ("A", _day(2), "b"), ("B", _day(1), "x")) == {("A", "b"), ("B", "x")}
    assert land(("A", _day(1), "late"), ("B", _day(5), "y"), ("C", _day(1), "z")) == {("A", "b"), ("B", "y"), ("C", "z")}
    assert land(("C", _day(2), "zz"), ("B", _day(5), "tie")) == {("A", "b"), ("B", "y"), ("C", "zz")}
    moved = log.compacted(str(tmp_path / "u"), ["cve_id"], "last_modified")
    assert moved.read().count() == 3 and sorted(moved.newest(["cve_id"], "last_modified").collect()) == sorted(log.newest(["cve_id"], "last_modified").collect())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    log = sf.BatchLog(spark, str(tmp_path / "t"))
    for _ in range(2):
        log.write(spark.createDataFrame([("A", _day(1), "a")], SCHEMA), 1)
    assert log.read().count() == 1


def test_counts_of_later_batches_replace_earlier_ones(spark, tmp_path):
    log = sf.BatchLog(spark, str(tmp_path / "t"))
    log.write(spark.createDataFrame([("a", 1), ("b", 5)], "day string, x long"), 0)
    log.write(spark.createDataFrame([("a", 3)], "day string, x long"), 1)
    assert sorted(tuple(r) for r in log.newest(["day"]).collect()) == [("a", 3), ("b", 5)]


def test_daily_counts_equal_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch = sf.windowed_daily_counts(events, "ts", ["event_type"])
    plain = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("x"))
    assert batch.exceptAll(plain).count() == 0 and plain.exceptAll(batch).count() == 0


def test_days_do_not_move_with_the_session_zone(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = sorted(sf.windowed_daily_counts(events, "ts", []).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(sf.windowed_daily_counts(events, "ts", []).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dedupe_across_files(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([("u",), ("u",), ("v",)], "url string").withColumn("ingest_ts_thn", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(src)
    rows.write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = sf.stream_dedupe(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s"))
    q.trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["u", "v"]
