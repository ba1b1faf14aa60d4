"""Incremental ingest and counts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.aggregates import latest
from ..operators.emerging import daily_counts, spike_days
from ..operators.linking import dedupe_latest
from ..sources.feeds import with_source


def stream_feed(
    spark: SparkSession, path: str, schema: T.StructType = schemas.FEED, *, json_lines: bool = True,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """New feed files of a folder as a stream, tagged with their source."""
    reader = (
        spark.readStream.schema(schema).option("multiLine", not json_lines)
        .option("pathGlobFilter", "*.{json,json.gz,gzip}")
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.json(path)
    return with_source(rows) if "source" in rows.columns else rows


class BatchLog:
    """Rows by micro-batch: a Parquet dataset partitioned by ``batch``, the number of the batch that wrote them.

    A batch only writes its own folder, and writes it anew when it runs again after a
    failure, so a retry changes nothing and stored rows are never rewritten. What
    the log says is settled when it is read: see `newest` and `spikes`.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame | None:
        """All rows with their ``batch``; None before the first batch."""
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def newest(self, keys: Sequence[str], version: str | None = None) -> DataFrame | None:
        """Newest row per key: by ``version`` (of equals the first that came), or by batch without one."""
        rows = self.read()
        if rows is None:
            return None
        order = [F.col(version), -F.col("batch")] if version else [F.col("batch")]
        return latest(rows, list(keys), order).drop("batch")

    def compacted(self, path: str, keys: Sequence[str], version: str | None = None) -> BatchLog:
        """A log at ``path`` that begins with the newest rows of this one, for the stream to go on with."""
        new = BatchLog(self.spark, path)
        rows = self.newest(keys, version)
        if rows is not None:
            new.write(rows, -1)
        return new


def _run(stream: DataFrame, handler, checkpoint: str, interval: str | None, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(handler).option("checkpointLocation", checkpoint)
    # With no interval the stream takes what is there and stops.
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def stream_upsert(
    stream: DataFrame, log: BatchLog, checkpoint: str, *, key: str = "cve_id", version: str = "last_modified",
    interval: str | None = None,
) -> StreamingQuery:
    """Log the newest record per key of each batch; read the table with ``log.newest([key], version)``."""
    return _run(stream, lambda batch, n: log.write(dedupe_latest(batch, key, version), n), checkpoint, interval)


def stream_dedupe(stream: DataFrame, key: str = "url", ts: str = "ingest_ts_thn", delay: str = "30 days") -> DataFrame:
    """First article per url; state is kept for ``delay``, later rows than that are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def _on_instant(df: DataFrame, ts: str) -> DataFrame:
    """Read a time stamp without zone as UTC; watermarks need an instant."""
    if not isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df
    micros = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)"
    return df.withColumn(ts, F.expr(f"timestamp_micros({micros})"))


def windowed_daily_counts(rows: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """(day, keys..., x): tumbling counts per UTC day; the same for a batch and a stream."""
    utc_day = F.expr("date_from_unix_date(CAST(unix_seconds(_w.start) DIV 86400 AS INT))")
    return (
        _on_instant(rows, ts)
        .groupBy(F.window(ts, "1 day").alias("_w"), *keys)
        .agg(F.count("*").alias("x"))
        .select(utc_day.alias("day"), *keys, "x")
    )


def stream_daily_counts(stream: DataFrame, ts: str, keys: Sequence[str], delay: str = "2 days") -> DataFrame:
    """`windowed_daily_counts` that counts late rows for ``delay``."""
    return windowed_daily_counts(_on_instant(stream, ts).withWatermark(ts, delay), ts, keys)


def write_counts(counts: DataFrame, log: BatchLog, checkpoint: str, *, interval: str | None = None) -> StreamingQuery:
    """Log the counts that a batch changed; read them with ``log.newest(["day", *keys])``."""
    return _run(counts, log.write, checkpoint, interval, mode="update")


def stream_spikes(
    stream: DataFrame, log: BatchLog, checkpoint: str, *, date: str = "published_date", keys: Sequence[str] = (),
    interval: str | None = None,
) -> StreamingQuery:
    """Log the daily counts of each batch; `spikes` finds the spike days in them."""
    return _run(stream, lambda batch, n: log.write(daily_counts(batch, date, keys), n), checkpoint, interval)


def spikes(log: BatchLog, keys: Sequence[str] = (), **rule: object) -> DataFrame | None:
    """Spike days over all batches so far: the trailing window reaches back over days of earlier ones."""
    rows = log.read()
    if rows is None:
        return None
    return spike_days(rows.groupBy(*keys, "day").agg(F.sum("x").alias("x")), keys=keys, **rule)
