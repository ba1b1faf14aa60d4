"""Helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of an Arrow batch.
BATCH_ROWS = 500
# Rows of a key from which on it is joined apart, and most such keys there are.
HOT_ROWS = 2_000
HOT_KEYS = 50_000
# Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to ``BATCH_ROWS`` rows: a batch of whole texts is held outside the heap,
    twice in the executor and once in the Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def whole_text(name: str) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(name), F.lit(""))


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What ``owner`` keeps in this Python worker from task to task. Workers are shared: what others kept is let go."""
    for other in [k for k in _KEPT if k != owner]:
        del _KEPT[other]
    return _KEPT.setdefault(owner, {})


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a piece hold about ``size`` bytes; a longer text stands alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def join_counts(rows: DataFrame, counts: DataFrame, key: str, n: str, salt: Column) -> DataFrame:
    """``rows`` joined (inner) with ``counts``: the number ``n`` of rows of a ``key``, each key once, and other columns; none
    of its names but the key is among those of ``rows``.

    Keys of more than ``HOT_ROWS`` rows, and of more than a ``HOT_KEYS``-th of all, get theirs from a broadcast of at most ``HOT_KEYS`` keys.
    Their rows pass the shuffle of the others by ``salt``, an expression of the key's type that spreads rows. ``counts`` is read
    three times and should be stored. Null keys are left out.
    """
    every = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.coalesce(F.max(n), F.lit(0)).alias("most")).first()
    often = max(HOT_ROWS, every["total"] // HOT_KEYS)
    if every["most"] <= often:
        return rows.join(counts, key)
    names = [c for c in counts.columns if c != key]
    hot = counts.where(F.col(n) > often).select(F.col(key).alias("hot_key"), *[F.col(c).alias(f"hot_{c}") for c in names])
    cold = counts.where(F.col(n) <= often).select(F.col(key).alias("cold_key"), *[F.col(c).alias(f"cold_{c}") for c in names])
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    # a salt that equals a key of the others does no harm: hot columns come first
    met = met.withColumn("dealt_by", F.when(F.col("hot_key").isNull(), F.col(key)).otherwise(salt))
    met = met.join(cold, F.col("dealt_by") == F.col("cold_key"), "left").where(F.col("hot_key").isNotNull() | F.col("cold_key").isNotNull())
    return met.select(*rows.columns, *[F.when(F.col("hot_key").isNotNull(), F.col(f"hot_{c}")).otherwise(F.col(f"cold_{c}")).alias(c) for c in names])
