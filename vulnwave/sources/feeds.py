"""Feed files in, tables out, and first looks at a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import fixed
from ..functions.aggregates import count_if

CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """A Parquet table.

    ``spread=True`` is for work that is heavy per row: a scan with fewer splits than
    there are cores (few or small files) is dealt out over all cores. A large table
    has more splits than that and is left as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def with_source(df: DataFrame, col: str = "source") -> DataFrame:
    """Source tag: nvd if the source text says so, else the news feed."""
    is_nvd = F.lower(F.coalesce(F.col(col), F.lit(""))).contains(fixed.SOURCE_NVD)
    return df.withColumn(col, F.when(is_nvd, fixed.SOURCE_NVD).otherwise(fixed.SOURCE_NEWS))


def scan_feed(
    spark: SparkSession, path: str, schema: T.StructType = schemas.FEED, json_lines: bool = False
) -> DataFrame:
    """Every JSON file below ``path``, plain or gzip, bad records kept aside.

    ``json_lines=False`` reads files holding an array or one object (each file is
    one task); ``json_lines=True`` reads one record per line, which splits.
    """
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("multiLine", not json_lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{json,json.gz,gzip}")
        .json(path)
    )


def read_feed(
    spark: SparkSession, path: str, schema: T.StructType = schemas.FEED, json_lines: bool = False
) -> DataFrame:
    """Good records of a feed folder with their source tag."""
    rows = scan_feed(spark, path, schema, json_lines).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return with_source(rows) if "source" in rows.columns else rows


def corrupt_records(
    spark: SparkSession, path: str, schema: T.StructType = schemas.FEED, json_lines: bool = False
) -> DataFrame:
    """Records that did not parse, as text.

    Spark refuses to read the corrupt column alone, so the filter names a data column.
    """
    rows = scan_feed(spark, path, schema, json_lines).withColumn("file", F.col("_metadata.file_path"))
    parsed = F.coalesce(F.col(schema.names[0]).cast("string"), F.lit(""))
    return rows.filter(F.col(CORRUPT).isNotNull() & (F.length(parsed) >= 0)).select("file", CORRUPT)


def _nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), csv: bool = True) -> None:
    """Parquet at ``path/parquet`` and a CSV copy at ``path/csv``."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/parquet")
    if csv:
        flat = [F.to_json(f.name).alias(f.name) if _nested(f.dataType) else F.col(f.name) for f in df.schema]
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")


def write_json(df: DataFrame, path: str) -> None:
    """History sink, one JSON record per line."""
    df.write.mode("overwrite").json(path)


def required_present(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def validate_required(
    df: DataFrame, cols: Sequence[str] = tuple(fixed.ARTICLE_KEYS)
) -> tuple[DataFrame, DataFrame]:
    """(rows with every required key, rows that miss one)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        return df.limit(0), df
    ok = required_present(cols)
    return df.filter(ok), df.filter(~ok)


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values, longest array, example.

    ``exact=False`` uses a sketch for the distinct counts, which keeps the pass to
    a single small aggregate on wide tables.
    """
    aggs, out = [F.count("*").alias("_n")], []
    for i, f in enumerate(df.schema):
        c = F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        is_array = isinstance(f.dataType, T.ArrayType)
        aggs += [
            count_if(F.col(f.name).isNull()).alias(f"_null{i}"),
            (F.count_distinct(c) if exact else F.approx_count_distinct(c)).alias(f"_dist{i}"),
            F.min((F.to_json(f.name) if _nested(f.dataType) else F.col(f.name).cast("string"))).alias(f"_ex{i}"),
            (F.max(F.size(f.name)) if is_array else F.max(F.lit(None).cast("int"))).alias(f"_len{i}"),
        ]
        out.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("_n").alias("rows"),
                F.col(f"_null{i}").alias("nulls"),
                F.col(f"_dist{i}").alias("distinct_values"),
                F.col(f"_len{i}").alias("longest_array"),
                F.col(f"_ex{i}").alias("example"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*out)))
