"""Session helpers: settings, shared folders, lineage cuts, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes up to which a lookup side is broadcast by hint. Beyond it the join is left
# to the optimizer (shuffle join, adaptive skew handling).
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def local_session(cores: int | str = 8, app: str = "vulnwave", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster use the session given."""
    n = str(cores)
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, read from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="vulnwave-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the rows to Parquet in the shared folder and read them from there.

    For wide rows that are read several times by a few columns each.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and ends the lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_path(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint if there are at most ``max_rows`` rows of ``max_bytes`` in all, else the table as it is.

    The check reads no more than ``max_rows + 1`` rows; sizes are those of the rows as JSON.
    """
    row = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long")
    found = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(row).alias("size")).first()
    return F.broadcast(df) if found["n"] <= max_rows and (found["size"] or 0) <= max_bytes else df
