"""Repeatable draws by hash of a key; md5, so that any SQL engine can follow them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts as text only; NULL parts count as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def draw_sql(seed: int, *parts: str) -> str:
    """The same number in DuckDB."""
    text = " || ':' || ".join([f"'{seed}'", *[f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts]])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"
