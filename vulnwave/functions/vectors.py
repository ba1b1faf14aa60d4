"""Dense vector columns (``ARRAY<FLOAT>`` or ``ARRAY<DOUBLE>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(_d(a), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; a zero vector gives 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(a: Column | str) -> Column:
    """Vector scaled to length 1; a zero vector stays as it is."""
    with_norm = F.transform(
        F.array(F.struct(_d(a).alias("v"), norm(a).alias("n"))),
        lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]),
    )
    return F.element_at(with_norm, 1)
