"""Aggregations that stay bounded per task however large or skewed a group is."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checked_broadcast, cut_lineage

# Rank error of the sketch that brackets each quantile: n / ACCURACY.
ACCURACY = 10_000


def count_if(cond: Column) -> Column:
    """Rows where the condition holds, NULL counts as no; 0 on empty input."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def share(cond: Column) -> Column:
    """Share of all rows where the condition holds, NULL counts as no."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def sql_value(v: object) -> str:
    """SQL literal of a Python value."""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{v!r}D" if isinstance(v, float) else str(v)


def rows_of(entries: Sequence[Mapping[str, str]]) -> Column:
    """Unroll SQL expressions to rows: one row per entry, one column per name.

    Given as one SQL text, since hundreds of separate column calls are slow to build.
    """
    structs = ("struct(" + ", ".join(f"{v} AS `{k}`" for k, v in e.items()) + ")" for e in entries)
    return F.expr(f"inline(array({', '.join(structs)}))")


def constant_rows(entries: Sequence[Mapping[str, object]]) -> Column:
    """`rows_of` constants."""
    return rows_of([{k: sql_value(v) for k, v in e.items()} for e in entries])


def melt(df: DataFrame, cols: Mapping[str, str], name: str, value: str) -> DataFrame:
    """Columns to rows: one (name, value) row per entry name -> SQL expression."""
    return df.select(rows_of([{name: sql_value(k), value: c} for k, c in cols.items()]))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the greatest by ``order``.

    An aggregate, not a ranked window: copies of a hot key are reduced before the
    shuffle, so no task ever holds all of them.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*[k if k in keys else F.col("_row")[k].alias(k) for k in df.columns])


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation: (groups..., prob, quantile).

    A sketch first gives a narrow bracket around each quantile; only the distinct
    values inside a bracket are then counted and ranked, together with the number
    of rows below it. So no task holds a whole group, unlike ``percentile``.
    """
    eps = 2.0 / ACCURACY
    clip = lambda p: min(max(p, 0.0), 1.0)
    groups = list(groups)
    keys = [f"_g{i}" for i in range(len(groups))]
    base = df.select(
        *[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(value).cast("double").alias("_v")
    ).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sketch = base.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", [clip(p - eps) for p in probs], ACCURACY).alias("_low"),
        F.percentile_approx("_v", [clip(p + eps) for p in probs], ACCURACY).alias("_high"),
    )
    few = F.col("_n") <= ACCURACY
    bracket = [
        F.struct(
            F.lit(float(p)).alias("p"),
            F.col("_n").alias("n"),
            F.when(few | F.lit(p - eps <= 0), F.col("_min"))
            .otherwise(F.get("_low", F.lit(i))).alias("lo"),
            F.when(few | F.lit(p + eps >= 1), F.col("_max"))
            .otherwise(F.get("_high", F.lit(i))).alias("hi"),
        )
        for i, p in enumerate(probs)
    ]
    if keys:
        # One stored row per group, broadcast when its size allows, so that rows of a
        # large group stay where they are.
        brackets = sketch.select(*[F.col(k).alias(f"{k}_b") for k in keys], F.array(*bracket).alias("_b"))
        brackets = checked_broadcast(cut_lineage(brackets))
        same = [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in keys]
        bracketed = base.join(brackets, reduce(lambda x, y: x & y, same))
    else:
        bracketed = base.withColumn("_b", sketch.select(F.array(*bracket)).scalar())
    hits = (
        bracketed.select(*keys, "_v", F.inline_outer("_b"))
        .filter(F.col("_v") <= F.col("hi"))
        .groupBy(*keys, "p", "n", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    w = Window.partitionBy(*keys, "p").orderBy(F.col("_v").asc_nulls_first())
    rank = (F.col("n") - 1) * F.col("p")
    below = F.col("_upto") - F.col("_c")
    at = lambda r: F.max(F.when((below <= r) & (r < F.col("_upto")), F.col("_v")))
    out = (
        hits.withColumn("_upto", F.sum("_c").over(w))
        .groupBy(*keys, "p")
        .agg(
            at(F.floor(rank)).alias("_a"),
            at(F.ceil(rank)).alias("_b"),
            F.max(rank - F.floor(rank)).alias("_f"),
        )
    )
    return out.select(
        *[F.col(k).alias(g) for k, g in zip(keys, groups)],
        F.col("p").alias("prob"),
        F.coalesce(
            F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a")),
            F.raise_error(F.lit("a quantile lies outside the bracket of its sketch")).cast("double"),
        ).alias("quantile"),
    )
