"""Scores of multi-label predictions, from one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.aggregates import rows_of, sql_value


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def _add(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _outcomes(df: DataFrame, classes: Sequence[str], truth: str, guess: str, *more: Column) -> DataFrame:
    """(i, name, tp, fp, fn, tn, extra aggregates...): one row per label, from one pass."""
    aggs = []
    for i, c in enumerate(classes):
        y, p = f"`{truth}{c}` = 1", f"`{guess}{c}` = 1"
        cells = {"tp": f"{y} AND {p}", "fp": f"NOT {y} AND {p}", "fn": f"{y} AND NOT {p}", "tn": f"NOT {y} AND NOT {p}"}
        aggs += [F.expr(f"count_if({cond}) AS {k}{i}") for k, cond in cells.items()]
    sums = df.agg(*aggs, *more)
    kept = sums.columns[len(aggs):]
    rows = [
        {"i": str(i), "name": sql_value(c)} | {k: f"{k}{i}" for k in ("tp", "fp", "fn", "tn")}
        for i, c in enumerate(classes)
    ]
    return sums.select(*kept, rows_of(rows))


def _metrics() -> dict[str, Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2.0 * tp, 2 * tp + fp + fn),
    }


def classification_report(
    df: DataFrame,
    classes: Sequence[str] = tuple(fixed.CATEGORIES),
    truth: str = "label_",
    guess: str = "pred_",
) -> DataFrame:
    """(name, precision, recall, f1, support) per label and for the four averages.

    A ratio with nothing below the line is 0.
    """
    ys = [F.col(f"{truth}{c}") for c in classes]
    ps = [F.col(f"{guess}{c}") for c in classes]
    hit, n_true, n_guess = _add([y * p for y, p in zip(ys, ps)]), _add(ys), _add(ps)
    rows = _outcomes(
        df, classes, truth, guess,
        F.coalesce(F.avg(_ratio(hit, n_guess)), F.lit(0.0)).alias("sp"),
        F.coalesce(F.avg(_ratio(hit, n_true)), F.lit(0.0)).alias("sr"),
        F.coalesce(F.avg(_ratio(2.0 * hit, n_true + n_guess)), F.lit(0.0)).alias("sf"),
    )
    rows = rows.withColumns({**_metrics(), "support": F.col("tp") + F.col("fn")})
    # One row per label from here on; the first one also carries the averages.
    every = Window.partitionBy()
    tp, fp, fn, total = (F.sum(c).over(every) for c in ("tp", "fp", "fn", "support"))
    names = ("precision", "recall", "f1")
    averages = {
        "micro avg": (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2.0 * tp, 2 * tp + fp + fn)),
        "macro avg": tuple(F.avg(c).over(every) for c in names),
        "weighted avg": tuple(_ratio(F.sum(F.col(c) * F.col("support")).over(every), total) for c in names),
        "samples avg": (F.col("sp"), F.col("sr"), F.col("sf")),
    }
    line = lambda name, values, support: F.struct(
        name.alias("name"), *[v.alias(n) for n, v in zip(names, values)], support.alias("support")
    )
    own = line(F.col("name"), [F.col(c) for c in names], F.col("support"))
    lines = rows.select(
        F.col("i"), own.alias("own"),
        F.array(*[line(F.lit(k), v, total) for k, v in averages.items()]).alias("avg"),
    )
    first = F.when(F.col("i") == 0, F.concat(F.array("own"), F.col("avg"))).otherwise(F.array("own"))
    return lines.select(F.inline(first))


def multilabel_confusion(
    df: DataFrame,
    classes: Sequence[str] = tuple(fixed.CATEGORIES),
    truth: str = "label_",
    guess: str = "pred_",
) -> DataFrame:
    """(label, tn, fp, fn, tp, precision, recall, f1)."""
    rows = _outcomes(df, classes, truth, guess).withColumns(_metrics())
    return rows.select(F.col("name").alias("label"), "tn", "fp", "fn", "tp", "precision", "recall", "f1")


def first_label(prefix: str, classes: Sequence[str] = tuple(fixed.CATEGORIES)) -> Column:
    """First class set, in class order; ``none`` when no class is."""
    return F.coalesce(*[F.when(F.col(f"{prefix}{c}") == 1, c) for c in classes], F.lit("none"))


def confusion_matrix(
    df: DataFrame,
    classes: Sequence[str] = tuple(fixed.CATEGORIES),
    truth: str = "label_",
    guess: str = "pred_",
) -> DataFrame:
    """Counts of first true label (rows) by first predicted label (columns)."""
    pairs = df.groupBy(
        first_label(truth, classes).alias("truth"), first_label(guess, classes).alias("_guess")
    ).agg(F.count("*").alias("_n"))
    return (
        pairs.groupBy("truth")
        .pivot("_guess", [*classes, "none"])
        .agg(F.sum("_n"))
        .na.fill(0)
    )
