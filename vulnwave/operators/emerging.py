"""Emerging-threat detection: keyword, count spike, isolation forest, and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.aggregates import count_if, rows_of, sql_value
from ..functions.text import keyword_flag
from ..session import cut_lineage, stored
from .isolation import IsolationForest
from .linking import in_spike_days
from .tfidf import TfidfModel, random_projection

FLAGS = ["zero_day_flag", "spike_flag", "if_flag"]


def zero_day_flag(text: Column | str) -> Column:
    return keyword_flag(text, fixed.ZERO_DAY_PATTERN)


def daily_counts(df: DataFrame, date: str = "published_date", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., day, x): rows per day, a NULL date is dropped."""
    return (
        df.select(*keys, F.col(date).cast("date").alias("day"))
        .filter(F.col("day").isNotNull())
        .groupBy(*keys, "day")
        .agg(F.count("*").alias("x"))
    )


def fill_days(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Daily counts with a zero for each calendar day that has none."""
    span = daily.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b")).filter("_a is not null")
    days = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("day"))
    return days.join(daily, [*keys, "day"], "left").withColumn("x", F.coalesce("x", F.lit(0)))


def spike_days(
    daily: DataFrame,
    *,
    window: int = 30,
    min_days: int = 5,
    z: int = 3,
    keys: Sequence[str] = (),
    fill_gaps: bool = False,
) -> DataFrame:
    """Days whose count exceeds the trailing mean by more than ``z`` standard deviations.

    The window is ``window`` rows of observed days, today included; ``fill_gaps``
    makes it calendar days. The test is done in whole numbers: with n rows, sum S and
    sum of squares Q, ``n x > S`` and ``(n x - S)^2 (n - 1) > z^2 n (n Q - S^2)``.
    Its input is the daily table, which the calendar bounds; never run it on base rows.
    """
    if fill_gaps:
        daily = fill_days(daily, keys)
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(1 - window, 0)
    big = F.col("x").cast("decimal(20,0)")
    rows = daily.select(
        *keys, "day", "x",
        F.count("*").over(w).cast("decimal(5,0)").alias("_n"),
        F.sum(big).over(w).cast("decimal(20,0)").alias("_s"),
        F.sum((big * big).cast("decimal(38,0)")).over(w).alias("_q"),
    )
    n, s = F.col("_n"), F.col("_s")
    whole = lambda c: c.cast("decimal(38,0)")
    excess = (n * F.col("x").cast("decimal(20,0)") - s).cast("decimal(20,0)")
    spread = whole(n * whole(whole(n * F.col("_q")) - whole(s * s)))
    fires = whole(whole(excess * excess) * (n - 1)) > whole(F.lit(z * z) * spread)
    return rows.filter((n >= min_days) & (excess > 0) & fires).select(*keys, "day", "x")


def with_keyword_and_spike(
    df: DataFrame, text: str = "clean_text", date: str = "published_date", daily: DataFrame | None = None, **spike: object
) -> DataFrame:
    """Add ``zero_day_flag``, ``published_dt`` and ``spike_flag``.

    ``daily`` is given where the rows per day can be counted without all that made ``df``, which is run twice otherwise.
    """
    flagged = df.withColumn("zero_day_flag", zero_day_flag(text)).withColumn(
        "published_dt", F.col(date).cast("date")
    )
    daily = daily_counts(df, date) if daily is None else daily
    return in_spike_days(flagged, spike_days(daily, **spike), date)


def with_isolation_flag(
    df: DataFrame,
    key: str,
    text: str = "clean_text",
    *,
    contamination: float = 0.03,
    max_features: int = 5_000,
    components: int = 256,
    trees: int = 100,
    seed: int = 42,
) -> DataFrame:
    """Add ``anomaly_score`` and ``if_flag`` from projected TF-IDF vectors.

    Only the sampled rows are vectorised to fit, and all rows to score. The
    scored rows are stored, as the exact cut reads the scores more than once.
    """
    model = TfidfModel.fit(df, text, min_df=2, max_df=0.8, max_features=max_features)

    def vectorise(rows: DataFrame) -> DataFrame:
        vectors = model.transform(rows, text, "_v")
        return random_projection(vectors, "_v", len(model.terms), components, seed, "_p").drop("_v")

    forest = IsolationForest(trees=trees, seed=seed)
    forest.grow(vectorise(forest.sample_rows(df.select(key, text), key, model.n)), "_p")
    vectors = vectorise(df)
    scored = stored(forest.score(vectors, "_p", "anomaly_score", batches=True).drop("_p"), "scored")
    return forest.flag(scored, "anomaly_score", contamination, "if_flag")


def emerging(df: DataFrame, flags: Sequence[str] = tuple(FLAGS)) -> DataFrame:
    """Add ``emerging``: any flag fired."""
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.coalesce(F.col(f), F.lit(False))
    return df.withColumn("emerging", any_flag)


def detection_methods(flags: Sequence[str] = tuple(FLAGS)) -> Column:
    """Comma list of the flags that fired."""
    return F.concat_ws(", ", *[F.when(F.col(f), f.removesuffix("_flag")) for f in flags])


def detection_overlap(df: DataFrame) -> DataFrame:
    """One row: totals per method and the seven disjoint overlaps."""
    z, s, i = (F.coalesce(F.col(f), F.lit(False)) for f in FLAGS)
    return df.agg(
        F.count("*").alias("total"),
        count_if(F.col("emerging")).alias("emerging"),
        count_if(z).alias("zero_day"),
        count_if(s).alias("spike"),
        count_if(i).alias("isolation"),
        count_if(z & ~s & ~i).alias("only_zero_day"),
        count_if(~z & s & ~i).alias("only_spike"),
        count_if(~z & ~s & i).alias("only_isolation"),
        count_if(z & s & ~i).alias("zero_day_spike"),
        count_if(z & ~s & i).alias("zero_day_isolation"),
        count_if(~z & s & i).alias("spike_isolation"),
        count_if(z & s & i).alias("all_three"),
    ).withColumn("emerging_pct", 100.0 * F.col("emerging") / F.col("total"))


def emerging_by_category(
    df: DataFrame, classes: Sequence[str] = tuple(fixed.CATEGORIES), prefix: str = "label_"
) -> DataFrame:
    """(category, emerging, n): labelled rows among emerging and other rows."""
    flag = {True: "coalesce(emerging, false)", False: "NOT coalesce(emerging, false)"}
    cells = [(i, c, e) for i, c in enumerate(classes) for e in (True, False)]
    sums = df.agg(*[F.expr(f"count_if(`{prefix}{c}` = 1 AND {flag[e]}) AS n{i}_{int(e)}") for i, c, e in cells])
    return sums.select(
        rows_of(
            [{"category": sql_value(c), "emerging": sql_value(e), "n": f"n{i}_{int(e)}"} for i, c, e in cells]
        )
    )


def urgency_correlation(df: DataFrame) -> DataFrame:
    """Pearson correlation of the urgency score and the emerging flag."""
    return df.agg(F.corr("urgency_score", F.col("emerging").cast("double")).alias("corr"))
