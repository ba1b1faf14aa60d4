"""Parameter sweeps.

A sweep over scores carries its settings as one constant array per row, unrolled and
combined inside the scan stage: no join, and the shuffle holds one row per setting
and partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.aggregates import constant_rows, count_if, exact_quantiles, rows_of, share, sql_value
from ..functions.bins import level_bin
from ..session import cut_lineage
from .tfidf import join_vocabulary, n_docs, term_counts, term_frequencies
from .urgency import weighted_sum

SWEEP_WEIGHTS = [i / 20 for i in range(11)]
CONTAMINATIONS = [0.01 + i * 0.09 / 19 for i in range(20)]


def sensitivity_settings(base: Mapping[str, float], weights: Sequence[float] = SWEEP_WEIGHTS) -> list[dict]:
    """Each factor in turn takes each weight; the others are rescaled to sum 1 with it."""
    rows = []
    for factor, weight in product(base, weights):
        others = sum(w for f, w in base.items() if f != factor)
        scale = (1.0 - weight) / others if others > 0 else 1.0
        rows.append(
            {"factor": factor, "weight": float(weight)}
            | {f"w_{f}": float(weight) if f == factor else w * scale for f, w in base.items()}
        )
    return rows


def weight_sensitivity(
    factors: DataFrame, base: Mapping[str, float] = fixed.TUNING_WEIGHTS
) -> DataFrame:
    """(factor, weight, score_change, level_change_pct, low_pct, medium_pct, high_pct).

    A level that is NULL on either side counts as changed; level shares are over the
    rows that have a level.
    """
    columns = [f"f_{f}" for f in fixed.FACTORS]
    old = weighted_sum(base)
    rows = factors.select(*columns, old.alias("_old"), level_bin(old).alias("_old_level")).select(
        *columns, "_old", "_old_level", constant_rows(sensitivity_settings(base))
    )
    scored = rows.withColumn("_new", weighted_sum({f: F.col(f"w_{f}") for f in fixed.FACTORS}))
    scored = scored.select(
        "factor", "weight", F.abs(F.col("_new") - F.col("_old")).alias("_change"),
        "_old_level", level_bin("_new").alias("_level"),
    )
    has_level = count_if(F.col("_level").isNotNull())
    pct = lambda name: F.coalesce(
        F.try_divide(100.0 * count_if(F.col("_level") == name), has_level), F.lit(0.0)
    )
    same = F.coalesce(F.col("_level") == F.col("_old_level"), F.lit(False))
    return scored.groupBy("factor", "weight").agg(
        F.avg("_change").alias("score_change"),
        (100.0 * share(~same)).alias("level_change_pct"),
        pct("Low").alias("low_pct"),
        pct("Medium").alias("medium_pct"),
        pct("High").alias("high_pct"),
    )


def most_sensitive(sensitivity: DataFrame) -> DataFrame:
    """The factor with the largest maximum of changed levels; ties by name."""
    return (
        sensitivity.groupBy("factor")
        .agg(F.max("level_change_pct").alias("max_level_change_pct"))
        .orderBy(F.desc("max_level_change_pct"), "factor")
        .limit(1)
    )


def weight_combinations(options: Mapping[str, Sequence[float]] = fixed.WEIGHT_OPTIONS) -> list[dict]:
    """Every combination whose sum is within 0.99 to 1.01, scaled to sum 1."""
    rows = []
    for combo in product(*options.values()):
        total = reduce(lambda a, b: a + b, combo)
        if 0.99 <= total <= 1.01:
            rows.append({f"w_{f}": w * (1.0 / total) for f, w in zip(options, combo)})
    return [{"combo": i} | r for i, r in enumerate(rows)]


def weight_search(
    factors: DataFrame, options: Mapping[str, Sequence[float]] = fixed.WEIGHT_OPTIONS
) -> DataFrame:
    """Level entropy, score variance, balance and their combined score per combination."""
    weights = [f"w_{f}" for f in fixed.FACTORS]
    rows = factors.select(*[f"f_{f}" for f in fixed.FACTORS], constant_rows(weight_combinations(options)))
    score = weighted_sum({f: F.col(f"w_{f}") for f in fixed.FACTORS})
    scored = rows.select("combo", *weights, score.alias("_s")).withColumn("_level", level_bin("_s"))
    has_level = count_if(F.col("_level").isNotNull())
    pct = lambda name: F.coalesce(
        F.try_divide(count_if(F.col("_level") == name).cast("double"), has_level), F.lit(0.0)
    )
    per_combo = scored.groupBy("combo", *weights).agg(
        F.var_samp("_s").alias("score_variance"),
        pct("Low").alias("low_pct"), pct("Medium").alias("med_pct"), pct("High").alias("high_pct"),
    )
    shares = [F.col("low_pct"), F.col("med_pct"), F.col("high_pct")]
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    entropy = -add([F.when(p > 0, p * F.log(p)).otherwise(0.0) for p in shares])
    balance = 1.0 - add([F.abs(p - F.lit(1.0 / 3.0)) for p in shares]) / 2.0
    measured = per_combo.withColumn("entropy", entropy).withColumn("balance", balance)
    # One row per combination, so the window over all of them is small.
    top = Window.partitionBy()
    measures = ["entropy", "score_variance", "balance"]
    parts = [F.col(m) / F.max(m).over(top) for m in measures]
    return measured.withColumn("combined_score", add(parts) / 3.0)


def best_weights(search: DataFrame, criterion: str = "combined_score") -> DataFrame:
    """The combination that leads by one criterion; ties by number."""
    return search.orderBy(F.desc(criterion), "combo").limit(1)


def weight_contributions(
    factors: DataFrame, weights: Mapping[str, float] = fixed.TUNING_WEIGHTS
) -> DataFrame:
    """(factor, contribution, share): mean of factor times weight, part of the mean score."""
    means = factors.agg(
        *[F.avg(F.col(f"f_{f}") * F.lit(float(weights[f]))).alias(f) for f in fixed.FACTORS],
        F.avg(weighted_sum(weights)).alias("_total"),
    )
    rows = [{"factor": sql_value(f), "contribution": f, "share": f"try_divide({f}, _total)"} for f in fixed.FACTORS]
    return means.select(rows_of(rows))


def score_statistics(df: DataFrame, score: str = "urgency_score") -> DataFrame:
    """One row: mean, median, std, min, max of a score and the count of each level."""
    df = cut_lineage(df.select(score))
    level = level_bin(score)
    stats = df.agg(
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"), F.max(score).alias("max"),
        *[count_if(level == name).alias(f"n_{name.lower()}") for name in fixed.LEVELS],
    )
    median = exact_quantiles(df, score, [0.5]).select("quantile").scalar()
    return stats.withColumn("median", median)


def tfidf_sweep(
    docs: DataFrame,
    text: str = "clean_text",
    min_dfs: Sequence[int] = fixed.MIN_DF_GRID,
    max_dfs: Sequence[float] = fixed.MAX_DF_GRID,
) -> DataFrame:
    """Vocabulary measures per (min_df, max_df).

    Term counts are computed once; the number of filled cells is the sum of the
    document counts of the kept terms, so no matrix is built.
    """
    grid = [{"min_df": int(a), "max_df": float(b)} for a, b in product(min_dfs, max_dfs)]
    n = n_docs(docs).cast("double")
    per_term = term_counts(docs, text).select("doc_count", constant_rows(grid))
    d = F.col("doc_count")
    kept = (d >= F.col("min_df")) & (d <= F.col("max_df") * n)
    measures = per_term.groupBy("min_df", "max_df").agg(
        count_if(kept).alias("vocab_size"),
        F.sum(F.when(kept, d).otherwise(0)).alias("_nnz"),
        count_if(kept & (d >= F.col("max_df") * n)).alias("removed_high_freq"),
        F.count("*").alias("_reference"),
    )
    # Case-sensitive blank-separated words, counted over the corpus.
    words = (
        docs.select(F.explode(F.split(F.trim(F.col(text)), r"[\s\p{Z}]+")).alias("word"))
        .filter("word != ''")
        .groupBy("word")
        .agg(F.count("*").alias("c"))
    )
    low = words.agg(
        F.count("*").alias("_unique"), *[count_if(F.col("c") < m).alias(f"_low{m}") for m in min_dfs]
    )
    low_rows = low.select(
        "_unique", rows_of([{"min_df": str(m), "removed_low_freq": f"_low{m}"} for m in min_dfs])
    )
    joined = measures.join(low_rows, "min_df").withColumn(
        "sparsity_pct",
        100.0 * (1.0 - F.try_divide(F.col("_nnz").cast("double"), n * F.col("vocab_size"))),
    )
    return joined.select(
        "min_df", "max_df", "vocab_size",
        (100.0 * F.col("vocab_size") / F.col("_unique")).alias("vocab_coverage_pct"),
        "sparsity_pct", "removed_low_freq", "removed_high_freq",
        F.try_divide(100.0 * F.col("vocab_size"), F.col("_reference")).alias("vocab_percent_of_reference"),
    )


def tfidf_sweep_top_terms(
    docs: DataFrame,
    key: str,
    text: str = "clean_text",
    min_dfs: Sequence[int] = fixed.MIN_DF_GRID,
    max_dfs: Sequence[float] = fixed.MAX_DF_GRID,
    k: int = 10,
) -> DataFrame:
    """(min_df, max_df, rank, term, mean_weight): leading terms of every setting.

    Term weights do not depend on the setting, only the length of a document's row
    does. So the postings are built once, each document gets one length per setting
    where its postings are, and one aggregate per term holds the sums of all settings.
    """
    grid = list(product(min_dfs, max_dfs))
    # Counted once: as a subquery it would stand in each of the conditions below.
    n = float(docs.count())
    counts = term_counts(docs, text).select("term", "doc_count")
    weighted = (
        join_vocabulary(term_frequencies(docs, key, text), counts, None)
        .withColumn("_w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("doc_count"))) + 1.0))
    )
    # A term is in a setting if its document count lies between the two bounds.
    kept = [f"doc_count >= {a} AND doc_count <= {sql_value(b * n)}" for a, b in grid]
    within = "OVER (PARTITION BY doc_key)"
    shares = weighted.select(
        "term",
        *[F.expr(f"CASE WHEN {c} THEN _w / sqrt(sum(CASE WHEN {c} THEN _w * _w END) {within}) END AS _u{i}") for i, c in enumerate(kept)],
    )
    sums = shares.groupBy("term").agg(*[F.sum(f"_u{i}").alias(f"_s{i}") for i in range(len(kept))])
    entries = [
        {"min_df": str(a), "max_df": sql_value(float(b)), "_sum": f"_s{i}"} for i, (a, b) in enumerate(grid)
    ]
    long = (
        sums.select("term", rows_of(entries))
        .filter("_sum is not null")
        .withColumn("mean_weight", F.col("_sum") / n)
        .drop("_sum")
    )
    order = Window.partitionBy("min_df", "max_df").orderBy(F.round("mean_weight", 9).desc(), "term")
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_tfidf(sweep: DataFrame) -> DataFrame:
    """The setting with the best mix of coverage, density and reference share."""
    score = (
        0.4 * F.col("vocab_coverage_pct")
        + 0.3 * (100.0 - F.col("sparsity_pct"))
        + 0.3 * F.col("vocab_percent_of_reference")
    )
    return sweep.withColumn("score", score).orderBy(F.desc("score"), "min_df", "max_df").limit(1)


def contamination_sweep(
    scores: DataFrame, score: str = "anomaly_score", values: Sequence[float] = CONTAMINATIONS
) -> DataFrame:
    """Cut, number of anomalies and score spread per contamination, from scores made once.

    ``gap`` is the distance of the mean score above the cut to the mean below it. The
    score column is stored first, so a model behind it scores each row once.
    """
    scores = cut_lineage(scores.select(score))
    cuts = exact_quantiles(scores, score, [1.0 - c for c in values])
    by_setting = cuts.select(
        F.array_sort(F.collect_list(F.struct("prob", F.col("quantile").alias("cut")))).alias("_c")
    ).scalar()
    numbered = scores.select(F.col(score).cast("double").alias("_s")).filter("_s is not null")
    # Highest prob first, so settings line up with ascending contamination.
    rows = numbered.select("_s", F.posexplode(F.reverse(by_setting)).alias("setting", "_x")).select(
        "_s", "setting", F.col("_x.cut").alias("cut")
    )
    above = F.col("_s") > F.col("cut")
    values_col = F.array(*[F.lit(float(c)) for c in values])
    return rows.groupBy("setting", "cut").agg(
        F.avg("_s").alias("avg_anomaly_score"),
        count_if(above).alias("anomalies_count"),
        F.var_pop("_s").alias("score_variance"),
        (F.avg(F.when(above, F.col("_s"))) - F.avg(F.when(~above, F.col("_s")))).alias("gap"),
    ).withColumn("contamination", F.get(values_col, F.col("setting")))


def elbow(sweep: DataFrame, metric: str = "cut") -> DataFrame:
    """One row: contamination at the elbow and where the curve levels off.

    The elbow is the largest absolute second difference, the first one on a tie; the
    curve levels off at the first step below a tenth of the largest step, else at the
    elbow.
    """
    order = Window.partitionBy().orderBy("contamination")
    rows = sweep.select("contamination", F.round(metric, 12).alias("_m"))
    rows = rows.select(
        "contamination",
        F.lag("contamination").over(order).alias("_prev"),
        (F.col("_m") - F.lag("_m").over(order)).alias("_d"),
        (F.lead("_m").over(order) - 2 * F.col("_m") + F.lag("_m").over(order)).alias("_dd"),
    )
    rows = rows.withColumn("_limit", 0.1 * F.max(F.abs("_d")).over(Window.partitionBy()))
    picked = rows.agg(
        F.max_by(
            F.when(F.col("_dd").isNotNull(), F.col("contamination")),
            F.when(F.col("_dd").isNotNull(), F.struct(F.abs("_dd"), -F.col("contamination"))),
        ).alias("elbow"),
        F.min(F.when(F.abs("_d") < F.col("_limit"), F.col("_prev"))).alias("_level"),
    )
    return picked.select("elbow", F.coalesce("_level", "elbow").alias("level_off"))


def contamination_gradient(sweep: DataFrame, metric: str = "cut") -> DataFrame:
    """(contamination, gradient): central differences, one-sided at both ends."""
    order = Window.partitionBy().orderBy("contamination")
    before, after, here = F.lag(metric).over(order), F.lead(metric).over(order), F.col(metric)
    return sweep.select(
        "contamination",
        F.when(F.lag(F.lit(1)).over(order).isNull(), after - here)
        .when(F.lead(F.lit(1)).over(order).isNull(), here - before)
        .otherwise((after - before) / 2.0)
        .alias("gradient"),
    )


SCORECARD_WEIGHTS = {"quality": 0.35, "speed": 0.25, "efficiency": 0.15, "understanding": 0.25}


def scorecard(metrics: DataFrame, weights: Mapping[str, float] = SCORECARD_WEIGHTS) -> DataFrame:
    """Model scores from silhouette, within_similarity, texts_per_second, size_mb,
    dimension, contrast_ratio and avg_delta; speed is relative to the fastest."""
    top = F.max("texts_per_second").over(Window.partitionBy())
    scored = metrics.withColumns(
        {
            "quality": (F.col("silhouette") + 1.0) / 2.0 * 5.0 + F.col("within_similarity") * 5.0,
            "speed": F.least(F.lit(10.0), F.col("texts_per_second") / top * 10.0),
            "efficiency": 10.0 - F.least(F.lit(10.0), F.col("size_mb") / 100.0)
            + F.least(F.lit(5.0), F.col("dimension") / 200.0),
            "understanding": F.least(F.lit(5.0), F.col("contrast_ratio"))
            + 5.0 * (1.0 - F.least(F.lit(1.0), F.col("avg_delta") * 2.0)),
        }
    )
    total = reduce(
        lambda a, b: a + b, [F.coalesce(F.col(k), F.lit(0.0)) * F.lit(w) for k, w in weights.items()]
    )
    return scored.withColumn("total_score", total)


def best_model(scores: DataFrame, name: str = "model") -> DataFrame:
    return scores.orderBy(F.desc("total_score"), name).limit(1)
