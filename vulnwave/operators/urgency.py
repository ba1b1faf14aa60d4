"""Urgency factors, score and level: one projection, no shuffle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.bins import level_bin, nan_to_null
from ..functions.text import keyword_flag, text_length
from ..sources.articles import as_date


def urgency_factors(
    df: DataFrame,
    as_of: str | dt.date | Column,
    *,
    text: str = "clean_text",
    sentiment_sign: int = 1,
    word_bounded: bool = False,
    extras: bool = True,
) -> DataFrame:
    """Add the six factors in [0, 1] (articles may pass 1) and, with ``extras``, the raw inputs.

    Missing score counts 0, missing tone 0.5, missing text has no patch, a missing
    date is 365 days old. ``sentiment_sign=-1`` makes negative tone raise urgency.
    """
    zero = F.lit(0.0)
    published = F.col("published_date").cast("date")
    age = F.greatest(F.datediff(as_date(as_of), published), F.lit(0))
    days = F.when(published.isNotNull(), age).otherwise(365)
    n = F.coalesce(F.col("n_articles"), F.lit(0)) if "n_articles" in df.columns else F.lit(0)
    tone = F.coalesce(nan_to_null(F.col("sentiment").cast("double")), zero) * F.lit(float(sentiment_sign))
    factors = {
        "severity": F.coalesce(nan_to_null(F.col("cvss_score").cast("double")), zero) / 10.0,
        "sentiment": (tone + 1.0) / 2.0,
        "exploit": keyword_flag(text, fixed.EXPLOIT_PATTERN, word_bounded).cast("double"),
        "patch": 1.0 - keyword_flag(text, fixed.PATCH_PATTERN, word_bounded).cast("double"),
        "recency": F.exp(-(days / 30.0)),
        "articles": F.log1p(n.cast("double")) / F.log1p(F.lit(10.0)),
    }
    if extras:
        factors |= {
            "days_old": days.cast("bigint"),
            "n_articles_raw": n.cast("bigint"),
            "text_length": text_length(text),
        }
    return df.withColumns({f"f_{k}": v for k, v in factors.items()})


def weighted_sum(weights: Mapping[str, float] | Mapping[str, Column], prefix: str = "f_") -> Column:
    """Sum of factor times weight, in the order of the factor list."""
    parts = [
        F.col(f"{prefix}{f}") * (w if isinstance(w, Column) else F.lit(float(w)))
        for f in fixed.FACTORS
        for w in [weights[f]]
    ]
    return reduce(lambda a, b: a + b, parts)


def urgency_score(
    factors: DataFrame, weights: Mapping[str, float] = fixed.PRODUCTION_WEIGHTS
) -> DataFrame:
    """Add ``urgency_score`` and ``urgency_level``."""
    return factors.withColumn("urgency_score", weighted_sum(weights)).withColumn(
        "urgency_level", level_bin("urgency_score")
    )


def assess_urgency(
    master: DataFrame,
    as_of: str | dt.date | Column,
    weights: Mapping[str, float] = fixed.PRODUCTION_WEIGHTS,
    **options: object,
) -> DataFrame:
    """Factors, score and level of the master table; factor columns are dropped again."""
    scored = urgency_score(urgency_factors(master, as_of, extras=False, **options), weights)
    return scored.drop(*[f"f_{f}" for f in fixed.FACTORS])
