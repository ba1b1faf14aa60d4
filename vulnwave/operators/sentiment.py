"""Sentiment and embeddings with exchangeable models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import terms
from .tfidf import TfidfModel, random_projection

Scorer = Callable[[pd.Series], pd.Series]


def lexicon_score(
    text: Column | str,
    positive: Iterable[str] = tuple(fixed.POSITIVE_WORDS),
    negative: Iterable[str] = tuple(fixed.NEGATIVE_WORDS),
) -> Column:
    """(positive - negative) / (positive + negative) words, 0 when neither occurs.

    Counted inside the row: no join with the lexicon and no shuffle.
    """
    pos, neg = sorted(positive), sorted(negative)
    counted = F.aggregate(
        terms(text),
        F.struct(F.lit(0).alias("p"), F.lit(0).alias("n")),
        lambda acc, w: F.struct(
            (acc["p"] + w.isin(pos).cast("int")).alias("p"), (acc["n"] + w.isin(neg).cast("int")).alias("n")
        ),
        lambda acc: F.when(
            acc["p"] + acc["n"] > 0, (acc["p"] - acc["n"]) / (acc["p"] + acc["n"])
        ).otherwise(F.lit(0.0)),
    )
    return F.coalesce(counted, F.lit(0.0))


def _scores(model: Scorer, texts: pd.Series) -> pd.Series:
    """Scores of the texts; one that the model fails on is NaN, the others keep theirs.

    A batch that fails is halved until the failing texts stand alone.
    """
    try:
        return pd.Series(pd.Series(model(texts)).to_numpy(dtype=float), index=texts.index)
    except Exception:  # noqa: BLE001 - any failure of a user's model
        if len(texts) == 1:
            return pd.Series(float("nan"), index=texts.index)
        half = len(texts) // 2
        return pd.concat([_scores(model, texts.iloc[:half]), _scores(model, texts.iloc[half:])])


def sentiment(
    df: DataFrame,
    text: str = "clean_text",
    scorer: Callable[[], Scorer] | None = None,
    out: str = "sentiment",
    failed: str | None = None,
) -> DataFrame:
    """Add a score in [-1, 1].

    ``scorer`` is a factory that loads a model once per Python worker and returns a
    function Series -> Series; it sees whole texts in Arrow batches. A text that it
    fails on scores 0, others of its batch keep theirs; ``failed`` names a column that
    tells which. Without a scorer the lexicon is used.
    """
    if scorer is None:
        scored = df.withColumn(out, lexicon_score(text))
        return scored.withColumn(failed, F.lit(False)) if failed else scored

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer()
        for batch in batches:
            yield _scores(model, batch.fillna("")).clip(-1.0, 1.0)

    raw = f"_{out}_raw"
    scored = df.withColumn(raw, F.nanvl(score(F.col(text)), F.lit(None).cast("double")))
    if failed:
        scored = scored.withColumn(failed, F.col(raw).isNull())
    return scored.withColumn(out, F.coalesce(raw, F.lit(0.0))).drop(raw)


def embed(
    df: DataFrame,
    text: str = "clean_text",
    encoder: Callable[[], Scorer] | None = None,
    *,
    dim: int = 64,
    max_features: int = 2_000,
    seed: int = 42,
    out: str = "embedding",
) -> DataFrame:
    """Add ``ARRAY<FLOAT>``: a user's encoder, else projected TF-IDF."""
    if encoder is not None:

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = encoder()
            for batch in batches:
                yield pd.Series(list(model(batch.fillna(""))))

        return df.withColumn(out, encode(F.col(text)))
    model = TfidfModel.fit(df, text, min_df=1, max_df=1.0, max_features=max_features)
    vectors = model.transform(df, text, "_v")
    projected = random_projection(vectors, "_v", len(model.terms), dim, seed, out).drop("_v")
    return projected.withColumn(out, F.col(out).cast("array<float>"))
