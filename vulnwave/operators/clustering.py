"""Clusters of embeddings, their quality, projection to two dimensions, samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.vectors import cosine, dot, total, unit
from ..session import checked_broadcast


def sample(df: DataFrame, key: str, n: int, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows (per group of ``by``) with the lowest draw of key and seed.

    Per group, only rows whose draw lies below a bound that about four times ``n`` of
    its rows pass are ranked, so a group holding a third of all rows makes no large task.
    A group too small for that is ranked whole.
    """
    place = draw(seed, F.col(key))
    if not by:
        return df.orderBy(place, key).limit(n)
    sizes = df.groupBy(*by).agg(F.count("*").alias("_size"))
    sizes = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in by], (F.lit(4.0 * n + 40) / F.col("_size")).alias("_bound"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    near = df.withColumn("_draw", place).join(checked_broadcast(sizes), reduce(lambda x, y: x & y, same))
    w = Window.partitionBy(*by).orderBy("_draw", F.col(key))
    ranked = near.filter(F.col("_draw") < F.col("_bound")).withColumn("_rank", F.row_number().over(w))
    return ranked.filter(F.col("_rank") <= n).select(*df.columns)


def kmeans(df: DataFrame, vector: str = "embedding", k: int = 5, seed: int = 42, out: str = "cluster") -> DataFrame:
    """Add the cluster number of each row."""
    features = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out).fit(features.select("_v"))
    return model.transform(features).drop("_v")


def _totals(df: DataFrame, label: str, vector: str, normalise: bool = False) -> DataFrame:
    """(cluster, dim, total): vector sums per cluster, combined before the shuffle."""
    v = unit(vector) if normalise else F.col(vector).cast("array<double>")
    return (
        df.select(F.col(label).alias("cluster"), F.posexplode(v).alias("dim", "x"))
        .groupBy("cluster", "dim")
        .agg(F.sum("x").alias("total"))
    )


def _as_vector(totals: DataFrame) -> DataFrame:
    return totals.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "total"))), lambda s: s["total"]).alias("total")
    )


def silhouette(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """One row: mean silhouette under squared Euclidean distance, exact, in linear time.

    The mean squared distance of a point to a cluster follows from the cluster's
    size, vector sum and sum of squares, so no pairs are formed. The cluster table
    (one row per label) is carried as one value. Clusters of one point score 0.
    """
    v = F.col(vector).cast("array<double>")
    sizes = df.groupBy(F.col(label).alias("cluster")).agg(
        F.count("*").alias("n"), F.sum(dot(vector, vector)).alias("squares")
    )
    clusters = sizes.join(_as_vector(_totals(df, label, vector)), "cluster")
    table = clusters.select(F.collect_list(F.struct("cluster", "n", "squares", "total"))).scalar()
    points = df.select(
        F.col(label).alias("_l"), v.alias("_v"), dot(vector, vector).alias("_q"), table.alias("_t")
    )

    def far(c):  # summed squared distance of the point to all members of c
        return c["n"] * F.col("_q") + c["squares"] - 2.0 * total(F.zip_with(F.col("_v"), c["total"], lambda a, b: a * b))

    spans = points.select(
        "_l",
        F.transform(
            "_t", lambda c: F.struct((c["cluster"] == F.col("_l")).alias("own"), c["n"].alias("n"), far(c).alias("d"))
        ).alias("_c"),
    )
    own = F.element_at(F.filter("_c", lambda s: s["own"]), 1)
    scored = spans.select(
        F.when(own["n"] > 1, F.greatest(own["d"], F.lit(0.0)) / (own["n"] - 1)).alias("a"),
        F.array_min(
            F.transform(F.filter("_c", lambda s: ~s["own"]), lambda s: F.greatest(s["d"], F.lit(0.0)) / s["n"])
        ).alias("b"),
    )
    s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return scored.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(s)).alias("silhouette"))


def silhouette_sample(
    df: DataFrame, key: str, label: str, vector: str = "embedding", n: int = 500, seed: int = 42
) -> DataFrame:
    """One row: mean Euclidean silhouette of a fixed-size sample, as the tuning report takes it.

    Plain distances need all pairs, so this is done on ``n`` sampled rows only, held
    in one small task; `silhouette` is the exact measure for whole tables.
    """
    chosen = sample(df, key, n, seed).select(
        F.lit(0).alias("_one"), F.col(label).alias("cluster"), F.col(vector).cast("array<double>").alias("v")
    )

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        x, c = np.vstack(group["v"].to_numpy()), group["cluster"].to_numpy()
        sq = (x * x).sum(axis=1)
        d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
        np.fill_diagonal(d, 0)
        labels, own = np.unique(c, return_inverse=True)
        sizes = np.bincount(own)
        sums = np.stack([d[:, own == j].sum(axis=1) for j in range(len(labels))], axis=1)
        rows = np.arange(len(c))
        a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
        means = sums / sizes
        means[rows, own] = np.inf
        b = means.min(axis=1)
        top = np.maximum(a, b)
        s = np.where((sizes[own] > 1) & np.isfinite(b) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
        return pd.DataFrame({"silhouette": [float(s.mean())], "n": [len(c)]})

    return chosen.groupBy("_one").applyInPandas(measure, "silhouette double, n long")


def calinski_harabasz(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """One row: ratio of the spread between clusters to the spread within them."""
    per_dim = (
        df.select(F.col(label).alias("cluster"), F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
        .groupBy("cluster", "dim")
        .agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    )
    overall = Window.partitionBy("dim")
    centred = per_dim.withColumn(
        "centre", F.sum(F.col("n") * F.col("mean")).over(overall) / F.sum("n").over(overall)
    )
    sums = centred.agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("centre"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.count_distinct("cluster").alias("k"),
        F.sum(F.when(F.col("dim") == 0, F.col("n"))).alias("n"),
    )
    return sums.select(
        F.when(
            F.col("within") > 0,
            F.col("between") / F.col("within") * (F.col("n") - F.col("k")) / (F.col("k") - 1),
        ).otherwise(1.0).alias("calinski_harabasz")
    )


def within_cluster_cosine(
    df: DataFrame, label: str, vector: str = "embedding", reference_compat: bool = False
) -> DataFrame:
    """(cluster, n, mean_cosine) over pairs of different members, in linear time.

    The squared length of the sum of unit vectors is the sum of all pairwise cosines.
    ``reference_compat`` leaves the n self-similarities in. Clusters of one point
    give 0. The overall figure is the mean over clusters.
    """
    v = unit(vector)
    pairs = (
        _totals(df, label, vector, normalise=True)
        .groupBy("cluster")
        .agg(F.sum(F.col("total") * F.col("total")).alias("_all"))
    )
    sizes = df.select(F.col(label).alias("cluster"), dot(v, v).alias("_self")).groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum("_self").alias("_own")
    )
    own = F.lit(0.0) if reference_compat else F.col("_own")
    mean = F.when(F.col("n") > 1, (F.col("_all") - own) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return sizes.join(pairs, "cluster").select("cluster", "n", mean.alias("mean_cosine"))


def pair_similarity(pairs: DataFrame, a: str, b: str, expected: str) -> DataFrame:
    """Add ``similarity`` and ``delta`` to labelled pairs of vectors."""
    return pairs.withColumn("similarity", cosine(a, b)).withColumn(
        "delta", F.abs(F.col("similarity") - F.col(expected))
    )


def similarity_report(pairs: DataFrame, expected: str = "expected", high: float = 0.6, low: float = 0.3) -> DataFrame:
    """One row: mean delta, mean similarity of high and low pairs, their ratio."""
    means = pairs.agg(
        F.avg("delta").alias("avg_delta"),
        F.avg(F.when(F.col(expected) >= high, F.col("similarity"))).alias("high_avg"),
        F.avg(F.when(F.col(expected) <= low, F.col("similarity"))).alias("low_avg"),
    )
    ratio = F.when(F.col("low_avg") > 0, F.col("high_avg") / F.col("low_avg")).otherwise(F.lit(float("inf")))
    return means.withColumn("contrast_ratio", ratio)


def project_2d(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add ``x`` and ``y``: the first two principal components."""
    features = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(features.select("_v"))
    p = vector_to_array("_p")
    return model.transform(features).withColumns({"x": F.get(p, F.lit(0)), "y": F.get(p, F.lit(1))}).drop("_v", "_p")
