"""Vocabulary, TF-IDF (long form and vectors), random projection, top terms.

Weights: ``tf * (ln((1 + n) / (1 + df)) + 1)``, rows scaled to length 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.text import counted, squeeze, terms
from ..session import BROADCAST_ROWS, checked_broadcast, cut_lineage

# A term in more than 1 / HOT_SHARE of all (document, term) rows is a hot join key;
# there are at most HOT_SHARE such terms.
HOT_SHARE = 10_000
# Entries of vectors that are projected at a time.
PROJECTED = 100_000


def n_docs(docs: DataFrame) -> Column:
    """Row count as a scalar subquery."""
    return docs.agg(F.count("*")).scalar()


def term_counts(docs: DataFrame, text: str, ngrams: tuple[int, int] = (1, 1)) -> DataFrame:
    """(term, corpus_count, doc_count) of all terms: one pass, one shuffle.

    Each row emits its distinct terms with their counts, so the
    two counts come from one aggregate that is combined before the shuffle.
    """
    rows = docs.select(F.inline(counted(terms(text, ngrams))))
    return rows.groupBy("term").agg(F.sum("n").alias("corpus_count"), F.count("*").alias("doc_count"))


def _at_least(bound: int | float, n: Column) -> Column:
    return F.lit(float(bound)) if isinstance(bound, int) else F.lit(bound) * n


def vocabulary(
    docs: DataFrame,
    text: str = "clean_text",
    *,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    max_features: int | None = None,
    ngrams: tuple[int, int] = (1, 1),
) -> DataFrame:
    """Kept terms. Integers bound the number of documents, floats their share.

    ``max_features`` keeps the most frequent by corpus count, ties by term.
    """
    n = n_docs(docs)
    kept = term_counts(docs, text, ngrams).filter(
        (F.col("doc_count") >= _at_least(min_df, n)) & (F.col("doc_count") <= _at_least(max_df, n))
    )
    if max_features is None:
        return kept
    return kept.orderBy(F.desc("corpus_count"), "term").limit(max_features)


def term_frequencies(
    docs: DataFrame, key: str, text: str = "clean_text", ngrams: tuple[int, int] = (1, 1)
) -> DataFrame:
    """(doc_key, term, tf), dealt out by document.

    The texts are shuffled once, by document, and are smaller than their postings; the
    counts and whatever else is grouped by document then need no further shuffle.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("_text")).repartition(parts, "doc_key")
    return (
        dealt.select("doc_key", F.inline(counted(terms("_text", ngrams))))
        .groupBy("doc_key", "term")
        .agg(F.sum("n").alias("tf"))
    )


def join_vocabulary(tf: DataFrame, vocab: DataFrame, max_features: int | None) -> DataFrame:
    """Postings of kept terms with their document count, dealt out by document as ``term_frequencies`` leaves them.

    A vocabulary bounded by ``max_features`` is broadcast. An unbounded one is stored
    first, so that it is counted once however often it is read; it is broadcast if that
    shows it is small. Beyond that its most frequent terms, which hold most of the postings, are broadcast.
    The postings of the others meet their terms in a shuffle join in which no key is hot, and go back to their documents.
    """
    slim = vocab.select("term", "doc_count")
    if max_features is not None and max_features <= BROADCAST_ROWS:
        return tf.join(F.broadcast(slim), "term")
    slim = cut_lineage(slim)
    # as many rows as there are different counts: about the square root of twice the postings at most
    counts = sorted((tuple(r) for r in slim.groupBy("doc_count").agg(F.count("*")).collect()), reverse=True)
    if sum(n for _, n in counts) <= BROADCAST_ROWS:
        return tf.join(F.broadcast(slim), "term")
    total, often, held = sum(c * n for c, n in counts), float("inf"), 0
    for c, n in counts:
        held += n
        if held > BROADCAST_ROWS and c * HOT_SHARE <= total:
            break
        often = c
    hot, cold = slim.filter(F.col("doc_count") >= often), slim.filter(F.col("doc_count") < often)
    hot_terms = F.broadcast(hot.select(F.col("term").alias("_t")))
    rest = tf.join(hot_terms, F.col("term") == F.col("_t"), "left_anti").join(cold, "term")
    parts = int(tf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tf.join(F.broadcast(hot), "term").unionByName(rest.repartition(parts, "doc_key"))


def tfidf(
    docs: DataFrame,
    vocab: DataFrame,
    key: str,
    text: str = "clean_text",
    *,
    ngrams: tuple[int, int] = (1, 1),
    max_features: int | None = None,
    n: Column | int | None = None,
) -> DataFrame:
    """Long form: (doc_key, term, tf, weight). ``n`` is the size of the fitted corpus."""
    n = n_docs(docs) if n is None else (F.lit(n) if isinstance(n, int) else n)
    tf = term_frequencies(docs, key, text, ngrams)
    idf = F.log((1.0 + n) / (1.0 + F.col("doc_count"))) + 1.0
    weighted = join_vocabulary(tf, vocab, max_features).withColumn("_w", F.col("tf") * idf)
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_key")))
    return weighted.select("doc_key", "term", "tf", (F.col("_w") / length).alias("weight"))


def top_terms_tfidf(weights: DataFrame, n: Column | int, k: int = 20) -> DataFrame:
    """(term, mean_weight): mean over all ``n`` documents, absent counts 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return (
        weights.groupBy("term")
        .agg(F.sum("weight").alias("_s"))
        .select("term", (F.col("_s") / n).alias("mean_weight"))
        .orderBy(F.round("mean_weight", 9).desc(), "term")
        .limit(k)
    )


def top_terms(docs: DataFrame, text: str = "clean_text", k: int = 50) -> DataFrame:
    """Most common blank-separated words of a text, case kept.

    ``document_percent`` is occurrences per 100 documents and may pass 100;
    ``doc_freq_pct`` is the true share of documents.
    """
    words = docs.select(F.explode(F.array(F.split(squeeze(text), " "))).alias("w"))
    pair = lambda o, d: lambda t: F.struct(t.alias("term"), F.lit(o).alias("o"), F.lit(d).alias("d"))
    rows = words.select(
        F.inline(F.concat(F.transform("w", pair(1, 0)), F.transform(F.array_distinct("w"), pair(0, 1))))
    ).filter("term != ''")
    n = n_docs(docs)
    return (
        rows.groupBy("term")
        .agg(F.sum("o").alias("count"), F.sum("d").alias("_d"))
        .orderBy(F.desc("count"), "term")
        .limit(k)
        .select(
            "term", "count",
            (100.0 * F.col("count") / n).alias("document_percent"),
            (100.0 * F.col("_d") / n).alias("doc_freq_pct"),
        )
    )


@dataclass
class TfidfModel:
    """Fitted vocabulary, bounded by ``max_features``; adds a vector without a shuffle."""

    terms: list[str]
    doc_counts: list[int]
    n: int
    ngrams: tuple[int, int]

    @classmethod
    def fit(
        cls,
        docs: DataFrame,
        text: str = "clean_text",
        *,
        min_df: int | float = 2,
        max_df: int | float = 0.8,
        max_features: int = 5_000,
        ngrams: tuple[int, int] = (1, 1),
    ) -> TfidfModel:
        vocab = vocabulary(
            docs, text, min_df=min_df, max_df=max_df, max_features=max_features, ngrams=ngrams
        )
        rows = vocab.select("term", "doc_count", n_docs(docs).alias("n")).collect()
        rows.sort(key=lambda r: r["term"])
        if not rows:
            raise ValueError("no term is left; lower min_df or raise max_df")
        return cls([r["term"] for r in rows], [r["doc_count"] for r in rows], rows[0]["n"], ngrams)

    def transform(self, df: DataFrame, text: str = "clean_text", out: str = "tfidf") -> DataFrame:
        counter = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_terms", outputCol="_tf")
        idf = np.log((1.0 + self.n) / (1.0 + np.array(self.doc_counts, dtype=float))) + 1.0
        scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_w")
        unit = Normalizer(p=2.0, inputCol="_w", outputCol=out)
        words = df.withColumn("_terms", terms(F.coalesce(F.col(text), F.lit("")), self.ngrams))
        return unit.transform(scale.transform(counter.transform(words))).drop("_terms", "_tf", "_w")


def projection_matrix(n_features: int, k: int, seed: int) -> np.ndarray:
    """Sparse random signs: density 1/sqrt(F), entries +-1/sqrt(density * k)."""
    density = 1.0 / np.sqrt(n_features)
    rng = np.random.default_rng(seed)
    draw = rng.random((n_features, k))
    signs = np.where(draw < density / 2, 1.0, np.where(draw < density, -1.0, 0.0))
    return signs / np.sqrt(density * k)


@lru_cache(maxsize=2)
def projection_signs(n_features: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of ``projection_matrix`` that aren't zero, row after row: first entry of each row, columns, values."""
    matrix = projection_matrix(n_features, k, seed)
    rows, columns = np.nonzero(matrix)
    return np.searchsorted(rows, np.arange(n_features + 1)), columns, matrix[rows, columns]


def projected(vectors: pa.Array, signs: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, entries: int = PROJECTED) -> pa.Array:
    """Lists of ``k`` numbers for a batch of sparse vectors, made for about ``entries`` of their entries at a time."""
    first, columns, values = signs
    indices, weights = vectors.field("indices"), vectors.field("values")
    lengths = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    slots, weights = indices.flatten().to_numpy(), weights.flatten().to_numpy()
    ends = np.cumsum(lengths)
    result = np.zeros(len(vectors) * k)
    start = done = 0
    while start < len(vectors):
        stop = max(start + 1, int(np.searchsorted(ends, done + entries, "right")))
        held = slice(done, int(ends[stop - 1]))
        here = slots[held]
        # every entry (row, slot) meets the signs of its slot
        each = first[here + 1] - first[here]
        at = np.arange(each.sum()) + np.repeat(first[here] - (np.cumsum(each) - each), each)
        cells = np.repeat(np.repeat(np.arange(stop - start) * k, lengths[start:stop]), each) + columns[at]
        result[start * k : stop * k] = np.bincount(cells, np.repeat(weights[held], each) * values[at], (stop - start) * k)
        start, done = stop, held.stop
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(vectors) + 1) * k, k, dtype=np.int32)), pa.array(result))


def random_projection(
    df: DataFrame, vector: str, n_features: int, k: int = 256, seed: int = 42, out: str = "projected"
) -> DataFrame:
    """Project a sparse vector column to ``k`` numbers (``ARRAY<DOUBLE>``) without a shuffle.

    Only the non-zero entries travel to Python, in Arrow batches, and a batch is a few sparse products of bounded size. The signs
    are drawn from the seed once in each worker; their size is bounded by ``n_features * k``.
    """

    @F.arrow_udf("array<double>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        signs = projection_signs(n_features, k, seed)
        for v in batches:
            yield projected(v, signs, k)

    return df.withColumn(out, project(F.col(vector)))


def projection_terms(vocab: DataFrame, n_features: int, k: int = 256, seed: int = 42) -> DataFrame:
    """(term, component, sign): the sparse sign table, drawn by hash of term and component."""
    density = 1.0 / float(np.sqrt(n_features))
    place = draw(seed, F.col("term"), F.col("component"))
    value = 1.0 / float(np.sqrt(density * k))
    return (
        vocab.select("term", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("component"))
        .withColumn("_u", place)
        .filter(F.col("_u") < density)
        .select("term", "component", F.when(F.col("_u") < density / 2, value).otherwise(-value).alias("sign"))
    )


def project_long(weights: DataFrame, signs: DataFrame) -> DataFrame:
    """(doc_key, component, value) of long-form weights; combined before the shuffle."""
    grouped = signs.groupBy("term").agg(F.collect_list(F.struct("component", "sign")).alias("_s"))
    return (
        weights.join(checked_broadcast(cut_lineage(grouped)), "term")
        .select("doc_key", "weight", F.inline("_s"))
        .groupBy("doc_key", "component")
        .agg(F.sum(F.col("weight") * F.col("sign")).alias("value"))
    )
