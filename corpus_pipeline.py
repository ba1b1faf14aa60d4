"""A training corpus in five stages: language, near-duplicates, personal data, mix, tokens.

Each stage takes all that the one before kept, as Parquet. All but the last return the columns of documents; others are ignored,
whatever their names. Texts are taken whole, of any length.

Null and empty texts, and those without a letter, go in the first stage. A null ``lang`` becomes the one found, a null ``source`` is the last source of
the mix. Of a group of near-duplicates the smallest id stays, null ids last; repeated rows are one row. An empty table gives an empty
table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnwave.llm import bpe, langid, mixing, neardup, pii
from vulnwave.llm.util import table
from vulnwave.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (``und``: null or no letter); a null ``lang`` becomes the one found."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select(*COLUMNS), model).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of every group of near-duplicates."""
    return neardup.representatives(docs.select(*COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts <EMAIL>, <IP>, <CARD>, <PHONE> in the place of personal data."""
    clean = pii.redact(docs.select(*COLUMNS), pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.sample(docs.select(*COLUMNS))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids, and decoded_ok: the ids decode to the text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select("doc_id", "source", "lang", "text")
    back = bpe.encode(rows, path, public_tokenizers.PATTERN, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return back.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decoded_ok"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("mix", mixed),
    ("tokens", tokenised),
]

# Cross-parsing, the trained field and merges by rank have no SQL form; tests/llm hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
