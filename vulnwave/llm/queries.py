"""One registered query an operator, over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vulnwave.llm import ann, bpe, conversations, decontaminate, fingerprints, langid, mixing, pii, simhash, spelling, suffixes, token_counts, warc
from vulnwave.llm.util import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RANKS = "byte_bpe_multi_50k.tiktoken"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of every document, of its edited text, and how near they are to each other and to the next document."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query()
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those that the field adds."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query(mixing.MIX_SQL)
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of one and a half times the corpus takes from each document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query(warc.SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@query()
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest of every twentieth vector by inner product."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest id it is linked to, over any number of links."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document without the strings of 400 bytes that start elsewhere too."""
    return suffixes.digest(table(spark, sf_dir, "documents"))


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each document encoded as a whole."""
    return token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that aren't held out."""
    return langid.predictions(table(spark, sf_dir, "documents"))


@query()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the ids decoded again, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query()
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of ten words of some benchmark item."""
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the cheapest edits that mend it, and the digest of what they give."""
    return conversations.digest(table(spark, sf_dir, "conversations"))


@query()
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the spelling variants in the vocabulary of the documents."""
    return spelling.corpus_variants(table(spark, sf_dir, "documents"))
