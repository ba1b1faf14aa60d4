"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The lengths of its tokens give each token a span of characters, sections are spans of
characters too, and an interval join of the two (both are sorted, so a binary search for each bound) allots every token by a rule
that is stated for tokens that cross a boundary:

- ``start``: to the section of its first character (the default; counts add up to the document's),
- ``end``: to the section of its last character,
- ``most``: to the section that holds most of its bytes, the first of equals,
- ``share``: to every section that it touches, by its share of bytes (counts are fractions).

A token that begins or ends within a character counts as touching that character. Sections are the stretches between the
line breaks of ``text`` (a break belongs to the section that it ends), or the fields of a row, read as if joined by
one line break each. Sections of no characters have no tokens. A null text is a document of one
empty section, and so is an empty one. Texts are encoded whole, whatever their length. Rows aren't compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnwave.llm.bpe import load_ranks
from vulnwave.llm.util import slices, small_batches

PIECE_BYTES = 4_000_000
RULES = ("start", "end", "most", "share")


@cache
def _encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    ranks = load_ranks(path)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_ends(text: str, path: str, pattern: str) -> np.ndarray:
    """Byte offset at which each token of the text ends."""
    encoding, lengths = _encoder(path, pattern)
    return np.cumsum(lengths[np.array(encoding.encode_ordinary(text), np.int64)])


def allot(token_end: np.ndarray, section_end: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and how many tokens cross into each from the one before.

    Both arguments are byte offsets, in order, that cut the same text from 0 to its length.
    """
    n = len(section_end)
    token_start = np.concatenate([[0], token_end[:-1]]) if len(token_end) else token_end
    section_start = np.concatenate([[0], section_end[:-1]]) if n else section_end
    first = np.searchsorted(section_end, token_start, side="right")
    last = np.searchsorted(section_end, token_end - 1, side="right")
    crossing = np.zeros(n + 1, np.int64)
    cross = first != last
    np.add.at(crossing, first[cross] + 1, 1)
    np.add.at(crossing, last[cross] + 1, -1)
    crossing = np.cumsum(crossing)[:n] * (section_end > section_start)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crossing
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float), crossing
    if rule not in RULES:
        raise ValueError(f"no rule {rule}")
    counts = np.bincount(first[~cross], minlength=n).astype(float)
    for t in np.nonzero(cross)[0]:
        touched = np.arange(first[t], last[t] + 1)
        inside = np.minimum(section_end[touched], token_end[t]) - np.maximum(section_start[touched], token_start[t])
        if rule == "share":
            counts[touched] += inside / (token_end[t] - token_start[t])
        else:
            counts[touched[inside.argmax()]] += 1
    return counts, crossing


def _lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the sections of a text end, in characters and in bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    breaks = np.nonzero(data == 10)[0] + 1
    ends = np.append(breaks[breaks < len(data)], len(data))
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return characters[ends], ends


def sections(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", rule: str = "start") -> DataFrame:
    """key, section (from 0), start, end (characters), n_tokens, n_crossing (tokens that come in over its first boundary)."""
    if rule not in RULES:
        raise ValueError(f"no rule {rule}")
    rows = small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES):
            sizes, columns = [], [[] for _ in names]
            for t in piece.column("text").to_pylist():
                characters, ends = _lines(t or "")
                counts, crossing = allot(token_ends(t or "", path, pattern), ends, rule)
                sizes.append(len(ends))
                starts = np.concatenate([[0], characters[:-1]])
                for c, values in zip(columns, (np.arange(len(ends)), starts, characters, counts, crossing)):
                    c.append(values)
            keys = piece.column("key").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            kinds = [pa.int64()] * 3 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(np.concatenate(c), k) for c, k in zip(columns, kinds)]], names=["key", *names])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, section long, start long, end long, n_tokens double, n_crossing long").withColumnRenamed("key", key)


def fields(rows: DataFrame, columns: list[str], path: str, pattern: str, rule: str = "start") -> DataFrame:
    """All columns of ``rows`` with <column>_tokens of each of the text columns, encoded as one text joined by line breaks."""
    joined, bounds = "__joined", "__bounds"
    text = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    ready = small_batches(rows).withColumn(joined, F.concat_ws("\n", *text)).withColumn(bounds, F.array(*[F.octet_length(t).cast("long") for t in text]))
    added = [f"{c}_tokens" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, joined, PIECE_BYTES):
            counts = []
            for t, sizes in zip(piece.column(joined).to_pylist(), piece.column(bounds).to_pylist()):
                ends = np.cumsum(np.array(sizes) + 1)
                ends[-1] -= 1
                counts.append(allot(token_ends(t, path, pattern), ends, rule)[0])
            table = np.array(counts).reshape(-1, len(columns))
            kept = [piece.column(n) for n in piece.schema.names if n not in (joined, bounds, *added)]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(table[:, i]) for i in range(len(columns))]], names=names)

    kept = rows.drop(*added)
    names = [*kept.columns, *added]
    schema = kept.schema
    for name in added:
        schema = schema.add(name, "double")
    return ready.mapInArrow(run, schema)


def counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Sections of every document with their tokens, as whole numbers (rule ``start``)."""
    found = sections(docs, path, pattern)
    return found.withColumn("n_tokens", F.col("n_tokens").cast("long"))
