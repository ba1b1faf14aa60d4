"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found over a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart have reduced words that are equal or one edit apart, so the full one-edit
neighbourhood of every distinct reduced word (all deletions, replacements and insertions of symbols) is generated and joined with the reduced
words that occur; the words behind each pair of reduced words are then compared as they are. Of two neighbours only the one with the smaller key
generates the other, and reduced words are carried as 64-bit polynomial values, in which an edit is a few additions; equal values of different
reduced words add comparisons and lose nothing.

The number of symbols grows slowly with the vocabulary (``symbols_for``), so that few words share a reduced word. Where more than ``HOT`` do, they
and all words next to them are taken again with four times as many symbols, and at last with one symbol for each letter, where a reduced word
is one word: no list of words is longer than ``HOT``, and no pair is lost.

Words are maximal runs of ``[A-Za-z]`` and U+00C0 to U+00FF, A-Z lower-cased. If 31 divides the CRC-32 of ``<doc_id>:<run>``, the run loses the
code point at that CRC modulo its length. What has ``LEAST`` code points and occurs twice in the corpus is a word of the vocabulary.

The form of a word is its near word of the largest count (of several the first in code-point order), if that count is ten times its own at least; its
root is what following forms leads to. Counts grow at least tenfold from form to form, so paths are short, and each round doubles what it jumps.

Null texts have no words; a null id is written as an empty one. Repeated rows count as often as they stand there. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnwave.llm import util
from vulnwave.llm.util import small_batches
from vulnwave.session import cut_lineage, stored

LEAST = 7
OCCURRENCES = 2
DAMAGE = 31
STRONGER = 10
# Words of one reduced word that are compared with those of another.
HOT = 200
# One symbol a letter: a-z and U+00C0 to U+00FF.
LETTERS = 26 + 64
# Words a task counts before it sends them on.
COUNTED = 200_000
BASE = 0x9E3779B97F4A7C15
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST},}}")


def symbols_for(words: int) -> int:
    """Symbols for a vocabulary: its eighth root, four at least."""
    return min(LETTERS, max(4, round(words ** (1 / 8))))


def runs(text: str | None) -> list[str]:
    """Runs of ``LEAST`` letters at least, A-Z lower-cased; shorter ones never become words."""
    return _RUN.findall((text or "").encode().lower().decode())


def damage(doc_id: str, run: str) -> str:
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of the words that occur ``OCCURRENCES`` times at least."""
    rows = small_batches(docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        util.kept("spelling")
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, t in zip(batch.column("id").to_pylist(), batch.column("text")):
                for run, n in Counter(runs(t.as_py())).items():
                    word = damage(doc, run)
                    if len(word) >= LEAST:
                        held[word] += n
                if len(held) > COUNTED:
                    yield flush()
        yield flush()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def reduced(points: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols 1 to ``symbols`` of the letters."""
    letter = np.where(points < 0x80, points - 97, points - 0xC0 + 26).astype(np.uint64)
    if symbols >= LETTERS:
        return letter + np.uint64(1)
    mixed = (letter + np.uint64(1)) * np.uint64(BASE)
    return (mixed >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)


def values(of: np.ndarray) -> np.ndarray:
    """Polynomial value of each row."""
    return (of * _powers(of.shape[1] - 1)[::-1]).sum(1, dtype=np.uint64)


def neighbours(of: np.ndarray, symbols: int) -> np.ndarray:
    """Values of all reduced words one edit away from each row, with repeats."""
    n, length = of.shape
    power = _powers(length + 1)
    front = np.zeros((n, length + 1), np.uint64)  # value of the first i symbols
    for i in range(length):
        front[:, i + 1] = front[:, i] * np.uint64(BASE) + of[:, i]
    terms = of * power[:length][::-1]
    back = np.concatenate([np.cumsum(terms[:, ::-1], 1, dtype=np.uint64)[:, ::-1], np.zeros((n, 1), np.uint64)], 1)  # of symbols i on
    each = np.arange(1, symbols + 1, dtype=np.uint64)
    at = power[:length][::-1]  # weight of position i
    deleted = front[:, :length] * at + back[:, 1:]
    replaced = front[:, -1][:, None, None] + (each - of[:, :, None]) * at[None, :, None]
    gap = power[: length + 1][::-1]  # weight of what is put in before position i
    put_in = (front * gap * np.uint64(BASE) + back)[:, :, None] + each * gap[None, :, None]
    return np.concatenate([deleted, replaced.reshape(n, -1), put_in.reshape(n, -1)], 1)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        places = np.nonzero(lengths == length)[0]
        yield places, [words[i] for i in places]


def _keyed(words: DataFrame, symbols: int) -> DataFrame:
    """``words`` with the value of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column("word").to_pylist()
            out = np.zeros(len(named), np.uint64)
            for places, same in _by_length(named):
                out[places] = values(reduced(_points(same), symbols))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=[*batch.schema.names, "r"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, r long")


def _neighbourhoods(samples: DataFrame, symbols: int) -> DataFrame:
    """(r, key): the larger neighbours of each reduced word. samples: r, word (any one of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("r").to_numpy().astype(np.int64)
            for places, same in _by_length(batch.column("word").to_pylist()):
                step = max(1, 500_000 // (3 * len(same[0]) * symbols))
                for k in range(0, len(same), step):
                    r = own[places[k : k + step]]
                    near = np.sort(neighbours(reduced(_points(same[k : k + step]), symbols), symbols).view(np.int64), 1)
                    good = near > r[:, None]
                    good[:, 1:] &= near[:, 1:] != near[:, :-1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r, good.sum(1))), pa.array(near[good])], names=["r", "key"])

    return samples.select("r", "word").mapInArrow(run, "r long, key long")


def _compared(lists: DataFrame) -> DataFrame:
    """(a, an, b, bn): pairs one edit apart of a word of ``left`` and one of ``right``."""
    pairs = lists.select(F.explode("left").alias("x"), "right").select("x", F.explode("right").alias("y"))
    pairs = pairs.select(F.col("x.word").alias("a"), F.col("x.n").alias("an"), F.col("y.word").alias("b"), F.col("y.n").alias("bn"))
    # one edit leaves the first or the last three letters as they are
    half = (F.substring("a", 1, 3) == F.substring("b", 1, 3)) | (F.substring("a", -3, 3) == F.substring("b", -3, 3))
    return pairs.where(half & (F.levenshtein("a", "b", 1) == 1))


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, an, b, bn): each pair of near words with their counts, once or more. words: word, n, distinct, stored."""
    found = None
    symbols = symbols_for(words.count())
    while True:
        keyed = stored(_keyed(words, symbols), "reduced")
        sizes = stored(keyed.groupBy("r").agg(F.count("*").alias("of"), F.min("word").alias("word")), "sizes")
        edges = _neighbourhoods(sizes, symbols)
        large = sizes.where(F.col("of") > hot).select("r") if symbols < LETTERS else None
        large = None if large is None or large.isEmpty() else large
        few = keyed if large is None else keyed.join(large, "r", "left_anti")
        lists = few.groupBy("r").agg(F.collect_list(F.struct("word", "n")).alias("left"))
        there = lists.select(F.col("r").alias("key"), F.col("left").alias("right"))
        apart = _compared(edges.join(there, "key").join(lists, "r").select("left", "right"))
        inside = _compared(lists.where(F.size("left") > 1).select("left", F.col("left").alias("right"))).where("a < b")
        both = apart.unionByName(inside)
        found = both if found is None else found.unionByName(both)
        if large is None:
            return found
        pairs = edges.join(sizes.select(F.col("r").alias("key")), "key", "left_semi")
        beside = pairs.join(large.withColumnRenamed("r", "key"), "key").select("r").union(pairs.join(large, "r").select("key"))
        words = stored(keyed.join(beside.union(large).distinct(), "r", "left_semi").select("word", "n"), "again")
        symbols = min(LETTERS, symbols * 4)


def variants(words: DataFrame, hot: int = HOT, stronger: int = STRONGER) -> DataFrame:
    """word, n, n_near, form, form_n of every word. words: word, n."""
    words = stored(words, "vocabulary")
    pairs = near_pairs(words, hot)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("bn")))
    ends = pairs.select(F.explode(ends).alias("e")).select("e.word", "e.near", F.col("e.bn").alias("near_n"))
    ends = ends.repartition("word").dropDuplicates(["word", "near"])
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("m"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("m.near").alias("near"), (-F.col("m.order")).alias("near_n"))
    strong = F.col("near_n") >= stronger * F.col("n")
    return rows.select("word", "n", "n_near", F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n"))


def groups(words: DataFrame, hot: int = HOT, stronger: int = STRONGER) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary (word, n)."""
    found = stored(variants(words, hot, stronger), "variants")
    steps = cut_lineage(found.where("form is not null").select("word", F.col("form").alias("to")))
    while True:  # each round doubles the length of the steps
        onward = steps.join(steps.select(F.col("word").alias("to"), F.col("to").alias("further")), "to", "left")
        onward = cut_lineage(onward.select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        moved = not onward.where("moved").isEmpty()
        steps = onward.select("word", "to")
        if not moved:
            break
    rooted = found.join(steps, "word", "left")
    return rooted.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def corpus_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of the documents."""
    return groups(vocabulary(docs))
