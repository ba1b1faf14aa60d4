"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the longest
phrases that occur somewhere in the labelled text; the fewer phrases it takes, the nearer the language. Phrase
counts are normalised as in the cross-entropy estimate of Ziv and Merhav: phrases x log2(size of the labelled
text) / characters.

Texts are lower-cased; a run of characters that aren't letters is one separator. Phrases don't cross blocks of
``BLOCK`` characters, so that a text of any length is many short parses, and all blocks of all texts
of a piece walk through the automata in step, one NumPy look-up a character.

The fit reads a bounded sample: at most ``docs_per_language`` texts of each language and ``chars_per_doc`` normalised
characters of each; which ones depends on a hash of id and text only. Everything else reads whole texts.
Every letter of the sample has a class. The model is a table of at most 2 x docs_per_language x chars_per_doc states by
``letters`` + 2 classes for each language, for the most frequent letters, and a sorted list of the transitions by all other
letters, of which there are at most 3 x docs_per_language x chars_per_doc. It is broadcast.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if there is no labelled row.
Ties go to the language first in code-point order. Null ids, repeated rows and empty tables need no care.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnwave.llm import util
from vulnwave.llm.util import slices, small_batches

UNKNOWN = "und"
BLOCK = 512
PIECE_BYTES = 2_000_000
SEPARATOR, RARE = 0, 1


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normalise(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of others than letters is one 0, none at the start."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, 0)[keep]


class SuffixAutomaton:
    """All substrings of a sequence, one transition a symbol."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            new = self._state({}, self.length[last] + 1, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[new] = q
                else:
                    copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1


@dataclass(frozen=True)
class Model:
    languages: list[str]
    points: np.ndarray  # sorted code points of the letters
    codes: np.ndarray  # class of each
    width: int  # classes that the table has
    roots: np.ndarray  # row offset of the state in which each language begins
    moves: np.ndarray  # row offset + class -> 2 x next row offset + (1 if a new phrase began)
    zeros: np.ndarray  # row offset of each automaton's first state
    keys: np.ndarray  # sorted: row offset x (number of classes) + class, of transitions by classes that the table hasn't
    targets: np.ndarray  # next row offset of each
    bits: np.ndarray  # log2 of the size of each language's text

    def classes(self, points: np.ndarray) -> np.ndarray:
        """0: separator, 1: a letter without a class, else its class."""
        if not len(self.points):
            return np.where(points == 0, SEPARATOR, RARE)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(points == 0, SEPARATOR, np.where(self.points[at] == points, self.codes[at], RARE))

    def _listed(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Next row offset by the list of transitions, -1 if there is none."""
        keys = state.astype(np.int64) * (len(self.points) + 2) + symbols
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.targets[at], -1)

    def _move(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """As ``moves``, for all classes."""
        other = np.nonzero(symbols >= self.width)[0]
        if not len(other):
            return self.moves[state + symbols]
        move = self.moves[state + np.where(symbols < self.width, symbols, RARE)]
        found = self._listed(state[:, other], symbols[other])
        begin = self._listed(self.zeros[:, None], symbols[other])
        move[:, other] = np.where(found >= 0, 2 * found, 2 * np.where(begin >= 0, begin, self.roots[:, None]) + 1)
        return move

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each normalised text by each language."""
        counts = np.zeros((len(self.languages), len(texts)), np.int64)
        if not texts or not len(self.languages):
            return counts
        sizes = np.array([len(t) for t in texts])
        n_blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        if not len(owner):
            return counts
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        first = np.repeat(np.cumsum(sizes) - sizes, n_blocks) + nth * BLOCK
        length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, first, length = owner[order], first[order], length[order]
        symbols = self.classes(np.concatenate(texts))
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        found = np.zeros(state.shape, np.int64)
        running = np.searchsorted(-length, -np.arange(length[0]), side="left")  # blocks longer than t
        for t, n in enumerate(running):
            move = self._move(state[:, :n], symbols[first[:n] + t])
            found[:, :n] += move & 1
            state[:, :n] = move >> 1
        for k in range(len(self.languages)):
            counts[k] = np.bincount(owner, found[k], len(texts))
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (1 - its normalised phrases / the runner-up's) and characters a phrase of each text."""
        ready = [normalise(t or "") for t in texts]
        sizes = np.array([len(t) for t in ready], np.int64)
        if not len(self.languages) or not len(texts):
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        counts = self.phrases(ready)
        rate = counts * self.bits[:, None] / np.maximum(sizes, 1)
        best = rate.argmin(0)
        low = np.sort(rate, axis=0)
        score = 1 - low[0] / np.where(low[1] > 0, low[1], 1) if len(low) > 1 else np.ones(len(texts))
        score = np.where(sizes > 0, np.clip(score, 0, 1), 0.0)
        mean = sizes / np.maximum(counts[best, np.arange(len(texts))], 1)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, sizes)]
        return names, score.tolist(), mean.tolist()


def build(texts: dict[str, list[np.ndarray]], letters: int = 126) -> Model:
    """Model of normalised labelled texts by language; the ``letters`` most frequent letters are in its table, all others in its list."""
    seen: Counter[int] = Counter()
    for parts in texts.values():
        for part in parts:
            seen.update(part[part > 0].tolist())
    ranked = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
    chosen = sorted(ranked[:letters]) + ranked[letters:]
    order = np.argsort(np.array(chosen, np.uint32))
    languages = sorted(k for k, parts in texts.items() if any(len(p) for p in parts))
    empty = np.zeros(0, np.int64)
    width = min(len(chosen), letters) + 2
    model = Model(languages, np.array(chosen, np.uint32)[order], order + 2, width, empty, empty, empty, empty, empty, empty)
    roots, zeros, tables, bits, base = [], [], [], [], 0
    keys, targets = [], []
    for language in languages:
        symbols = np.concatenate([np.append(p, 0) for p in texts[language] if len(p)])
        codes = model.classes(symbols)
        automaton = SuffixAutomaton(codes.tolist())
        n = len(automaton.next)
        table = np.full((n + 1, width), -1, np.int64)
        for state, moves in enumerate(automaton.next):
            for symbol, target in moves.items():
                if symbol < width:
                    table[state, symbol] = target
                else:
                    keys.append((state * width + base) * (len(chosen) + 2) + symbol)
                    targets.append(target * width + base)
        # state n stands where no phrase is open: every symbol begins one, and one without a match is a phrase by itself
        begin = np.where(table[0] >= 0, table[0], n)
        missing = table < 0
        rows = np.where(missing, begin[None, :], table) * width + base
        tables.append((rows * 2 + missing).ravel())
        roots.append(n * width + base)
        zeros.append(base)
        bits.append(np.log2(len(symbols) + 1))
        base += (n + 1) * width
    kind = np.int32 if base < 2**30 else np.int64
    moves = np.concatenate(tables).astype(kind) if tables else empty
    keys, targets = np.array(keys, np.int64), np.array(targets, np.int64)
    order = np.argsort(keys)
    return Model(languages, model.points, model.codes, width, np.array(roots, kind), moves, np.array(zeros, kind), keys[order], targets[order], np.array(bits))


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    docs_per_language: int = 32,
    chars_per_doc: int = 512,
) -> Model:
    """Model from a bounded sample of the rows with a text and a language (see above)."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).cast("string").alias("key"))
    rows = rows.where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    counts = rows.groupBy("lang").count()
    draw = F.xxhash64("key", "text")
    share = (draw.bitwiseAND(F.lit(2**52 - 1))) / F.lit(float(2**52))
    few = rows.withColumn("draw", draw).withColumn("share", share)
    few = few.join(F.broadcast(counts), "lang").where(F.col("share") * F.col("count") < 4.0 * docs_per_language)
    ranked = Window.partitionBy("lang").orderBy("draw", "key", "text")
    few = few.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= docs_per_language)
    texts: dict[str, list[np.ndarray]] = {}
    for r in few.select("lang", "nth", F.substring("text", 1, 4 * chars_per_doc).alias("text")).orderBy("lang", "nth").collect():
        texts.setdefault(r["lang"], []).append(normalise(r["text"])[:chars_per_doc])
    return build(texts)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (0 to 1) and phrase_chars (replaced if they are there already)."""
    kept = small_batches(docs).drop("lang_pred", "score", "phrase_chars")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrase_chars", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        util.kept("langid")
        for piece in slices(batches, text, PIECE_BYTES):
            names, scores, means = shared.value.predict(piece.column(text).to_pylist())
            new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(means, pa.float64())]
            yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=[*piece.schema.names, "lang_pred", "score", "phrase_chars"])

    return kept.mapInArrow(run, T.StructType(kept.schema.fields + added))


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 0 modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the labelled rows that aren't held out."""
    model = fit(docs.where(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
