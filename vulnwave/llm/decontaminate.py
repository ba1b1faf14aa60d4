"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A window is ``window`` consecutive
words of an item; an item of fewer words is one window as a whole. A word of a document is hit if it lies in an occurrence of
any window.

The automaton holds all substrings of all items of a part. Documents stream through it word by word: the state is the longest
suffix of what was read that occurs in some item, its length the matching length. Where that length reaches the window,
the last ``window`` words are one, and the state tells which; shorter items are found on the chain of suffix links. Words that no item
has, and pairs of words that no item has, end a match before the automaton is asked.

Items are cut into pieces of ``PIECE_WORDS`` words that overlap by a window less one, and pieces are dealt by hash into parts of at most
``part_words`` words (checked). A part is one automaton, held by every worker while the documents pass; more parts are more
passes, each of which adds to what the others found. Nothing else of the items comes to the driver.

Null and empty texts have no words; items without a word have no window. Null item ids are never listed, their windows count all
the same. Rows that repeat an id count as one item with all their texts. Every row of the documents gives one row, repeated ones too.
Without items nothing is hit. Other columns of the items are ignored; those of the documents are returned, but for the ones added here.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnwave.llm import util
from vulnwave.llm.util import slices, small_batches
from vulnwave.session import stored

WINDOW = 10
# Words of all items of one automaton, and of a piece of an item.
PART_WORDS = 200_000
PIECE_WORDS = 5_000
PIECE_BYTES = 2_000_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Bytes outside of words become blanks, A-Z lower-case.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


@dataclass
class Automaton:
    """Moves by (state, word), and per state what a match of a given length contains."""

    vocabulary: dict[bytes, int]
    pairs: np.ndarray  # sorted: first word * number of words + second
    moves: dict[int, int]  # state * number of words + word -> state
    link: list[int]
    length: list[int]
    window: list[int]  # the window that ends a match of its length or more, -1: none
    shorts: list[tuple[tuple[int, int], ...]]  # (length, window) of the short items on the chain of links
    items: list[tuple[int, ...]]  # per window: positions in ids
    ids: list[str]
    shortest: int
    size: int  # words of a window

    @classmethod
    def build(cls, pieces: Iterable[tuple[str | None, bytes, bool]], size: int = WINDOW) -> Automaton:
        """pieces: (item id, words joined by blanks, whether they are a whole short item)."""
        texts: dict[bytes, tuple[bool, set[str]]] = {}
        for item, text, short in pieces:
            texts.setdefault(text, (short, set()))[1].update(() if item is None else (item,))
        ids = sorted({i for _, of in texts.values() for i in of})
        place = {i: n for n, i in enumerate(ids)}
        vocabulary: dict[bytes, int] = {}
        coded = []
        for text in sorted(texts):
            short, of = texts[text]
            coded.append(([vocabulary.setdefault(w, len(vocabulary)) for w in text.split()], short, sorted(place[i] for i in of)))
        n = max(1, len(vocabulary))
        link, length, moves = [-1], [0], {}
        out: list[list[int]] = [[]]  # words that leave a state, for copies
        for code, _, _ in coded:
            last = 0
            for w in code:
                last = cls._extend(last, w, n, link, length, moves, out)
        self = cls(vocabulary, np.zeros(0, np.int64), moves, link, length, [], [], [], ids, size, size)
        known: set[int] = set()
        for code, _, _ in coded:
            known.update(a * n + b for a, b in zip(code, code[1:]))
        self.pairs = np.array(sorted(known), np.int64)
        self._mark(coded)
        return self

    @staticmethod
    def _extend(last: int, w: int, n: int, link: list[int], length: list[int], moves: dict[int, int], out: list[list[int]]) -> int:
        def copy(p: int, q: int) -> int:
            """The part of ``q`` that is one word longer than ``p``, as a state of its own."""
            new = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            out.append(list(out[q]))
            for x in out[q]:
                moves[new * n + x] = moves[q * n + x]
            link[q] = new
            while p >= 0 and moves.get(p * n + w) == q:
                moves[p * n + w] = new
                p = link[p]
            return new

        there = moves.get(last * n + w)
        if there is not None:  # another item has this prefix
            return there if length[there] == length[last] + 1 else copy(last, there)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        out.append([])
        p = last
        while p >= 0 and p * n + w not in moves:
            moves[p * n + w] = new
            out[p].append(w)
            p = link[p]
        if p >= 0:
            q = moves[p * n + w]
            link[new] = q if length[q] == length[p] + 1 else copy(p, q)
        return new

    def _mark(self, coded: list[tuple[list[int], bool, list[int]]]) -> None:
        """Windows get numbers, and states what ends in them."""
        n = max(1, len(self.vocabulary))
        of: list[set[int]] = []
        number: dict[int, int] = {}  # state of a window's own length class -> window
        short_at: dict[tuple[int, int], int] = {}  # (state, words) -> window
        for code, short, items in coded:
            if short:
                state = 0
                for w in code:
                    state = self.moves[state * n + w]
                k = len(of)
                short_at[(state, len(code))] = k
                of.append(set(items))
                self.shortest = min(self.shortest, len(code))
                continue
            state = matched = 0
            for w in code:
                state, matched = self._step(state, matched, w, n)
                if matched >= self.size:
                    at = state
                    while self.length[self.link[at]] >= self.size:
                        at = self.link[at]
                    k = number.setdefault(at, len(of))
                    if k == len(of):
                        of.append(set())
                    of[k].update(items)
        by_state: dict[int, list[tuple[int, int]]] = {}
        for (state, m), k in short_at.items():
            by_state.setdefault(state, []).append((m, k))
        count = len(self.length)
        self.window, self.shorts = [-1] * count, [()] * count
        for state in sorted(range(1, count), key=self.length.__getitem__):
            up = self.link[state]
            own = number.get(state, -1)
            self.window[state] = own if own >= 0 else self.window[up]
            mine = tuple(sorted(by_state.get(state, ())))
            self.shorts[state] = self.shorts[up] + mine if mine else self.shorts[up]
        self.items = [tuple(sorted(s)) for s in of]

    def _step(self, state: int, matched: int, w: int, n: int) -> tuple[int, int]:
        moves = self.moves
        to = moves.get(state * n + w)
        while to is None:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
            to = moves.get(state * n + w)
        return to, matched + 1

    def find(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs of hit words (start, end), and the windows that occur."""
        if not self.ids and not self.items or len(text_words) < self.shortest:
            return [], set()
        n = max(1, len(self.vocabulary))
        get = self.vocabulary.get
        code = np.fromiter((get(w, -1) for w in text_words), np.int64, len(text_words))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for start, end in self._runs(code, n):
            state = matched = 0
            for i, w in enumerate(code[start:end].tolist(), start):
                state, matched = self._step(state, matched, w, n)
                longest = 0
                if matched >= self.size:
                    found.add(self.window[state])
                    longest = self.size
                if self.shorts[state]:
                    for m, k in self.shorts[state]:
                        if m <= matched:
                            found.add(k)
                            longest = max(longest, m)
                if longest:
                    a, b = i + 1 - longest, i + 1
                    while spans and spans[-1][1] >= a:  # runs that touch are one
                        a = min(a, spans.pop()[0])
                    spans.append((a, b))
        return spans, found

    def _runs(self, code: np.ndarray, n: int) -> list[tuple[int, int]]:
        """Stretches of known words in known pairs, as long as the shortest window at least."""
        known = code >= 0
        if self.shortest == 1:
            joined = known[1:] & known[:-1]
        else:
            pair = code[:-1] * n + code[1:]
            at = np.searchsorted(self.pairs, pair)
            at[at == len(self.pairs)] = 0
            joined = known[1:] & known[:-1] & (self.pairs[at] == pair) if len(self.pairs) else np.zeros(max(0, len(code) - 1), bool)
        breaks = np.nonzero(~joined)[0] + 1
        starts = np.concatenate([[0], breaks])
        ends = np.concatenate([breaks, [len(code)]])
        good = (ends - starts >= self.shortest) & known[starts]
        return list(zip(starts[good].tolist(), ends[good].tolist()))


def pieces_of(item: str | None, text: str | None, size: int = WINDOW, piece: int = PIECE_WORDS) -> Iterator[tuple[str | None, bytes, bool]]:
    """The words of an item in overlapping pieces: every window is whole in one of them."""
    all_ = words(text)
    if 0 < len(all_) < size:
        yield item, b" ".join(all_), True
        return
    step = max(1, piece - size + 1)
    for k in range(0, len(all_) - size + 1, step):
        yield item, b" ".join(all_[k : k + step + size - 1]), False


def parts(items: DataFrame, item: str, text: str, window: int, part_words: int) -> tuple[DataFrame, int]:
    """(item, words, short, part) of all pieces, stored, and the number of parts. No part holds more words than ``part_words``."""
    rows = small_batches(items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")))
    piece = min(PIECE_WORDS, max(window, part_words // 8))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        util.kept("decontaminate")
        for batch in batches:
            for i, t in zip(batch.column("item").to_pylist(), batch.column("text")):
                held: list[tuple[str | None, bytes, bool]] = []
                for p in pieces_of(i, t.as_py(), window, piece):
                    held.append(p)
                    if len(held) == 100:
                        yield _pieces(held)
                        held = []
                if held:
                    yield _pieces(held)

    cut_up = rows.mapInArrow(cut, "item string, words binary, n long, short boolean").dropDuplicates(["item", "words"])
    whole = stored(cut_up, "items")
    total = whole.agg(F.sum("n").alias("n")).first()["n"] or 0
    n = max(1, -(-total // part_words)) if total else 0
    while n > 1:
        sizes = whole.groupBy(_part(n).alias("part")).agg(F.sum("n").alias("n"))
        if sizes.agg(F.max("n").alias("n")).first()["n"] <= part_words:
            break
        n += -(-n // 4)
    return whole.withColumn("part", _part(n) if n > 1 else F.lit(0).cast("long")), n


def _part(n: int):
    return F.pmod(F.xxhash64("item", "words"), F.lit(n)).cast("long")


def _pieces(held: list[tuple[str | None, bytes, bool]]) -> pa.RecordBatch:
    # a row costs a word more, so that a text with many ids counts
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h[0] for h in held], pa.string()), pa.array([h[1] for h in held], pa.binary()),
            pa.array([h[1].count(b" ") + 2 for h in held], pa.int64()), pa.array([h[2] for h in held], pa.bool_()),
        ],
        names=["item", "words", "n", "short"],
    )


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ADDED = ["n_words", "hit_spans", "items"]


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """All columns of ``docs`` with n_words, hit_spans (maximal runs of hit words: first word, end exclusive) and items (ids, sorted
    as strings, of the items with a window in the text)."""
    base = small_batches(docs.drop(*ADDED))
    none = F.array().cast(T.ArrayType(_SPAN)).alias("hit_spans")
    rows = base.select("*", F.lit(0).cast("long").alias("n_words"), none, F.array().cast("array<string>").alias("items"))
    pieces, count = parts(benchmark, item, item_text, window, part_words)
    for part in range(max(1, count)):
        held = [(r["item"], bytes(r["words"]), r["short"]) for r in pieces.where(F.col("part") == part).collect()] if count else []
        if part:  # each pass has one automaton in its workers
            rows = small_batches(stored(rows, "decontaminated"))
        rows = _pass(rows, Automaton.build(held, window), text)
    return rows


def _pass(rows: DataFrame, automaton: Automaton, text: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        util.kept("decontaminate")
        model = shared.value
        for piece in slices(batches, text, PIECE_BYTES):
            n_words, spans, items = [], [], []
            for t, before, named in zip(piece.column(text), piece.column("hit_spans"), piece.column("items")):
                found = words(t.as_py())
                runs, windows = model.find(found)
                old, ids = before.as_py(), named.as_py()
                if windows:
                    runs = _merged([*runs, *((s["start"], s["end"]) for s in old)]) if old else runs
                    ids = sorted({*ids, *(model.ids[i] for k in windows for i in model.items[k])})
                    old = [{"start": a, "end": b} for a, b in runs]
                n_words.append(len(found))
                spans.append(old)
                items.append(ids)
            new = [pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
            kept = [n for n in piece.schema.names if n not in ADDED]
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in kept), *new], names=[*kept, *ADDED])

    return rows.mapInArrow(run, rows.schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its words start to end, and without what stands between words of one span."""
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, data[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", longest: int = 0, coverage: float = 0.5, **options) -> DataFrame:
    """The columns of ``docs`` without what belongs to the benchmark.

    Runs of hit words longer than ``longest`` words are cut out of the text. A document of which more than the share ``coverage`` of its
    words is hit goes as a whole. ``options``: those of ``matches``.
    """
    found = matches(docs, benchmark, text, **options)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    found = small_batches(found.where(hit <= F.lit(coverage) * F.col("n_words")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for t, spans in zip(batch.column(text), batch.column("hit_spans").to_pylist()):
                runs = [(s["start"], s["end"]) for s in spans if s["end"] - s["start"] > longest]
                new.append(without_spans(t.as_py(), runs) if runs else t.as_py())
            columns = [pa.array(new, pa.string()) if n == text else batch.column(n) for n in batch.schema.names if n not in ADDED]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n not in ADDED])

    kept = [f for f in found.schema.fields if f.name not in ADDED]
    return found.mapInArrow(cut, T.StructType(kept)).select(*[f"`{c}`" for c in docs.columns if c not in ADDED])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = matches(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

