"""Byte-level BPE by corpus-level merge replay.

Every task takes its share of the corpus in pieces of a few million characters. The distinct words of a
piece are laid out side by side as linked lists of byte tokens, and an inverted index leads from a merge to the
positions of the token pairs it joins. Merges are applied in rank order over all words at once; a merge looks
at the positions in its list and re-indexes the two neighbours of each, nothing else. No shuffle: texts
never leave their task, and ranks are the only state sent to it.

Nulls and empty texts have no tokens and decode to no bytes. Texts of any length are read through a
bounded window of words. Repeated rows and null ids give a row each.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnwave.llm.util import kept, slices, small_batches

PIECE_BYTES = 4_000_000
# Words kept encoded in a worker between pieces; the table is emptied when it holds more.
KEPT_WORDS = 400_000
# Words of one text held at a time.
WINDOW_WORDS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes batches of words by replaying the merges over all of them in rank order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.joined: dict[int, int] = {}

    def _join(self, left: int, right: int) -> int:
        """Token made of two adjacent tokens, or -1."""
        key = left << 32 | right
        found = self.joined.get(key)
        if found is None:
            found = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
            self.joined[key] = found
        return found

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word. A word that is a token itself is that token."""
        if len(self.joined) > 300_000:
            self.joined.clear()
        out: list[list[int] | None] = []
        token: list[int] = []
        spans: list[tuple[int, int, int]] = []
        for k, word in enumerate(words):
            whole = self.ranks.get(word)
            out.append(None if whole is None else [whole])
            if whole is None:
                spans.append((k, len(token), len(token) + len(word)))
                token.extend(map(self.of_byte.__getitem__, word))
        n = len(token)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        word_of = [0] * n
        index: dict[int, list[int]] = {}
        seen, join = self.joined.get, self._join
        for k, start, end in spans:
            if start == end:
                continue
            after[end - 1] = before[start] = -1
            word_of[start:end] = [k] * (end - start)
            left = token[start]
            for i in range(start, end - 1):
                right = token[i + 1]
                merge = seen(left << 32 | right)
                if merge is None:
                    merge = join(left, right)
                if merge >= 0:
                    if merge in index:
                        index[merge].append(i)
                    else:
                        index[merge] = [i]
                left = right
        queue = list(index)
        heapify(queue)
        while queue:
            merge = heappop(queue)
            places = index.pop(merge)
            places.sort()
            kept, waiting = [], -1
            for i in places:
                j = after[i]
                left = token[i]
                if left < 0 or j < 0:
                    continue
                if word_of[i] == waiting:  # a lower merge came up in this word and goes first
                    kept.append(i)
                    continue
                if seen(left << 32 | token[j]) != merge:
                    continue  # a neighbour has changed since this was indexed
                token[i], token[j] = merge, -1
                right, left = after[j], before[i]
                after[i] = right
                if left >= 0:
                    key = token[left] << 32 | merge
                    new = seen(key)
                    if new is None:
                        new = join(token[left], merge)
                    if new >= 0:
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            heappush(queue, new)
                        if new < merge:
                            waiting = word_of[i]
                if right >= 0:
                    before[right] = i
                    new = seen(merge << 32 | token[right])
                    if new is None:
                        new = join(merge, token[right])
                    if new >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heappush(queue, new)
                        if new < merge:
                            waiting = word_of[i]
            if kept:
                if merge in index:
                    index[merge] += kept
                else:
                    index[merge] = kept
                    heappush(queue, merge)
        for k, start, end in spans:
            out[k] = [t for t in token[start:end] if t >= 0]
        return out  # type: ignore[return-value]


def _ready(path: str, pattern: str) -> tuple[MergeReplay, regex.Pattern, dict[str, bytes]]:
    """Ranks, pattern and known words of this worker."""
    store = kept("bpe")
    if (path, pattern) not in store:
        store.clear()
        store[path, pattern] = MergeReplay(load_ranks(path)), regex.compile(pattern), {}
    return store[path, pattern]


def _encoded(texts: list[str | None], replay: MergeReplay, pattern: regex.Pattern, known: dict) -> tuple[np.ndarray, list[int]]:
    """All ids of the texts one after the other, and where each text ends."""
    parts: list[np.ndarray] = []
    ends: list[int] = []
    total = 0
    window: list[list[str]] = []
    at: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal total, held
        fresh = set().union(*window).difference(known)
        if len(known) + len(fresh) > KEPT_WORDS:
            known.clear()
            fresh = set().union(*window)
        new = list(fresh)
        known.update(zip(new, (array("i", ids).tobytes() for ids in replay.encode([w.encode() for w in new]))))
        for k, words in zip(at, window):
            ids = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32)
            parts.append(ids)
            total += len(ids)
            ends[k] = total
        window.clear()
        at.clear()
        held = 0

    for k, text in enumerate(texts):
        ends.append(0)
        found = (m.group() for m in pattern.finditer(text)) if text and len(text) > PIECE_BYTES else iter(pattern.findall(text or ""))
        while True:
            words = list(islice(found, WINDOW_WORDS))
            window.append(words)
            at.append(k)
            held += len(words)
            if held >= WINDOW_WORDS:
                flush()
            if len(words) < WINDOW_WORDS:
                break
    flush()
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), ends


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns of ``docs`` with the token ids of ``text`` in ``ids`` and, if a name is given, the bytes that these ids decode to
    in ``decoded`` (columns of these names are replaced).

    ``path``: a rank file (base64 token and rank a line) that every executor has.
    """
    rows = small_batches(docs).drop(ids, *([decoded] if decoded else []))
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, compiled, known = _ready(path, pattern)
        for piece in slices(batches, text, PIECE_BYTES):
            flat, ends = _encoded(piece.column(text).to_pylist(), replay, compiled, known)
            lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat))
            new = [lists, _decoded(lists, replay.tokens)] if decoded else [lists]
            yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=[*piece.schema.names, *[f.name for f in added]])

    return rows.mapInArrow(run, T.StructType(rows.schema.fields + added))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns with the bytes of the tokens in ``out`` (replaced if it is there already); null ids: none."""
    rows = small_batches(encoded).drop(out)
    schema = T.StructType(rows.schema.fields + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in load_ranks(path).items()}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column(ids), tokens)], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def _decoded(lists: pa.ListArray, tokens: dict[int, bytes]) -> pa.Array:
    """The bytes of each list of ids."""
    return pa.array([b"".join(map(tokens.__getitem__, row)) for row in _rows(lists)], pa.binary())


def _rows(lists: pa.ListArray) -> Iterator[list[int]]:
    """The lists one at a time, so that the ids of a batch aren't all Python objects at once."""
    for k in range(len(lists)):
        values = lists[k].values
        yield values.to_numpy(zero_copy_only=False).tolist() if values is not None else []


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = encode(rows, path, pattern, decoded="decoded").drop("text")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
