"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else, in any document. Sorting the suffixes
at all bytes would move hundreds of times the corpus, so suffixes are sorted at anchors only, which every
repeated string must share:

1. *Anchors.* In each window of LENGTH - GRAM + 1 positions the one with the least hash of its next 8 bytes is an anchor (all, of equals).
   Which one it is depends on the bytes of the string alone, so that each occurrence of a string of LENGTH bytes has an
   anchor at the same place, followed by GRAM bytes at least. Anchors whose GRAM bytes occur once can't be in a
   repeated string. Of equal documents one is looked at; the others go like it.
2. *Sorted runs.* Each task sorts the suffixes at the remaining anchors (up to LENGTH bytes on), and the reversed prefixes before them
   (up to the window's width, each behind the hash of its GRAM bytes). It cuts the run at splitters drawn from a bounded sample,
   and sends the pieces front-coded: what a string shares with the one before it isn't sent.
3. *Merge.* The pieces of a range meet in a loser tree whose nodes know how far a loser agrees with the winner: the longer common
   prefix wins unseen, and a comparison starts behind the prefix known to be equal. Splitters are strings with their place, so that a string that
   occurs any number of times is spread over many ranges; what lies beyond a range matters by its common prefix with the splitter
   only, and each run sends those lengths along.
4. *Depths.* For each anchor, the lengths of common prefixes with all other suffixes are the minima of neighbours' common prefixes on the way to
   either side; they are kept as a stack while the range goes by. The furthest that a repeated string around the anchor
   reaches to the left starts where the prefix agrees no longer with some other, the furthest to the right ends where the suffix doesn't.
   So a few strings of LENGTH bytes an anchor are enough: those that start or end at such a depth.
5. *Check.* These strings are counted by 128-bit hash over the corpus; those that occur twice are removed wherever they are.

Hashes that very many places share (of a common passage, or of copies of a document) are joined apart, so that no task gets all of them.
Nothing is sampled but splitters, which are drawn by place and not by document. Null and empty texts have no bytes. Texts of any length are read whole; anchors of long ones are found in pieces
that overlap. Repeated rows are documents of their own and remove each other. Null ids are kept as they are. Columns other than
id and text aren't looked at.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnwave.llm.util import join_counts, slices, small_batches
from vulnwave.session import cut_lineage, stored

LENGTH = 400
GRAM = 128
PIECE_BYTES = 500_000
# Bytes of strings that a task sorts at once.
RUN_BYTES = 12_000_000
# Strings of a range, and most ranges there are.
RANGE = 10_000
RANGES = 20_000
SAMPLES_A_RANGE = 10
KEY_BYTES = 8

Item = tuple[bytes, int, int]  # string, document, place


# ---- anchors


def _slide(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over values[i : i + width] for each i at which that is whole: prefixes and suffixes of blocks of ``width``."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, fill, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Places of the anchors of the documents that lie one after the other in ``data`` and stop at ``ends``."""
    n, width = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64)
    v = np.zeros(n + 8, np.uint64)
    v[:n] = data
    for shift in (1, 2, 4):
        v[:-shift] |= v[shift:] << np.uint64(8 * shift)
    h = v[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)
    least = np.zeros(n + width - 1, np.uint64)
    own = least[width - 1 :]
    own[: n - width + 1] = _slide(h, width, np.minimum, 2**64 - 1)
    starts = np.concatenate([[0], ends[:-1]])
    # windows that would leave their document count for nothing
    for s, e in zip(np.maximum(starts, ends - length + 1).tolist(), ends.tolist()):
        own[s:e] = 0
    return np.nonzero(_slide(least, width, np.maximum, 0) == h)[0]


def _anchors_of(texts: list[bytes], length: int, gram: int) -> list[np.ndarray]:
    """Places of the anchors in each text."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        sizes = np.cumsum([len(texts[k]) for k in group])
        found = anchors(np.frombuffer(b"".join(texts[k] for k in group), np.uint8), sizes, length, gram)
        cuts = np.searchsorted(found, sizes)
        for k, first, part in zip(group, [0, *sizes[:-1].tolist()], np.split(found, cuts[:-1])):
            out[k] = part - first
        group.clear()
        held = 0

    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > PIECE_BYTES:
            parts = []
            for low in range(0, len(text), PIECE_BYTES):
                a, b = max(0, low - 2 * length), min(len(text), low + PIECE_BYTES + 2 * length)
                found = anchors(np.frombuffer(text, np.uint8)[a:b], np.array([b - a]), length, gram) + a
                parts.append(found[(found >= low) & (found < low + PIECE_BYTES)])
            out[k] = np.concatenate(parts)
            continue
        group.append(k)
        held += len(text)
        if held >= PIECE_BYTES:
            flush()
    if group:
        flush()
    return out


# ---- sorted runs


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes needn't be looked at."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 48], b[known : known + 48]
        if x != y:
            m = min(len(x), len(y))
            differ = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return known + m - (differ.bit_length() + 7) // 8
        known += 48
    return n


def front_code(items: list[Item], shared: list[int]) -> bytes:
    """Sorted items, each without the ``shared`` bytes it has in common with the one before."""
    kept = [s[n:] for (s, _, _), n in zip(items, shared)]
    n = len(items)
    parts = [
        np.int64(n).tobytes(),
        np.array(shared, "<u2").tobytes(),
        np.array([len(k) for k in kept], "<u2").tobytes(),
        np.array([i[1] for i in items], "<i8").tobytes(),
        np.array([i[2] for i in items], "<i8").tobytes(),
        *kept,
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def front_decode(blob: bytes) -> tuple[list[Item], list[int]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at = 8
    shared = np.frombuffer(raw, "<u2", n, at).tolist()
    sizes = np.frombuffer(raw, "<u2", n, at + 2 * n).tolist()
    docs = np.frombuffer(raw, "<i8", n, at + 4 * n).tolist()
    places = np.frombuffer(raw, "<i8", n, at + 12 * n).tolist()
    at += 20 * n
    items, last = [], b""
    for s, size, doc, place in zip(shared, sizes, docs, places):
        last = last[:s] + raw[at : at + size]
        at += size
        items.append((last, doc, place))
    return items, shared


def cut_run(items: list[Item], splitters: list[Item], floor: int) -> Iterator[tuple[int, bytes | None, list[int], list[int]]]:
    """Pieces of a sorted run by range: (range, front-coded piece, depths of the splitter below it among the run's strings before it,
    depths of the splitter above it among those from it on)."""
    shared = [0] + [common(a[0], b[0]) for a, b in zip(items, items[1:])]
    cuts = [bisect_left(items, s) for s in splitters]
    backward = shared[::-1]
    n = len(items)
    lower: list[set[int]] = [set()]
    upper: list[set[int]] = []
    for s, c in zip(splitters, cuts):
        # from the splitter down: its common prefix with items[c - 1], then shared[c - 1], shared[c - 2], ...
        lower.append(_minima_from(backward, n - c, common(s[0], items[c - 1][0]), floor) if c else set())
        upper.append(_minima_from(shared, c + 1, common(s[0], items[c][0]), floor) if c < n else set())
    upper.append(set())
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, n])):
        piece = front_code(items[a:b], [0, *shared[a + 1 : b]]) if a < b else None
        if piece is not None or lower[k] or upper[k]:
            yield k, piece, sorted(lower[k]), sorted(upper[k])


def _minima_from(lengths: list[int], start: int, first: int, floor: int) -> set[int]:
    out: set[int] = set()
    if first < floor:
        return out
    out.add(first)
    low = first
    for i in range(start, len(lengths)):
        n = lengths[i]
        if n < low:
            if n < floor:
                break
            low = n
            out.add(n)
    return out


# ---- merge


class LoserTree:
    """Merges sorted runs of items. ``shared`` of a run: common prefix of each item with the one before it."""

    def __init__(self, runs: list[tuple[list[Item], list[int]]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.at = [0] * len(runs)
        # a player: (run, common prefix of its head with the last string that left the tree), None: used up
        self.nodes: list[tuple[int, int] | None] = [None] * self.size
        self.top = self._build(1)

    def _build(self, node: int) -> tuple[int, int] | None:
        if node >= self.size:
            run = node - self.size
            return (run, 0) if run < len(self.runs) and self.runs[run][0] else None
        winner, loser = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.nodes[node] = loser
        return winner

    def _play(self, a: tuple[int, int] | None, b: tuple[int, int] | None):
        """Winner, and loser with its common prefix with the winner."""
        if a is None or b is None:
            return (a, b) if b is None else (b, a)
        if a[1] != b[1]:  # the one that agrees longer with what went before is smaller, and known to be
            return (a, b) if a[1] > b[1] else (b, a)
        x, y = self.runs[a[0]][0][self.at[a[0]]], self.runs[b[0]][0][self.at[b[0]]]
        n = common(x[0], y[0], a[1])
        left, right = x[0][n : n + 1], y[0][n : n + 1]
        first = left < right if left != right else x[1:] <= y[1:]
        return (a, (b[0], n)) if first else (b, (a[0], n))

    def __iter__(self) -> Iterator[tuple[Item, int]]:
        """Items in order, each with its common prefix with the one before."""
        nodes, runs, at = self.nodes, self.runs, self.at
        while self.top is not None:
            run, known = self.top
            items, shared = runs[run]
            i = at[run]
            yield items[i], known
            at[run] = i = i + 1
            player = (run, shared[i]) if i < len(items) else None
            node = (run + self.size) >> 1
            while node:
                player, nodes[node] = self._play(player, nodes[node])
                node >>= 1
            self.top = player


def stack_depths(shared: list[int], before: list[int], floor: int) -> Iterator[bytes]:
    """For each of the strings in turn, the distinct minima of ``shared`` back from it, ascending and packed (two bytes each).
    shared[i]: common prefix with the string before; ``before``: the minima seen from the string before the first."""
    stack = array("H", before)
    packed = stack.tobytes()
    for n in shared:
        changed = False
        while stack and stack[-1] > n:
            stack.pop()
            changed = True
        if n >= floor and (not stack or stack[-1] < n):
            stack.append(n)
            changed = True
        if changed:
            packed = stack.tobytes()
        yield packed


def unpack(depths: bytes) -> list[int]:
    return array("H", depths).tolist()


def merge_range(
    blobs: list[bytes], low: Item | None, high: Item | None, before: set[int], after: set[int], floor: int
) -> tuple[list[tuple[int, int]], list[bytes]]:
    """Document and place of the items of a range in order, and the distinct common prefixes (of ``floor`` at least) of each with
    all others, packed. The strings themselves aren't kept once they have left the tree."""
    places, shared = [], []
    first = last = b""
    for (string, doc, place), n in LoserTree([front_decode(b) for b in blobs]):
        if not places:
            first = string
        last = string
        places.append((doc, place))
        shared.append(n)
    if not places:
        return [], []
    if low:  # what lies before the range is seen through the splitter
        before = {min(d, common(low[0], first)) for d in before}
    shared[0] = max(before, default=0)
    left = list(stack_depths(shared, sorted(before), floor))
    back = [common(high[0], last) if high else 0, *shared[:0:-1]]
    for i, theirs in zip(range(len(left) - 1, -1, -1), stack_depths(back, sorted(after), floor)):
        mine = left[i]
        if not mine:
            left[i] = theirs
        elif theirs and mine != theirs:
            left[i] = array("H", sorted({*unpack(mine), *unpack(theirs)})).tobytes()
    return places, left


# ---- the operator


def _strings(data: bytes, places: list[int], doc: int, side: int, length: int, gram: int) -> Iterator[Item]:
    """Suffixes at the anchors (side 0), or the reversed prefixes before them, by gram (side 1)."""
    for a in places:
        if side == 0:
            yield data[a : a + length], doc, a
        else:
            yield xxhash.xxh3_64_digest(data[a : a + gram]) + data[max(0, a - (length - gram)) : a][::-1], doc, a


def candidate_starts(after: dict[int, list[int]], before: dict[int, list[int]], n: int, length: int) -> list[int]:
    """Starts of the strings that could be the first or the last repeated one around an anchor (place -> depths on either side)."""
    out = set()
    for a, right in after.items():
        left = before.get(a)
        if left is None:
            continue
        far, near = right[-1], left[-1] if left else 0
        if far + near < length:
            continue
        for d in {0, *left}:
            if d >= length - far:
                out.add(a - d)
        for r in right:
            if 0 <= length - r <= near:
                out.add(a - (length - r))
    return sorted(p for p in out if 0 <= p <= n - length)


def spans_of(starts: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes covered by strings that start there."""
    out: list[tuple[int, int]] = []
    for p in sorted(starts):
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], p + length)
        else:
            out.append((p, p + length))
    return out


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, row (a unique long for each row) and text; ids serve as rows if they are unique, else the rows are numbered and stored."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if dict(rows.dtypes)["id"] in ("bigint", "int"):
        twice = rows.groupBy("id").count().where("count > 1 or id is null")
        if twice.isEmpty():
            return rows.withColumn("row", F.col("id").cast("long"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def _with_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 4 * PIECE_BYTES):
            texts = [t.encode() for t in piece.column("text").to_pylist()]
            digest = xxhash.xxh3_64_intdigest
            places = _anchors_of(texts, length, gram)
            keys = [[digest(t[a : a + gram]) - 2**63 for a in p.tolist()] for t, p in zip(texts, places)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"), piece.column("row"), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([p.astype(np.int64) for p in places], pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "row", "n_bytes", "sha", "places", "keys"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "row", "text").mapInArrow(run, f"id {kind}, row long, n_bytes long, sha string, places array<long>, keys array<long>")


def _drawn(texts: DataFrame, share: float, length: int, gram: int) -> DataFrame:
    """row, place, suffix, prefix of a share of all anchors, drawn by hash of row and place: as many of a long document as of short ones."""
    most = np.uint64(min(2**64 - 1, int(share * 2.0**64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, at in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("places")):
                where = np.asarray(at.values, np.int64)
                h = where.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(xxhash.xxh3_64_intdigest(row.to_bytes(8, "little", signed=True)))
                h ^= h >> np.uint64(31)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
                picked = where[h <= most].tolist()
                if not picked:
                    continue
                data = text.as_py().encode()
                for k in range(0, len(picked), 10_000):
                    part = picked[k : k + 10_000]
                    sides = [pa.array([s for s, _, _ in _strings(data, part, row, side, length, gram)], pa.binary()) for side in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(part), pa.int64()), pa.array(part, pa.int64()), *sides], names=["row", "place", "suffix", "prefix"])

    return texts.select("row", "text", "places").mapInArrow(run, "row long, place long, suffix binary, prefix binary")


def repeated_starts(rows: DataFrame, places: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(row, starts) of the strings of ``length`` bytes that occur twice and bound a repeated stretch, and the stored
    (row, text, places) that they come from. rows: row, text; places: row, places (array)."""
    spark = rows.sparkSession
    texts = stored(rows.select("row", "text").join(places, "row"), "anchored")
    total = texts.agg(F.sum(F.size("places")).alias("n")).first()["n"] or 0
    if not total:
        return spark.createDataFrame([], "row long, starts array<long>"), texts
    ranges = min(RANGES, -(-total // RANGE))
    share = min(1.0, ranges * SAMPLES_A_RANGE / total)
    lists: list[list[Item]] = [[], []]
    for r in _drawn(texts, share, length, gram).limit(4 * RANGES * SAMPLES_A_RANGE).toLocalIterator():
        for side, name in enumerate(("suffix", "prefix")):
            lists[side].append((bytes(r[name]), r["row"], r["place"]))
    splitters: list[list[Item]] = []
    for sample in lists:
        sample.sort()
        splitters.append([sample[i * len(sample) // ranges] for i in range(1, ranges)] if len(sample) >= ranges else sample)
    cuts = spark.sparkContext.broadcast(splitters)
    floors = (gram, KEY_BYTES)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[Item], list[Item]] = ([], [])
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for side in (0, 1):
                items = sorted(held[side])
                held[side].clear()
                for k, blob, lower, upper in cut_run(items, cuts.value[side], floors[side]) if items else ():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([side], pa.int32()), pa.array([k], pa.int32()), pa.array([blob], pa.binary()),
                            pa.array([lower], pa.list_(pa.int32())), pa.array([upper], pa.list_(pa.int32())),
                        ],
                        names=["side", "part", "blob", "lower", "upper"],
                    )

        for batch in batches:
            for row, text, at in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("places")):
                data = text.as_py().encode()
                where = at.as_py()
                for k in range(0, len(where), 10_000):
                    for side in (0, 1):
                        held[side].extend(_strings(data, where[k : k + 10_000], row, side, length, gram))
                    size += len(where[k : k + 10_000]) * (2 * length - gram)
                    if size >= RUN_BYTES:
                        yield from flush()
                        size = 0
        yield from flush()

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        side, part = int(frame["side"].iloc[0]), int(frame["part"].iloc[0])
        own, floor = cuts.value[side], floors[side]
        before = {int(n) for x in frame["lower"] for n in x}
        after = {int(n) for x in frame["upper"] for n in x}
        items, depths = merge_range(
            [b for b in frame["blob"] if b is not None], own[part - 1] if part else None, own[part] if part < len(own) else None, before, after, floor
        )
        return pd.DataFrame({
            "row": np.array([i[0] for i in items], np.int64), "side": np.full(len(items), side, np.int32),
            "place": np.array([i[1] for i in items], np.int64), "depths": depths,
        })

    pieces = texts.mapInArrow(runs, "side int, part int, blob binary, lower array<int>, upper array<int>")
    depths = pieces.groupBy("side", "part").applyInPandas(merged, "row long, side int, place long, depths binary")
    by_row = depths.where(F.octet_length("depths") > 0).groupBy("row").agg(F.collect_list(F.struct("side", "place", "depths")).alias("found"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row, text, found in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("found")):
                data = text.as_py().encode()
                parts = found.values.flatten()
                sides: tuple[dict, dict] = ({}, {})
                for side, place, packed in zip(*(p.to_pylist() for p in parts)):
                    sides[side][place] = unpack(packed) if side == 0 else [d - KEY_BYTES for d in unpack(packed)]
                starts = candidate_starts(sides[0], sides[1], len(data), length)
                out[0].extend([row] * len(starts))
                out[1].extend(starts)
                out[2].extend(xxhash.xxh3_128_digest(data[p : p + length]) for p in starts)
                if len(out[0]) > 50_000:
                    yield _strings_batch(out)
                    out = ([], [], [])
            if out[0]:
                yield _strings_batch(out)

    def _strings_batch(out: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["row", "start", "hash"])

    strings = stored(texts.select("row", "text").join(by_row, "row").mapInArrow(windows, "row long, start long, hash binary"), "strings")
    twice = stored(strings.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    met = join_counts(strings, twice, "hash", "n", F.xxhash64("row", "start").cast("string").cast("binary"))
    return met.groupBy("row").agg(F.collect_list("start").alias("starts")), texts


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, n_bytes, spans (array of start, end in bytes: the maximal removed runs), kept_sha256 of every document."""
    rows = _keyed(small_batches(docs), key, text)
    found = stored(_with_anchors(rows, length, gram), "anchors")
    same = cut_lineage(found.groupBy("sha").agg(F.min("row").alias("first"), F.count("*").alias("copies")))
    single = found.join(same.select("first"), found["row"] == F.col("first")).select("row", F.explode(F.arrays_zip("places", "keys")).alias("a"))
    grams = single.select("row", F.col("a.places").alias("place"), F.col("a.keys").alias("key"))
    shared = stored(grams.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    places = join_counts(grams, shared, "key", "n", F.xxhash64("row", "place")).groupBy("row").agg(F.collect_list("place").alias("places"))
    starts, texts = repeated_starts(rows, places, length, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t, at in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("starts")):
                data = t.as_py().encode()
                spans = spans_of(at.as_py(), length)
                kept, last = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[last:a])
                    last = b
                kept.update(data[last:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in spans]], SPANS), pa.array([kept.hexdigest()])], names=["of", "cut", "rest"]
                )

    done = texts.select("row", "text").join(starts, "row").mapInArrow(cut, "of long, cut array<struct<start: long, end: long>>, rest string")
    rows = join_counts(found.select("id", "row", "n_bytes", "sha"), same, "sha", "copies", F.xxhash64("row").cast("string"))
    rows = rows.join(done, F.col("first") == F.col("of"), "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return rows.select(
        F.col("id").alias(key),
        "n_bytes",
        F.when(whole, all_).otherwise(F.coalesce("cut", none)).alias("spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
    )


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return remove_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
