"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint of 64 bits takes, for each bit, the majority of the XXH64 values (seed 42) of the 4-word shingles.
Each bit position has a code of ``radius`` + 1 bits; for every non-zero vector v of as many bits, the mask of v
holds the positions whose code has an odd product with v. Two fingerprints that differ in at most ``radius``
positions have some v whose product with all their codes is even, so that they agree under the mask of v:
of 2^(radius+1) - 1 tables (31 for 4), one at least puts each linked pair into one bucket.

Only distinct fingerprints enter the tables, so copies of a text cost one row. A bucket of up to ``BUCKET`` fingerprints
gives the edges of a spanning forest of its links, never its pairs. The fingerprints of a larger bucket agree under its mask
and can differ in the other positions only; those are masked once more in the same way, which loses no link. After
three levels 8 positions are left at most, so that no bucket stays large.

Empty and null texts have fingerprint zero and are linked like any other. Null ids never become a component's
id; a component without an id has null. Repeated rows give a row each; an empty table gives none. Columns other than id
and text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnwave.llm import util
from vulnwave.llm.components import components
from vulnwave.llm.util import slices, small_batches
from vulnwave.session import cut_lineage, stored

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
BUCKET = 2048
# Levels of masks: 64, 32, 16 and 8 positions.
LEVELS = 3
PIECE_BYTES = 2_000_000
# Shingles of one text that are hashed at a time.
HASHES = 50_000


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """Fingerprint of one text; signed, as Spark's long."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    ends = ends[width - 1 :].tolist()
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)[: len(ends) - 1]]).tolist()
    ones = np.zeros(BITS, np.int64)
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    for k in range(0, len(ends), HASHES):
        hashes = [digest(view[s:e], SEED) for s, e in zip(starts[k : k + HASHES], ends[k : k + HASHES])]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(ends), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` with the fingerprint as a long (replaced if it is there already)."""
    kept = small_batches(docs).drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        util.kept("simhash")
        for piece in slices(batches, text, PIECE_BYTES):
            found = pa.array([simhash(t) for t in piece.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*piece.columns, found], names=[*piece.schema.names, out])

    return kept.mapInArrow(run, T.StructType(kept.schema.fields + [T.StructField(out, T.LongType())]))


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the positions such that any ``radius`` of them are all outside some mask.

    Up to 2^radius positions get the codes whose first bit is set, more get all codes in turn: either way each
    mask holds about half of the positions at least.
    """
    half = 2**radius
    codes = [half + k for k in range(len(positions))] if len(positions) <= half else [1 + k % (2 * half - 1) for k in range(len(positions))]
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        masks.append(sum(1 << p for p, code in zip(positions, codes) if (code & v).bit_count() % 2))
    return masks


def _positions(mask: int) -> list[int]:
    return [p for p in range(BITS) if mask >> p & 1]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def forest(fingerprints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left = np.sort(fingerprints)
    edges = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count((left ^ node).view(np.uint64)) <= radius
            if near.any():
                found = left[near]
                edges += [(int(node), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return edges


def links(fingerprints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a, b: edges that connect distinct ``fingerprint`` values as all pairs within ``radius`` bits would."""
    rows = fingerprints.select("fingerprint", F.lit(0).cast("long").alias("mask"))
    found = None
    level = {0}
    for depth in range(1, LEVELS + 1):
        # the masks below each one: 31, 961 or 29,791 fixed values, each with half the positions left
        below = {m: [m | x for x in covering_masks(_positions(~m & (1 << BITS) - 1), radius)] for m in level}
        table = [(_signed(m), [_signed(b) for b in masks]) for m, masks in below.items()]
        table = fingerprints.sparkSession.createDataFrame(table, "mask long, below array<long>")
        keyed = rows.join(F.broadcast(table), "mask").select("fingerprint", F.explode("below").alias("mask"))
        keyed = keyed.withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))
        counts = cut_lineage(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"))
        small = counts.where(F.col("n") <= bucket) if depth < LEVELS else counts  # 256 at most by then
        shared = keyed.join(small.select("mask", "key"), ["mask", "key"])
        groups = shared.groupBy("mask", "key").agg(F.collect_list("fingerprint").alias("of"))
        edges = _edges(groups, radius)
        found = edges if found is None else found.union(edges)
        large = counts.where(F.col("n") > bucket).select("mask", "key")
        if depth == LEVELS or large.isEmpty():
            break
        rows = cut_lineage(keyed.join(large, ["mask", "key"]).select("fingerprint", "mask").distinct())
        level = {m & (1 << BITS) - 1 for masks in below.values() for m in masks}
    return found


def _edges(groups: DataFrame, radius: int) -> DataFrame:
    pairs = groups.where(F.size("of") == 2).select(F.col("of")[0].alias("a"), F.col("of")[1].alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                edges = forest(batch.column("of")[k].values.to_numpy(), radius)
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return pairs.union(groups.where(F.size("of") > 2).select("of").mapInArrow(run, "a long, b long"))


def components_of(fingerprinted: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (long), component_id: the smallest key reachable over links of at most ``radius`` bits."""
    rows = cut_lineage(fingerprinted.select(F.col(key).alias("key"), "fingerprint"))
    distinct = cut_lineage(rows.groupBy("fingerprint").agg(F.min("key").alias("least")))
    roots = components(links(distinct, radius))
    named = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left")
    named = named.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = cut_lineage(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fingerprint", "component_id")
    return rows.join(classes, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    rows = components_of(with_fingerprint(docs.select("doc_id", "text")).drop("text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` for one row of each component: that of the smallest key, null keys last.

    Rows that share key and fingerprint count as one; of them the one with the least text stays.
    """
    print_, order, nth = "__fingerprint", "__order", "__nth"
    rows = stored(with_fingerprint(docs, text, print_), "fingerprinted")
    narrow = rows.select(F.col(key).alias("key"), F.col(print_).alias("fingerprint"))
    narrow = cut_lineage(narrow.distinct())
    roots = components(links(narrow.select("fingerprint").distinct()))
    named = narrow.join(roots, narrow["fingerprint"] == roots["node"], "left")
    named = named.withColumn("root", F.coalesce("root", "fingerprint"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "fingerprint")).alias("m"))
    first = first.select(F.col("m.key").alias("__key"), F.col("m.fingerprint").alias(order))
    kept = rows.join(first, rows[key].eqNullSafe(first["__key"]) & (rows[print_] == first[order]))
    window = Window.partitionBy(key, print_).orderBy(text)
    return kept.withColumn(nth, F.row_number().over(window)).where(F.col(nth) == 1).select(*docs.columns)
