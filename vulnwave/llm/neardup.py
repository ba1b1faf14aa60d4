"""Near-duplicates by the Jaccard similarity of 5-word shingles, found by SimHash masks and MinHash bands and checked exactly.

Words are those of ``simhash`` (A-Z lower-cased, cut at the six ASCII blanks); a text of fewer than five words is one shingle.
The shingles of a text are a set: repeats don't count. Two texts are linked if their sets have a similarity of ``SIMILAR`` at
least, and a group is all that links reach.

First come the links of ``simhash``: fingerprints that differ in 4 bits at most, by its covering masks, give pairs, as do different sets
of one fingerprint. Far from all similar sets have such fingerprints, so the sets meet in bands as well:
each has ``BANDS`` keys of ``ROWS`` least hash values; two sets of similarity s share one at least with probability
1 - (1 - s^6)^28: 0.9998 at 0.8, 0.978 at 0.65. Only equal sets are linked by a hash alone; every other link is
one of two texts whose sets were compared. In the second turn the texts of a bucket are compared with one hub of it, the one that meets most
others in all its buckets; in the first only those that have no larger bucket, so that a large family is one group after one comparison each.
In the last turn, where a bucket still has more than one group, all texts of different groups are compared if there are ``SMALL`` at most.
Those of larger buckets are compared if they share a shingle early enough: with the shingles of each in one order, rarest first, two similar sets
have their first common one so near the start of both that what follows can still make them similar. Variants of a text that each
have too much of their own thus meet nobody, and no link between texts that share a key is lost.

Empty and null texts have the empty set and are linked with each other. Null keys never stand for a group that has another. Rows that
are repeated, or share key and set, are one row; all other columns are kept, those that start with two underscores excepted. An empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnwave.llm import simhash, util
from vulnwave.llm.components import components
from vulnwave.llm.util import join_counts, slices, small_batches
from vulnwave.session import stored

WIDTH = 5
SIMILAR = 0.8
BANDS = 28
ROWS = 6
# Texts of a bucket that are all compared with each other, if the first turns leave more than one group.
SMALL = 16
SEED = 42
PIECE_BYTES = 2_000_000
# Shingles that are hashed at a time.
HASHES = 2_048
# Shingles of the sets that a task holds on to while it compares.
HELD = 500_000
# Pairs that one copy of a hub's text is compared in, at least, and a bound on the hubs that have copies.
PARTNERS = 500
HOT = 1_000
# What sums of fractions may be off by.
SLACK = 1e-6

_draws = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
_XOR, _TIMES = _draws[0][:, None], (_draws[1] | np.uint64(1))[:, None]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts))
    return np.unique(hashes)


def bands(of: np.ndarray) -> list[int]:
    """Keys of a set, one a band; none for the empty set."""
    if not len(of):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(of), HASHES):
        least = np.minimum(least, ((of[None, k : k + HASHES] ^ _XOR) * _TIMES).min(1))
    data = least.tobytes()
    size = 8 * ROWS
    return [_signed(xxhash.xxh64_intdigest(data[size * b : size * (b + 1)], b)) for b in range(BANDS)]


def _signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sets is ``SIMILAR`` at least; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def with_sets(docs: DataFrame, text: str = "text", prefix: str = "__") -> DataFrame:
    """All columns of ``docs`` with the hash of its set, the size of the set, its fingerprint and the keys of its bands."""
    kept = small_batches(docs)
    added = [T.StructField(f"{prefix}{name}", T.LongType()) for name in ("node", "n", "fingerprint")] + [T.StructField(f"{prefix}bands", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        util.kept("neardup")
        for piece in slices(batches, text, PIECE_BYTES):
            texts = piece.column(text).to_pylist()
            sets = [shingles(t) for t in texts]
            node = pa.array([_signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets], pa.int64())
            prints = pa.array([simhash.simhash(t) for t in texts], pa.int64())
            new = [node, pa.array([len(s) for s in sets], pa.int64()), prints, pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=[*piece.schema.names, *[f.name for f in added]])

    return kept.mapInArrow(run, T.StructType(kept.schema.fields + added))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the stored pairs (node, hub, and their roots) whose texts are similar.

    A hub that many pairs have is hot: its text is laid out in copies, and its pairs are dealt among them. The bound grows with the pairs, so
    that fewer than ``HOT`` hubs are hot and can be broadcast.
    """
    bound = max(PARTNERS, -(-pairs.count() // HOT))
    hot = pairs.groupBy("hub").agg(F.count("*").alias("of")).where(F.col("of") > bound)
    hot = hot.select("hub", F.ceil(F.col("of") / bound).alias("copies"))
    one = F.coalesce("copies", F.lit(1).cast("long"))
    dealt = pairs.join(F.broadcast(hot), "hub", "left").withColumn("copy", F.pmod(F.xxhash64("node"), one)).drop("copies")
    hubs = texts.join(pairs.select(F.col("hub").alias("node")).distinct(), "node", "left_semi").withColumnsRenamed({"node": "hub", "text": "hub_text"})
    hubs = hubs.join(F.broadcast(hot), "hub", "left").select("hub", "hub_text", F.explode(F.sequence(F.lit(0).cast("long"), one - 1)).alias("copy"))
    both = dealt.join(texts, "node").join(hubs, ["hub", "copy"])
    both = small_batches(both.select("node", "hub", "root", "hub_root", "text", "hub_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        util.kept("neardup")
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            node, hub = batch.column("node").to_pylist(), batch.column("hub").to_pylist()
            text, hub_text = batch.column("text"), batch.column("hub_text")
            good = []
            for i in range(batch.num_rows):
                ends = []
                for k, column in ((node[i], text), (hub[i], hub_text)):
                    if (found := held.get(k)) is None:
                        found = shingles(column[i].as_py())
                        if size > HELD:
                            held, size = {}, 0
                        held[k] = found
                        size += len(found)
                    ends.append(found)
                good.append(similar(*ends))
            yield batch.select(["root", "hub_root"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "root long, hub_root long")


def _near(n: Column, other: Column) -> Column:
    """Sets of these sizes can be similar."""
    return F.least(n, other) >= SIMILAR * F.greatest(n, other)


def by_masks(rows: DataFrame) -> DataFrame:
    """node, hub, root, hub_root: pairs of sets whose fingerprints the masks of ``simhash`` link, and of sets of one fingerprint with its first.

    ``rows``: node, n, fingerprint. A fingerprint is stood for by its least node; the empty set pairs with none.
    """
    held = F.struct("node", "n")
    prints = rows.where("n > 0").groupBy("fingerprint").agg(F.min(held).alias("first"), F.max(held).alias("last"))
    prints = stored(prints.select("fingerprint", F.col("first.node").alias("hub"), F.col("first.n").alias("hub_n"), (F.col("first") < F.col("last")).alias("more")), "prints")
    edges = simhash.links(prints.select("fingerprint")).distinct()
    ends = prints.select(F.col("fingerprint").alias("a"), F.col("hub").alias("node"), F.col("hub_n").alias("n"))
    linked = edges.join(ends, "a").join(prints.withColumnRenamed("fingerprint", "b"), "b")
    same = rows.select("node", "n", "fingerprint").join(prints.where("more"), "fingerprint").where("node <> hub")
    pairs = linked.select("node", "n", "hub", "hub_n").unionByName(same.select("node", "n", "hub", "hub_n"))
    pairs = pairs.where(_near(F.col("n"), F.col("hub_n"))).distinct()
    return pairs.select("node", "hub", F.col("node").alias("root"), F.col("hub").alias("hub_root"))


def by_rarest(crowded: DataFrame, texts: DataFrame) -> DataFrame:
    """node, hub, root, hub_root: pairs of different roots that hold all similar ones among ``crowded`` (node, n, root; each node once).

    The shingles of a set are ordered by the number of crowded sets that have them, the rarest first. What comes before the first
    common one of two sets isn't shared, so they can be similar only if enough follows it in both.
    """
    both = small_batches(crowded.join(texts, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        util.kept("neardup")
        for piece in slices(batches, "text", PIECE_BYTES):
            sets = [shingles(t) for t in piece.column("text").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), pa.int64())
            every = pa.array(np.concatenate(sets).view(np.int64), pa.int64())
            rows = pa.RecordBatch.from_arrays([*[piece.column(c).take(of) for c in ("node", "n", "root")], every], names=["node", "n", "root", "shingle"])
            for k in range(0, rows.num_rows, HELD):
                yield rows.slice(k, HELD)

    every = stored(both.mapInArrow(run, "node long, n long, root long, shingle long"), "shingles")
    counts = stored(every.groupBy("shingle").agg(F.count("*").alias("of")).where("of > 1"), "counts")
    shared = join_counts(every, counts, "shingle", "of", F.xxhash64("node", "shingle"))
    own = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("of", "shingle")) - 1
    first = shared.withColumn("rest", F.col("n") - place).where(F.col("rest") >= SIMILAR * F.col("n") - SLACK)
    first = stored(first.select("shingle", "node", "n", "root", "rest"), "prefixes")
    # pairs of different roots have an end that isn't of the root most frequent with the shingle: a large group isn't paired with itself
    roots = first.groupBy("shingle", "root").agg(F.count("*").alias("of")).groupBy("shingle")
    main = roots.agg(F.max(F.struct("of", "root"))["root"].alias("main"), F.count("*").alias("roots")).where("roots > 1").select("shingle", "main")
    hubs = stored(first.join(main, "shingle"), "prefixes")
    ends = hubs.where("root <> main").drop("main")
    hubs = hubs.select("shingle", "main", *[F.col(c).alias(f"hub_{c}") for c in ("n", "root", "rest")], F.col("node").alias("hub"))
    enough = (1 + SIMILAR) * F.least("rest", "hub_rest") >= SIMILAR * (F.col("n") + F.col("hub_n")) - SLACK
    once = (F.col("hub_root") == F.col("main")) | (F.col("node") < F.col("hub"))
    met = ends.join(hubs, "shingle").where((F.col("root") != F.col("hub_root")) & enough & once)
    return met.select("node", "hub", "root", "hub_root").distinct()


def links(rows: DataFrame, small: int = SMALL) -> DataFrame | None:
    """node, root of all that is linked to another; None if nothing is. ``rows``: id (of the row), node, n, fingerprint, bands, text.

    A turn stores its pairs, its links between roots, the roots these lead to and what is left of the buckets; roots are contracted
    by the links of the turn alone, and the turns' roots are followed one after the other at the end.
    """
    masked = stored(by_masks(rows.select("node", "n", "fingerprint")), "pairs")
    sets = rows.select("node", "n", "bands").dropDuplicates(["node"])
    keyed = sets.select("node", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("of")).where("of > 1")
    # how many a set meets in all its buckets: an original meets more than its edited copies do
    met = keyed.join(shared, "key").groupBy("node").agg(
        F.max("n").alias("n"), F.sum("of").alias("met"), F.max(F.struct("of", "key")).alias("home"), F.collect_list(F.struct("key", "of")).alias("in")
    )
    left = met.select("node", "n", F.col("node").alias("root"), "met", F.col("home.key").alias("home"), F.inline("in"))
    left = stored(left.withColumn("home", F.col("home") == F.col("key")), "buckets")
    named = left.select("node").union(masked.select("node")).union(masked.select("hub")).distinct()
    one = rows.select("node", "id").join(named, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    texts = stored(one.join(rows.select("id", "text"), "id").select("node", "text"), "compared")
    moves: list[DataFrame] = []

    def moved(pairs: DataFrame, buckets: DataFrame) -> DataFrame:
        """``buckets`` with the roots that the links among the stored pairs lead to."""
        if pairs.isEmpty():
            return buckets
        new = stored(_verified(pairs, texts).distinct(), "links")
        if new.isEmpty():
            return buckets
        moves.append(stored(components(new, "root", "hub_root"), "roots"))
        to = moves[-1].select(F.col("node").alias("root"), F.col("root").alias("to"))
        return buckets.join(to, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")

    def mixed(buckets: DataFrame) -> DataFrame:
        several = buckets.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
        return stored(buckets.join(several.select("key"), "key"), "buckets")

    left = mixed(moved(masked, left))
    for turn in range(2):
        order = F.xxhash64(F.lit(0), "node").alias("order")
        chosen = left.groupBy("key").agg(F.min(F.struct(-F.col("met"), order, "node", "n", "root")).alias("h"))
        chosen = chosen.select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.root").alias("hub_root"))
        pairs = (left if turn else left.where("home")).join(chosen, "key").where(F.col("root") != F.col("hub_root")).where(_near(F.col("n"), F.col("hub_n")))
        pairs = stored(pairs.select("node", "hub", "root", "hub_root").distinct(), "pairs")
        left = mixed(moved(pairs, left))
    few = left.where(F.col("of") <= small).select("key", "node", "n", "root")
    hubs = few.withColumnsRenamed({"node": "hub", "n": "hub_n", "root": "hub_root"})
    pairs = few.join(hubs, "key").where((F.col("node") < F.col("hub")) & (F.col("root") != F.col("hub_root")) & _near(F.col("n"), F.col("hub_n")))
    pairs = pairs.select("node", "hub", "root", "hub_root")
    crowded = left.where(F.col("of") > small).select("node", "n", "root").distinct()
    if not crowded.isEmpty():
        pairs = pairs.union(by_rarest(crowded, texts))
    moved(stored(pairs.distinct(), "pairs"), left)
    return followed(moves) if moves else None


def followed(moves: list[DataFrame]) -> DataFrame:
    """node, root after all moves: each is node, root of nodes that were roots before it."""
    labels = moves[0]
    for step in moves[1:]:
        to = step.select(F.col("node").alias("root"), F.col("root").alias("to"))
        added = step.join(labels.select("node"), "node", "left_anti")
        labels = labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(added)
    return labels


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """The columns of ``docs`` for one row of each group: that of the smallest key, null keys last.

    Rows that share key and set count as one; of them the one whose text has the least MD5 stays. Texts are moved by the ids of the rows that are kept.
    """
    sketched = with_sets(docs, text).withColumn("__id", F.monotonically_increasing_id())
    rows = stored(sketched.withColumn("__mark", F.md5(F.col(text).cast("binary"))), "sketched")
    names = {"__id": "id", "__node": "node", "__n": "n", "__fingerprint": "fingerprint", "__bands": "bands", text: "text"}
    roots = links(rows.select(*[F.col(a).alias(b) for a, b in names.items()]), small)
    narrow = rows.select(F.col(key).alias("key"), F.col("__node").alias("node"), F.col("__mark").alias("mark"), F.col("__id").alias("id"))
    named = narrow.withColumn("root", F.col("node"))
    if roots is not None:
        named = narrow.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "node", "mark", "id")).alias("m"))
    return rows.join(first.select(F.col("m.id").alias("__id")), "__id").select(*docs.columns)
