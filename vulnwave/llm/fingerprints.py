"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below 1 / ``scale`` of the hash range, whatever the length of the
document, so that the sketch of a union is the union of sketches, and containment of a short document in a long one is estimated as
well as likeness of equals. Shingles are ``width`` words joined by their hashes; fewer words are one shingle; no words, no
shingle. A document none of whose hashes is below the threshold keeps its least hash instead (merging two
sketches drops such a hash as soon as one below the threshold is there).

All in built-in functions: words are hashed once, shingles are hashes of word hashes. Null texts are empty. Two empty sketches
have likeness and containment 1, an empty and another 0.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnwave.llm.util import BLANK, whole_text

WIDTH = 5
SCALE = 4
BLANKS = " \t\n\x0b\x0c\r"
LOWEST = -(2**63)


def with_sketch(docs: DataFrame, text: str, out: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """All columns of ``docs`` with the sketch of ``text``: sorted distinct hashes (array of long) in ``out``."""
    h, g = f"__{out}_words", f"__{out}_shingles"
    trimmed = F.btrim(whole_text(text), F.lit(BLANKS))
    hashes = F.transform(F.split(trimmed, BLANK), lambda w: F.xxhash64(w))
    docs = docs.withColumn(h, F.when(trimmed != "", hashes).otherwise(F.array().cast("array<bigint>")))
    n = F.size(h)
    rolled = F.transform(
        F.slice(F.col(h), F.lit(1), F.greatest(n - (width - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + k) for k in range(1, width)]),
    )
    shingles = F.when(n >= width, rolled).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    docs = docs.withColumn(g, shingles).drop(h)
    return docs.withColumn(out, _kept(F.col(g), scale)).drop(g)


def _below(hashes: Column, scale: int) -> Column:
    limit = 2**63 // scale
    return F.filter(hashes, lambda x: F.shiftrightunsigned(x, 1) < F.lit(limit))


def _kept(hashes: Column, scale: int) -> Column:
    below = F.array_sort(F.array_distinct(_below(hashes, scale)))
    least = F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(LOWEST)))).bitwiseXOR(F.lit(LOWEST))
    some = F.exists(hashes, lambda x: F.shiftrightunsigned(x, 1) < F.lit(2**63 // scale))
    return F.when(some | (F.size(hashes) == 0), below).otherwise(F.array(least))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of the two documents taken together."""
    return _kept(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of both that are in both (Jaccard), 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that are in b, 0 to 1."""
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    """The sketch as hex digits, comma-joined."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.hex(x)), ","))


def _bucket(order: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below the value; looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    values = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.size(F.filter(values([p[-1] for p in parts]), lambda x: x < order))
    fine = F.array(*[values(p) for p in parts])
    inside = F.size(F.filter(F.get(fine, coarse), lambda x: x < order))
    return F.when(coarse >= len(parts), len(bounds)).otherwise(coarse * step + inside)


def with_next(docs: DataFrame, key: str, text: str, derive: Callable[[DataFrame], DataFrame], derived: str) -> DataFrame:
    """``key``, ``text``, what ``derive`` makes of it in column ``derived``, and next_<text>, next_<derived>: those of the next row by
    descending key, and for the last row of the first.

    Null keys come last, by text hash; equal keys by text. Rows are cut into ranges of keys (approximate quantiles, twice as
    many as shuffle partitions), each of which is ordered by itself; the first row of each range is put at the
    end of the one before as well. One shuffle, of key and text: the derived column is made behind it.
    """
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    seen = docs.agg(F.percentile_approx(key, shares, 100 * parts).alias("bounds"), F.count("*").alias("n"), F.count(key).alias("known")).first()
    bounds = sorted(set(seen["bounds"] or []))
    spare = max(1, (seen["n"] - seen["known"]) * parts // max(1, seen["n"]))
    tie = F.when(F.col(key).isNull(), F.xxhash64(whole_text(text))).otherwise(0) if seen["n"] > seen["known"] else F.lit(0)
    rows = docs.withColumn("__tie", tie.cast("long"))
    cell = len(bounds) + 1 + F.floor(F.shiftrightunsigned("__tie", 11) * (spare / float(2**53))).cast("int")
    rows = rows.withColumn("__cell", F.when(F.col(key).isNull(), cell).otherwise(len(bounds) - _bucket(F.col(key), bounds)).cast("int"))
    # first row of each range: ids first, then the few rows that have them; one row a range at most
    first = rows.groupBy("__cell").agg(F.max(key).alias("__first"), F.min("__tie").alias("__least"))
    previous = F.coalesce(F.lag("__cell").over(Window.orderBy("__cell")), F.max("__cell").over(Window.partitionBy()))
    first = first.withColumn("__to", previous).withColumnRenamed("__cell", "__of")
    heads = rows.join(
        F.broadcast(first),
        (F.col("__cell") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__first")) & (F.col("__tie") == F.col("__least")),
    )
    order = (F.col(key).desc_nulls_last(), F.col("__tie"), F.col(text))
    nth = F.row_number().over(Window.partitionBy("__of").orderBy(*order))
    heads = heads.withColumn("__nth", nth).where("__nth = 1").withColumn("__cell", F.col("__to"))
    names = [key, text, "__tie", "__cell"]
    all_ = rows.select(*names, F.lit(0).alias("__extra")).union(heads.select(*names, F.lit(1).alias("__extra")))
    ahead = Window.partitionBy("__cell").orderBy("__extra", *order)
    found = derive(all_.withColumn(f"next_{text}", F.lead(text).over(ahead)))
    found = found.withColumn(f"next_{derived}", F.lead(derived).over(ahead)).where("__extra = 0")
    return found.select(key, text, derived, f"next_{text}", f"next_{derived}")


def edited(text: str, following: str) -> Column:
    """The text with its last third replaced by as many characters (or all) of the following one."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness to each other and to the next document's."""
    rows = docs.select("doc_id", whole_text("text").alias("text"))
    rows = with_next(rows, "doc_id", "text", lambda r: with_sketch(r, "text", "sketch"), "sketch")
    rows = rows.withColumn("edited", edited("text", "next_text")).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", "next_sketch", "edited"
    )
    rows = with_sketch(rows, "edited", "edited_sketch")
    own, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        containment(own, other).alias("in_edited"),
        containment(own, following).alias("in_next"),
    )
