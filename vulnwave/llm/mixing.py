"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, -ln(u) / weight, from a hash of its id and text; within a source, the documents
of the smallest keys are a weighted sample without replacement. A source's target is spent on complete
epochs (every document once) first; what is left is spent down the list of keys, as far as the sum of sizes
comes nearest to it.

The prefix sums need no sort of a whole source: keys fall into cells of a fixed relative width, sums by cell (at most
``CELLS`` an octave, some 60,000 a source whatever its size) lead to the one cell in which the list ends, and only
the rows of that cell are sorted. What comes out is a cut-off key a source, so that a document's share follows from its own row.

Null texts count as empty; size 0 takes nothing. Null sources are one source, the last. Rows that are
equal in id and text draw equal keys and share their fate. Weights that are null or below ``LEAST_WEIGHT`` count as that.
An empty table gives none. The two sorts over all sources hold a row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnwave.llm.util import WORD, whole_text
from vulnwave.session import checked_broadcast, cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = "mix-1"
CELLS = 1024
LEAST_WEIGHT = 0.05
# Characters that count against a document's quality.
JUNK = "%$#&*!@^~|<>{}[]=_0123456789"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def quality(text: str = "text") -> Column:
    """Share of characters that aren't junk, at least ``LEAST_WEIGHT``."""
    clean, all_ = F.length(F.translate(whole_text(text), JUNK, "")), F.length(whole_text(text))
    return F.greatest(F.lit(LEAST_WEIGHT), F.when(all_ == 0, 1.0).otherwise(clean / all_))


def draw(key: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on id and text only."""
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(whole_text(text))))
    return (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """All columns of ``docs`` with __source, __size (words) and __key (exponential key)."""
    w = F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(quality(text) if weight is None else weight.cast("double"), F.lit(LEAST_WEIGHT)))
    return docs.withColumns({"__source": F.col(source), "__size": word_count(text), "__key": -F.log(draw(key, text)) / w})


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target of ``rows`` (__source, __size): weights in turn over the sources in code-point
    order, ``share`` of all sizes in total, no target above ``repeats`` times its source's size."""
    sizes = rows.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    sizes = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    sizes = sizes.withColumn("most", repeats * F.col("source_size").cast("double"))
    # the level rises past the sources that are full first: those with the least room for their weight
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("__source").asc_nulls_last())
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    before = F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    sizes = sizes.withColumn("level", (total - before) / rest)
    full = F.col("most") / F.col("weight") <= F.col("level")
    level = F.max(F.when(~full, F.col("level"))).over(everything)
    return sizes.select("__source", "source_size", F.when(full, F.col("most")).otherwise(F.col("weight") * level).alias("target"))


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with epochs (complete ones) and cut: documents with a key up to it are taken once more (null: none)."""
    size = F.col("source_size")
    goals = goals.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * size)
    cell = F.floor(F.log2("__key") * CELLS).alias("cell")
    cells = rows.groupBy("__source", cell).agg(F.sum("__size").alias("sum"), F.max("__key").alias("last"))
    ahead = Window.partitionBy("__source").orderBy("cell")
    cells = cells.withColumn("before", F.sum("sum").over(ahead) - F.col("sum"))
    cells = cells.withColumn("reached", F.max("last").over(ahead.rowsBetween(Window.unboundedPreceding, -1)))
    lookup = cut_lineage(goals)
    small = checked_broadcast(lookup.withColumnRenamed("__source", "of"))
    same = F.col("__source").eqNullSafe(F.col("of"))
    cells = cells.join(small, same)
    # the cell in which the rest is used up, and the last one if all of it fits
    ends = cells.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest")))
    ends = cut_lineage(ends.select("of", "cell", "before", "reached", "rest"))
    at = rows.select("__source", "__size", "__key", cell)
    # rows of the sources' last cells only: a bounded look-up side, a small result
    few = at.join(checked_broadcast(ends.withColumnRenamed("cell", "end")), same & (F.col("cell") == F.col("end")))
    inside = Window.partitionBy("of").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("__size").over(inside), F.lit(0)) + F.col("__size") / 2
    last = few.withColumn("fits", middle <= F.col("rest")).groupBy("of").agg(
        F.max(F.when(F.col("fits"), F.col("__key"))).alias("within"), F.first("reached").alias("reached")
    )
    last = last.select(F.col("of").alias("at"), F.coalesce("within", "reached").alias("cut"))
    return lookup.join(last, F.col("__source").eqNullSafe(F.col("at")), "left").select(
        F.col("__source").alias("of"), "source_size", "target", "epochs", "cut"
    )


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and __copies: how often the mix takes the document."""
    found = rows.join(checked_broadcast(plan), F.col("__source").eqNullSafe(F.col("of")))
    once_more = F.coalesce(F.col("__key") <= F.col("cut"), F.lit(False)).cast("long")
    return found.withColumn("__copies", F.when(F.col("__size") > 0, F.col("epochs") + once_more).otherwise(0).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = cut_lineage(scored(docs.select("doc_id", "text", "source")).select("doc_id", "__source", "__size", "__key"))
    plan = cut_lineage(cuts(rows, targets(rows)))
    return mixed(rows, plan).select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken")
    )


def sample(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, each document as often as the mix takes it."""
    rows = scored(docs)
    narrow = cut_lineage(rows.select("__source", "__size", "__key"))
    plan = cut_lineage(cuts(narrow, targets(narrow)))
    taken = mixed(rows, plan).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)


MIX_SQL = f"""
WITH doc AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), one AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    greatest({LEAST_WEIGHT}::DOUBLE, CASE WHEN length(text) = 0 THEN 1.0::DOUBLE
      ELSE length(translate(text, '{JUNK}', ''))::DOUBLE / length(text)::DOUBLE END) AS weight,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text)), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE AS u
  FROM doc
), keyed AS (
  SELECT doc_id, source, size, -ln(u) / weight AS key FROM one
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM keyed GROUP BY source
), levels AS (
  SELECT *, 2 * source_size::DOUBLE AS most,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size::DOUBLE) OVER (ORDER BY 2 * source_size::DOUBLE / w, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 2 * source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sizes
), goals AS (
  SELECT source, source_size, CASE WHEN most / w <= level THEN most
    ELSE w * max(CASE WHEN most / w <= level THEN NULL ELSE level END) OVER () END AS target FROM levels
), spent AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goals
), listed AS (
  SELECT k.doc_id, k.source, k.size, k.key, s.source_size, s.target, s.epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE
      + k.size / 2.0::DOUBLE <= s.target - s.epochs * s.source_size AS fits
  FROM keyed k JOIN spent s ON k.source IS NOT DISTINCT FROM s.source
), cut AS (
  SELECT *, max(CASE WHEN fits THEN key END) OVER (PARTITION BY source) AS cut FROM listed
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN size * (epochs + CASE WHEN key <= cut THEN 1 ELSE 0 END) ELSE 0 END AS taken
FROM cut
"""
