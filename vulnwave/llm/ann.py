"""Nearest neighbours by largest inner product: stable projections, kd-trees, a chi-square stopping test.

Largest inner product becomes least Euclidean distance: a candidate x, divided by the largest norm M, gets one more coordinate that brings
it to norm 1, a query, scaled to norm 1, gets 0. Distances are projected to ``DIMS`` dimensions by Gaussian (2-stable) vectors: the squared
projected distance over the squared distance is chi-square with ``DIMS`` degrees of freedom. A query takes candidates in the order of
their projected distance, a leaf of a kd-tree at a time, and computes their true inner products, until that distance, squared, over the
squared distance of its k-th nearest so far passes the ``SURE`` quantile: a candidate not yet seen would then be nearer
with a probability below 1 - ``SURE`` only.

Spread over tasks: a kd-tree over a bounded sample of projections (``SAMPLE`` rows by hash) cuts space into cells; every row is put into
its cell, and cells of more rows than ``PART`` (equal vectors, say) into parts by hash. Each part gets a kd-tree of its own.
A query first searches a part of the cell that it lies in; its k-th distance there says by the same test which
cells and parts can still matter, and it is sent to those alone. Queries travel in blocks of ``QUERIES``.

Vectors that are null, empty, zero, hold null or non-finite components or aren't as long as most take no part. Ties go to the smaller
id. Components may be of any size, as norms are taken in units of the largest component; inner products beyond the range of
doubles are infinite. Rows with the query's id aren't its candidates; null ids take no part. Repeated rows are candidates each;
of the usable vectors of a query's id the least in array order is asked. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnwave.session import cut_lineage

DIMS = 10
SURE = 0.95
K = 20
SAMPLE = 20_000
PART = 20_000
LEAF = 256
QUERIES = 500
SEED = 20
LARGEST = float(np.finfo(float).max)


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi-square of ``dims`` (even) degrees <= x) = p, by bisection of the closed form."""
    if dims % 2:
        raise ValueError("an even number of dimensions is needed")

    def below(x: float) -> float:
        term = total = 1.0
        for j in range(1, dims // 2):
            term *= x / 2 / j
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 10.0 * dims + 200
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(width: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """Gaussian vectors for ``width`` coordinates; the same for all tasks."""
    return np.random.default_rng(seed).standard_normal((width, dims))


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Norms of non-zero vectors, squared in units of their largest component; the largest double beyond the range."""
    most = np.abs(vectors).max(1)
    parts = vectors / most[:, None]
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt(np.einsum("ij,ij->i", parts, parts)), LARGEST)


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """Candidates in units of the largest norm ``most``, with the coordinate that brings them all to norm 1."""
    parts = vectors / most
    rest = np.maximum(1 - np.einsum("ij,ij->i", parts, parts), 0.0)
    return np.hstack([parts, np.sqrt(rest)[:, None]])


def aimed(vectors: np.ndarray, norm: float = 1.0) -> np.ndarray:
    """Queries at norm ``norm`` and 0 in the last coordinate: the order of inner products is kept."""
    return np.hstack([vectors / lengths(vectors)[:, None] * norm, np.zeros((len(vectors), 1))])


class KdTree:
    """Points cut at medians of the widest dimension, down to leaves of at most ``leaf``; each leaf has its bounding box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.leaves: list[np.ndarray] = []
        boxes = []
        todo = [order]
        while todo:
            rows = todo.pop()
            own = points[rows]
            low, high = own.min(0), own.max(0)
            axis = int((high - low).argmax())
            if len(rows) > leaf and high[axis] > low[axis]:
                middle = len(rows) // 2
                cut = rows[np.argpartition(own[:, axis], middle)]
                todo += [cut[:middle], cut[middle:]]
            else:
                # equal points can't be cut apart by place, only by number
                for part in np.array_split(rows, -(-len(rows) // leaf)):
                    self.leaves.append(part)
                    boxes.append(np.concatenate([low, high]))
        self.boxes = np.array(boxes)

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point from the box of each leaf."""
        return np.stack([_gaps(self.boxes, p) for p in points])


@dataclass(frozen=True)
class Index:
    """What a query needs to know of all cells: boxes of the projected rows, number of parts, and the scale."""

    most: float
    width: int
    axes: np.ndarray  # of the inner nodes of the cell tree, -1 for leaves
    cuts: np.ndarray
    left: np.ndarray
    cells: np.ndarray  # cell of each leaf node

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), int)
        while (axis := self.axes[node]).max(initial=-1) >= 0:
            inner = axis >= 0
            at = node[inner]
            right = points[inner, self.axes[at]] > self.cuts[at]
            node[inner] = self.left[at] + right
        return self.cells[node]


def _cell_tree(sample: np.ndarray, cells: int) -> tuple[np.ndarray, ...]:
    """Median cuts of the sample into about ``cells`` leaves."""
    axes, cuts, left, of = [-1], [0.0], [0], [0]
    todo = [(0, sample, cells)]
    n = 0
    while todo:
        node, points, want = todo.pop()
        spread = points.max(0) - points.min(0) if len(points) else np.zeros(1)
        axis = int(spread.argmax())
        if want < 2 or spread[axis] <= 0:
            of[node] = n
            n += 1
            continue
        cut = float(np.median(points[:, axis]))
        if cut >= points[:, axis].max():  # more than half are equal and largest
            cut = float(points[points[:, axis] < cut, axis].max())
        axes[node], cuts[node], left[node] = axis, cut, len(axes)
        for side in (points[:, axis] <= cut, points[:, axis] > cut):
            axes.append(-1)
            cuts.append(0.0)
            left.append(0)
            of.append(0)
            todo.append((len(axes) - 1, points[side], want // 2))
    return np.array(axes), np.array(cuts), np.array(left), np.array(of)


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v (array of double) and norm of the rows that take part."""
    rows = table.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("key").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    rows = rows.withColumn("most", F.array_max(F.transform("v", F.abs))).where("most > 0")
    parts = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most")))
    rows = rows.select("key", "v", F.least(F.col("most") * F.sqrt(parts), F.lit(LARGEST)).alias("norm"))
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (widths[0]["n"] if widths else 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def search(table: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row of ``queries`` (same columns as ``table``)."""
    spark = table.sparkSession
    rows = cut_lineage(usable(table, key, vector))
    scale = rows.agg(F.max("norm").alias("most"), F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, most, width = scale["n"], scale["most"] or 1.0, scale["width"] or 0
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    matrix = projection(width + 1)
    share = min(1.0, SAMPLE / n)
    drawn = F.shiftrightunsigned(F.xxhash64("key"), 11) / float(2**53) < share
    sample = np.array([r["v"] for r in rows.where(drawn).limit(2 * SAMPLE).select("v").collect()] or np.zeros((1, width)))
    tree = _cell_tree(lifted(sample, most) @ matrix, max(1, -(-n // (PART // 2))))
    index = spark.sparkContext.broadcast((Index(most, width, *tree), matrix))
    limit = chi_square_quantile(SURE, DIMS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = index.value
        for batch in batches:
            points = lifted(_matrix(batch.column("v"), own.width), own.most) @ m
            cell = pa.array(own.cell_of(points), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), cell], names=["key", "v", "cell"])

    placed = cut_lineage(rows.select("key", "v").mapInArrow(place, "key long, v array<double>, cell int"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    spread = placed.join(F.broadcast(sizes), "cell")
    spread = spread.withColumn("part", F.pmod(F.xxhash64("key", F.lit(1), F.monotonically_increasing_id()), F.col("parts")).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        own, m = index.value
        frame = frame.sort_values("key", kind="stable")
        vectors = np.array(frame["v"].tolist(), float)
        points = lifted(vectors, own.most) @ m
        box = np.concatenate([points.min(0), points.max(0)])
        first = frame.iloc[0]
        return pd.DataFrame({
            "cell": [first["cell"]], "part": [first["part"]], "n": [len(frame)], "box": [box.tolist()],
            "keys": [frame["key"].to_numpy("<i8").tobytes()], "vectors": [vectors.astype("<f8").tobytes()],
        })

    packed = spread.select("cell", "part", "key", "v").groupBy("cell", "part")
    parts = cut_lineage(packed.applyInPandas(pack, "cell int, part int, n int, box array<double>, keys binary, vectors binary"))
    boxes = parts.select("cell", "part", "box").orderBy("cell", "part").collect()  # a few numbers for each PART rows
    where = spark.sparkContext.broadcast((
        np.array([(b["cell"], b["part"]) for b in boxes], int).reshape(-1, 2), np.array([b["box"] for b in boxes]).reshape(-1, 2 * DIMS),
    ))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = index.value
        names, box = where.value
        for batch in batches:
            points = aimed(_matrix(batch.column("v"), own.width)) @ m
            nearest = [int(_gaps(box, p).argmin()) for p in points]
            ends = pa.array(np.full(len(points), np.inf))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("v"), pa.array(names[nearest, 0], pa.int32()), pa.array(names[nearest, 1], pa.int32()), ends],
                names=["key", "v", "cell", "part", "reach"],
            )

    asked = usable_queries(queries, key, vector, width)
    kind = "key long, v array<double>, cell int, part int, reach double"
    first = _searched(asked.mapInArrow(home, kind), parts, index, limit, k)
    first = cut_lineage(first)
    # the k-th distance of the first part says which others can hold something nearer
    reach = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("gap").alias("reach"))
    reach = reach.withColumn("reach", F.when(F.col("n") >= k, F.col("reach")).otherwise(float("inf"))).select("query_id", "reach")
    known = asked.join(reach, asked["key"] == reach["query_id"], "left").select("key", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = index.value
        names, box = where.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                point = (aimed(_matrix(row.column("v"), own.width)) @ m)[0]
                reach = row.column("reach")[0].as_py()
                gaps = _gaps(box, point)
                home = int(gaps.argmin())
                chosen = [int(i) for i in np.nonzero(gaps <= limit * reach)[0] if i != home]
                if chosen:
                    same = pa.array(np.zeros(len(chosen), int))
                    yield pa.RecordBatch.from_arrays(
                        [row.column("key").take(same), row.column("v").take(same), pa.array(names[chosen, 0], pa.int32()), pa.array(names[chosen, 1], pa.int32()), row.column("reach").take(same)],
                        names=["key", "v", "cell", "part", "reach"],
                    )

    second = _searched(known.mapInArrow(others, kind), parts, index, limit, k)
    found = first.union(second)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def usable_queries(queries: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    rows = queries.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("key").isNotNull() & F.col("v").isNotNull() & (F.size("v") == width)).where(finite)
    return rows.groupBy("key").agg(F.min("v").alias("v"))


def _gaps(box: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distance of a point from each box."""
    low, high = box[:, : len(point)], box[:, len(point) :]
    out = np.maximum(low - point, 0) + np.maximum(point - high, 0)
    return np.einsum("ij,ij->i", out, out)


def _searched(asked: DataFrame, parts: DataFrame, index, limit: float, k: int) -> DataFrame:
    """query_id, vec_id, score, gap (squared distance): up to ``k`` nearest of each query in the part it is sent to."""

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        return pd.DataFrame({
            "cell": [first["cell"]], "part": [first["part"]], "asked": [frame["key"].to_numpy("<i8").tobytes()],
            "points": [np.array(frame["v"].tolist(), "<f8").tobytes()], "reach": [frame["reach"].to_numpy("<f8").tobytes()],
        })

    sizes = asked.groupBy("cell", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    salted = asked.join(sizes, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    blocks = salted.select("cell", "part", "block", "key", "v", "reach").groupBy("cell", "part", "block")
    blocks = blocks.applyInPandas(block, "cell int, part int, asked binary, points binary, reach binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = index.value
        last, tree, sizes = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                name = row["cell"], row["part"]
                if name != last:
                    keys = np.frombuffer(row["keys"], "<i8")
                    vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, own.width)
                    last, tree, sizes = name, KdTree(lifted(vectors, own.most) @ m), lengths(vectors)
                asked = np.frombuffer(row["asked"], "<i8")
                points = np.frombuffer(row["points"], "<f8").reshape(-1, own.width)
                reach = np.frombuffer(row["reach"], "<f8")
                aims = aimed(points)
                out: list = [[], [], [], []]
                q, found, gaps = nearest(tree, keys, vectors, sizes, aims[:, :-1], aims @ m, asked, own.most, limit, reach, k)
                out[0], out[1], out[3] = asked[q], keys[found], gaps
                out[2] = exact(points[q], vectors[found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())],
                    names=["query_id", "vec_id", "score", "gap"],
                )

    met = blocks.join(parts.select("cell", "part", "keys", "vectors"), ["cell", "part"])
    return met.mapInArrow(run, "query_id long, vec_id long, score double, gap double")


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component on; where that leaves the range on the way, in units
    of the rows' largest components."""
    if not len(a):
        return np.zeros(0)
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.add.accumulate(a * b, axis=1)[:, -1]
        far = ~np.isfinite(out)
        if far.any():
            u, v = np.abs(a[far]).max(1), np.abs(b[far]).max(1)
            out[far] = np.add.accumulate(a[far] / u[:, None] * (b[far] / v[:, None]), axis=1)[:, -1] * u * v
    return out


def nearest(tree, keys, vectors, sizes, aims, points, asked, most, limit, reach, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of the ``k`` nearest of each query and a few more, by incremental search in the projection.

    sizes: norms of the vectors; aims: the queries at norm 1, points: their projections. Each query takes the leaves in the order of
    their distance from it, until the test stops it. In each round all queries that go on take their next leaf, those that take
    the same one in one matrix product. Rows are ranked by inner product; distances only stop the search and leave out what is further.
    """
    gaps = tree.gaps(points)
    order = np.argsort(gaps, axis=1, kind="stable")
    going = np.ones(len(aims), bool)
    bound = np.array(reach, float)
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, row, inner product
    everyone = np.arange(len(aims))
    for turn in range(gaps.shape[1]):
        leaf = order[:, turn]
        going &= gaps[everyone, leaf] <= limit * bound
        if not going.any():
            break
        new = [held]
        for at in np.unique(leaf[going]):
            who = np.nonzero(going & (leaf == at))[0]
            rows = tree.leaves[at]
            with np.errstate(over="ignore", invalid="ignore"):
                found = np.nan_to_num(aims[who] @ vectors[rows].T)
            other = asked[who][:, None] != keys[rows][None, :]
            i, j = np.nonzero(other & (_distance(found, most) <= bound[who][:, None] + 1e-9))
            new.append([who[i], rows[j], found[i, j]])
        held = [np.concatenate(x) for x in zip(*new)]
        # equal vectors may differ in the last bits of a product: ties go by key within a rounding of the cosine
        size = sizes[held[1]]
        ranked = np.lexsort((keys[held[1]], -np.round(held[2] / size, 12) * size, held[0]))
        held = [x[ranked] for x in held]
        first = np.searchsorted(held[0], everyone)
        nth = np.arange(len(held[0])) - first[held[0]]
        full = nth == k - 1
        bound[held[0][full]] = np.minimum(reach[held[0][full]], _distance(held[2][full], most))
        held = [x[nth < k + 4] for x in held]
    return held[0], held[1], _distance(held[2], most)


def _distance(product: np.ndarray, most: float) -> np.ndarray:
    """Squared distance of a lifted candidate from a query at norm 1, from their inner product."""
    return np.maximum(2 - 2 * (product / most), 0.0)


def neighbours(table: DataFrame, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose vec_id is divisible by ``every``."""
    return search(table, table.where(F.col("vec_id") % every == 0))
