"""Isolation forest (Liu, Ting and Zhou, 2008): bounded samples by key hash, trees grown on the executors, scores on the JVM.

A tree is held in heap order: node 1 is the root, the children of node i are 2i (at most the cut) and 2i + 1. All that is drawn comes from
md5 of the seed and a name, so any SQL engine can grow the same forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import exact_quantiles

EULER = 0.5772156649015329
# Number of values a draw for a sample can take: the largest prime below 2^52.
SPACE = (1 << 52) - 47
# Rows that are walked down all trees at once where scores are made in batches.
WALKED = 512


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def node_draw(seed: int, *name: object) -> float:
    """The number in [0, 1) that ``functions.draws.draw`` gives for the name."""
    text = ":".join(str(x) for x in (seed, *name))
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / float(1 << 52)


def grow_tree(points: np.ndarray, seed: int, tree: int, depth_limit: int) -> list[tuple]:
    """Nodes as (node, feature, cut, path); a leaf has feature -1, and its path counts its depth and its rows."""
    nodes: list[tuple] = []
    todo = [(1, 0, points)]
    while todo:
        node, depth, rows = todo.pop()
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= depth_limit or len(spread) == 0:
            nodes.append((node, -1, 0.0, depth + float(average_path(len(rows)))))
            continue
        feature = int(spread[int(node_draw(seed, tree, node, "feature") * len(spread))])
        low, high = float(rows[:, feature].min()), float(rows[:, feature].max())
        cut = low + node_draw(seed, tree, node, "cut") * (high - low)
        if not cut < high:
            cut = low
        nodes.append((node, feature, cut, 0.0))
        left = rows[:, feature] <= cut
        todo += [(2 * node, depth + 1, rows[left]), (2 * node + 1, depth + 1, rows[~left])]
    return nodes


def path_lengths(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    """Path length of each point in one tree, node by node."""
    known = {n[0]: n for n in nodes}
    out = np.zeros(len(points))
    for i, p in enumerate(points):
        node = known[1]
        while node[1] >= 0:
            node = known[2 * node[0] + (0 if p[node[1]] <= node[2] else 1)]
        out[i] = node[3]
    return out


def total_paths(model: list[list[tuple]], size: int) -> tuple[np.ndarray, ...]:
    """The trees as flat arrays, ``size`` places a tree: root, feature, cut, path, and the two places that follow (right, left); a leaf is followed by itself."""
    feature, cut, path = np.full(len(model) * size, -1), np.zeros(len(model) * size), np.zeros(len(model) * size)
    child = np.repeat(np.arange(len(model) * size), 2)
    for tree, nodes in enumerate(model):
        for node, f, c, p in nodes:
            at = tree * size + node
            feature[at], cut[at], path[at] = f, c, p
            if f >= 0:
                child[2 * at : 2 * at + 2] = tree * size + 2 * node + 1, tree * size + 2 * node
    return np.arange(len(model)) * size + 1, feature, cut, path, child


def walked(points: pa.Array, trees: tuple[np.ndarray, ...], depth: int) -> pa.Array:
    """The sum of the path lengths of each vector over the trees, first tree first; null for a null vector. What a vector hasn't goes right, as NaN does."""
    root, feature, cut, path, child = trees
    lengths = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = points.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    width = max(int(feature.max(initial=0)) + 1, int(lengths.max(initial=0)))
    if (lengths == width).all():
        x = values.reshape(len(points), width)
    else:
        x = np.full((len(points), width), np.nan)
        x[np.arange(width)[None, :] < lengths[:, None]] = values
    total = np.zeros(len(points))
    slot = np.maximum(feature, 0)
    for start in range(0, len(points), WALKED):
        here = x[start : start + WALKED]
        first, flat = np.arange(len(here)) * width, here.ravel()
        at = np.repeat(root[:, None], len(here), axis=1)
        for _ in range(depth):
            at = child.take(2 * at + (flat.take(first + slot.take(at)) <= cut.take(at)))
        for tree in path.take(at):
            total[start : start + WALKED] += tree
    return pa.array(total, mask=points.is_null().to_numpy(zero_copy_only=False))


@dataclass
class IsolationForest:
    """Trees over samples of the rows; the model is ``trees`` times at most ``2 * sample`` nodes.

    A row's place in a tree's sample depends only on a hash of its key, the tree and
    the seed, so a fit can be repeated. Each tree grows in its own group of at most
    ``sample`` rows. Rows without a vector are not fitted and have no score.
    """

    trees: int = 100
    sample: int = 256
    seed: int = 42
    model: list[list[tuple]] = field(default_factory=list)
    fitted: int = 0

    @property
    def depth_limit(self) -> int:
        return int(np.ceil(np.log2(max(self.sample, 2))))

    def fit(self, df: DataFrame, key: str, vector: str) -> IsolationForest:
        """Sample rows of a table that holds the vectors and grow the trees."""
        return self.grow(self.sample_rows(df.filter(F.col(vector).isNotNull()), key), vector)

    def draws(self, key: str) -> Column:
        """Two numbers a and b of a row, from one hash of its key, as an array of one struct. Its number for a tree is ``draw(a, b, tree)``, independent for any two trees."""
        name = F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.col(key).cast("string")))
        part = lambda at: F.conv(F.substring(name, at, 13), 16, 10).cast("long")
        return F.array(F.struct(part(1).alias("_a"), part(14).alias("_b")))

    @staticmethod
    def draw(tree: Column) -> Column:
        """The number below ``SPACE`` of a row with ``_a`` and ``_b``."""
        return F.pmod(F.col("_a") + tree * F.col("_b"), F.lit(SPACE))

    def sample_rows(self, df: DataFrame, key: str, n: int | None = None) -> DataFrame:
        """Rows of each tree's sample: the columns of ``df`` plus ``tree`` and ``_rank``.

        Every tree draws for itself, by one rule at every size: about four times the
        sample passes a hash test inside the scan, then the tree keeps the lowest
        draws. A row may be in several samples.
        """
        n = df.count() if n is None else n
        self.fitted = min(self.sample, n)
        wide = 4 * self.sample
        limit = SPACE if n <= wide else SPACE * wide // n
        # Exploded, so that the hash is taken once a row; most rows of a large table are in no sample, which one compiled test tells.
        drawn = df.select("*", F.inline(self.draws(key)))
        if limit < SPACE:
            least = [self.draw(F.lit(t)) for t in range(self.trees)]
            drawn = drawn.filter((F.least(*least) if len(least) > 1 else least[0]) < limit)
        number = F.sequence(F.lit(0), F.lit(self.trees - 1))
        each = F.transform(number, lambda t: F.struct(t.alias("tree"), self.draw(t).alias("_draw")))
        drawn = drawn.select(*df.columns, F.inline(F.filter(each, lambda s: s["_draw"] < limit)))
        lowest = Window.partitionBy("tree").orderBy("_draw", key)
        ranked = drawn.withColumn("_rank", F.row_number().over(lowest))
        return ranked.filter(F.col("_rank") <= self.sample).drop("_draw")

    def grow(self, chosen: DataFrame, vector: str) -> IsolationForest:
        """Grow each tree from its sample rows, one group per tree."""
        chosen = chosen.select("tree", F.col(vector).cast("array<double>").alias("_x"))
        depth_limit, seed = self.depth_limit, self.seed

        def grow(group: pd.DataFrame) -> pd.DataFrame:
            tree = int(group["tree"].iloc[0])
            nodes = grow_tree(np.vstack(group["_x"].to_numpy()).astype(float), seed, tree, depth_limit)
            return pd.DataFrame(nodes, columns=["node", "feature", "cut", "path"]).assign(tree=tree)[["tree", "node", "feature", "cut", "path"]]

        nodes = chosen.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, path double").collect()
        by_tree: dict[int, list[tuple]] = {}
        for r in sorted(nodes):
            by_tree.setdefault(r["tree"], []).append((r["node"], r["feature"], r["cut"], r["path"]))
        self.model = list(by_tree.values())
        return self

    def _arrays(self, df: DataFrame) -> Column:
        """The trees as one value: an array of structs of arrays, each with a place for every node of a full tree."""
        size = 2 ** (self.depth_limit + 1)
        rows = []
        for i, nodes in enumerate(self.model):
            feature, cut, path = [-1] * size, [0.0] * size, [0.0] * size
            for node, f, c, p in nodes:
                feature[node], cut[node], path[node] = f, c, p
            rows.append((i, feature, cut, path))
        table = df.sparkSession.createDataFrame(rows, "tree int, feature array<int>, cut array<double>, path array<double>")
        return table.agg(F.array_sort(F.collect_list(F.struct("tree", "feature", "cut", "path")))).scalar()

    def score(self, df: DataFrame, vector: str, out: str = "anomaly_score", batches: bool = False) -> DataFrame:
        """Add 2^(-mean path / c(sample)): higher is more anomalous. Null for a null vector or an empty forest.

        One expression of built-in functions: a walk of at most ``depth_limit`` steps in each tree. It is interpreted, so ``batches`` walks
        in Arrow batches instead, for vectors that a Python worker makes anyway; the scores are the same.
        """
        if not self.model:
            return df.withColumn(out, F.lit(None).cast("double"))
        norm = max(float(average_path(self.fitted)), 1e-12)
        if batches:
            return df.withColumn(out, self._score_of(self._walk(df)(F.col(vector)), norm))
        x = F.col(vector).cast("array<double>")
        steps = F.sequence(F.lit(1), F.lit(self.depth_limit))

        def step(tree: Column, at: Column) -> Column:
            feature = F.get(tree["feature"], at)
            down = F.when(F.get(x, feature) <= F.get(tree["cut"], at), 2 * at).otherwise(2 * at + 1)
            return F.when(feature < 0, at).otherwise(down)

        def walk(tree: Column) -> Column:
            return F.get(tree["path"], F.aggregate(steps, F.lit(1), lambda at, _: step(tree, at)))

        total = F.aggregate(F.transform("_trees", walk), F.lit(0.0), lambda s, p: s + p)
        score = F.when(F.col(vector).isNotNull(), self._score_of(total, norm))
        return df.withColumn("_trees", self._arrays(df)).withColumn(out, score).drop("_trees")

    def _score_of(self, total: Column, norm: float) -> Column:
        return F.pow(F.lit(2.0), -(total / F.lit(float(len(self.model)))) / F.lit(norm))

    def _walk(self, df: DataFrame):
        depth = self.depth_limit
        trees = df.sparkSession.sparkContext.broadcast(total_paths(self.model, 2 ** (depth + 1)))

        @F.arrow_udf("double")
        def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for points in batches:
                yield walked(points, trees.value, depth)

        return walk

    @staticmethod
    def flag(df: DataFrame, score: str, contamination: float, out: str = "if_flag") -> DataFrame:
        """Flag scores above the exact (1 - contamination) quantile.

        The scores are read three times; pass stored ones (`cut_lineage`).
        """
        cut = exact_quantiles(df, score, [1.0 - contamination]).select("quantile").scalar()
        return df.withColumn(out, F.coalesce(F.col(score) > cut, F.lit(False)))
