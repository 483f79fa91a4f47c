"""Packed tree ensembles: node tables of a whole ensemble, and a pipeline stage that scores Arrow batches with them.

All trees stand one after another in breadth-first order, a right child right behind its left sibling. The rows of a batch move
down one level at a time, all at once. Values are compared as ranks among the ensemble's own thresholds, which gives the same
answers as comparing the values, on one or two bytes instead of eight.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.session import scratch_path

#: Rows that move through one tree together: their positions stay in the cache.
ROWS = 4096


class Ensemble:
    """``roots`` and, per node, ``feature`` (-1 for a leaf), ``threshold`` and ``child`` (the left one); ``values`` has a row per node.

    ``link`` says what the sum of the reached values is: ``mean`` a sum of class shares, ``softmax`` margins of all classes, ``logistic``
    the margin of the second class.
    """

    def __init__(self, roots: np.ndarray, feature: np.ndarray, threshold: np.ndarray, child: np.ndarray, values: np.ndarray, link: str):
        self.roots, self.feature, self.threshold, self.child, self.values, self.link = roots, feature, threshold, child, values, link
        self._prepare()

    def _prepare(self) -> None:
        inner = self.feature >= 0
        self.n_features = int(self.feature.max(initial=-1)) + 1
        self.cuts = [np.unique(self.threshold[inner & (self.feature == f)]) for f in range(self.n_features)]
        n = len(self.feature)
        most = max(map(len, self.cuts), default=0)
        rank = np.zeros(n, np.uint8 if most < 255 else np.uint16 if most < 65_535 else np.int64)
        for f, cuts in enumerate(self.cuts):
            own = inner & (self.feature == f)
            rank[own] = np.searchsorted(cuts, self.threshold[own])
        rank[~inner] = np.iinfo(rank.dtype).max  # a leaf sends its rows to itself
        self.rank = rank
        self.next = np.where(inner, self.child, np.arange(n)).astype(np.int64)
        self.row_of = np.where(inner, self.feature, 0).astype(np.int64)
        ends = np.append(self.roots[1:], n)
        self.depths = []
        for root, end in zip(self.roots, ends):
            level, depth = np.array([root]), 0
            while len(level := level[inner[level]]):
                level, depth = np.concatenate([self.child[level], self.child[level] + 1]), depth + 1
            self.depths.append(depth)
        # A tree of one class has one value a node, which is cheaper to add than a row of zeros.
        filled = self.values != 0
        self.single = [int(filled[r:e].any(axis=0).argmax()) if filled[r:e].any(axis=0).sum() <= 1 else -1 for r, e in zip(self.roots, ends)]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum of the values that each row of ``x`` reaches."""
        out = np.zeros((len(x), self.values.shape[1]))
        for start in range(0, len(x), ROWS):
            part = x[start:start + ROWS]
            n, total = len(part), out[start:start + ROWS]
            codes = np.zeros((max(self.n_features, 1), n), self.rank.dtype)
            for f, cuts in enumerate(self.cuts):
                codes[f] = np.searchsorted(cuts, part[:, f])
            flat, rows, base = codes.ravel(), np.arange(n), self.row_of * n
            for root, depth, single in zip(self.roots, self.depths, self.single):
                at = np.full(n, root, np.int64)
                for _ in range(depth):
                    right = flat.take(base.take(at) + rows) > self.rank.take(at)
                    at = self.next.take(at) + right
                if single >= 0:
                    total[:, single] += self.values[:, single].take(at)
                else:
                    total += self.values.take(at, axis=0)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        total = self.sums(x)
        if self.link == "mean":
            return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
        if self.link == "logistic":
            p = 1 / (1 + np.exp(-np.clip(total[:, :1], -700, 700)))
            return np.hstack([1 - p, p])
        e = np.exp(total - total.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def dumps(self) -> str:
        file = io.BytesIO()
        np.savez_compressed(file, roots=self.roots, feature=self.feature, threshold=self.threshold, child=self.child, values=self.values, link=np.array(self.link))
        return base64.b64encode(file.getvalue()).decode()

    @classmethod
    def loads(cls, text: str) -> "Ensemble":
        arrays = np.load(io.BytesIO(base64.b64decode(text)))
        return cls(*[arrays[c] for c in ("roots", "feature", "threshold", "child", "values")], str(arrays["link"]))


def from_nodes(trees: Sequence[dict[int, tuple]], link: str, width: int) -> Ensemble:
    """Pack trees given as {id: (feature or -1, threshold, left id, right id, values)} with root 0."""
    roots, feature, threshold, child, values = [], [], [], [], []
    for nodes in trees:
        first = len(feature)
        roots.append(first)
        queue = [0]
        for own in queue:  # grows while it is read: breadth first
            f, t, left, right, value = nodes[own]
            feature.append(f)
            threshold.append(t if f >= 0 else 0.0)
            child.append(first + len(queue) if f >= 0 else 0)
            values.append(value)
            if f >= 0:
                queue += [left, right]
    return Ensemble(np.array(roots, np.int64), np.array(feature, np.int16), np.array(threshold, float), np.array(child, np.int64),
                    np.array(values, float).reshape(len(feature), width), link)


class PackedTrees(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A pipeline stage that adds ``_probability``, an array with a value for each class."""

    ensemble = Param(Params._dummy(), "ensemble", "packed node tables", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "feature columns in order", TypeConverters.toListString)
    importance = Param(Params._dummy(), "importance", "importance of each feature", TypeConverters.toListFloat)

    @classmethod
    def of(cls, ensemble: Ensemble, features: Sequence[str], importance: Sequence[float]) -> "PackedTrees":
        stage = cls()
        stage._set(ensemble=ensemble.dumps(), features=list(features), importance=[float(v) for v in importance])
        return stage

    def trees(self) -> Ensemble:
        return Ensemble.loads(self.getOrDefault(self.ensemble))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_probabilities(dataset, self.trees(), self.getOrDefault(self.features))


def with_probabilities(df: DataFrame, ensemble: Ensemble, features: Sequence[str]) -> DataFrame:
    """``df`` and the array ``_probability``; rows pass through as they are, in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(ensemble)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.column("_x").flatten()], axis=1) if len(batch) else np.zeros((0, len(features)))
            p = own.probabilities(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.column("_row").flatten(), lists], names=[*names, "_probability"])

    staged = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.struct(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]).alias("_x"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return staged.mapInArrow(run, f"{fields}, _probability array<double>")


_PACKED: dict[str, Ensemble] = {}


def packed_forest(model: RandomForestClassificationModel, spark) -> Ensemble:
    """The node tables of a fitted forest, read from its stored form; every leaf holds its class shares, as the forest's vote has them."""
    if model.uid not in _PACKED:
        path = scratch_path(spark, "forest")
        model.write().save(path)
        rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
            "treeID", "id", "impurityStats", "leftChild", "rightChild", F.col("split.featureIndex").alias("f"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("t")).toArrow()
        trees: dict[int, dict] = {}
        for tree, own, stats, left, right, f, t in zip(*[rows.column(c).to_pylist() for c in rows.column_names]):
            total = sum(stats)
            trees.setdefault(tree, {})[own] = (f if left >= 0 else -1, t if left >= 0 else 0.0, left, right, [s / total if total and left < 0 else 0.0 for s in stats])
        _PACKED[model.uid] = from_nodes([trees[k] for k in sorted(trees)], "mean", model.numClasses)
    return _PACKED[model.uid]
