"""Gradient-boosted trees over histograms, for all classes and all folds at once.

Features are binned once, and rows stand in blocks of a thousand, so that a level moves buffers and not rows. Some blocks together are one
element of an RDD of arrays: a level has next to nothing to plan, and Python reads the arrays as they were kept. They
carry their rows' margins in every fit, one fit without each fold and one with all rows, so a fold's out-of-fold prediction is what its
rows' margins say in the fit without them. A level of all trees of a round takes one job: tasks sum
gradients per (tree, node, feature, bin), a shuffle by (tree, node) adds the tasks' sums and picks the best split, and only
the splits reach the driver. After a round, rows walk its trees and update their margins.

With many rows a task, only one child of every split is summed, and the other is its parent less that child. The margins, most of a row's
bytes, then stay in files on the local disk of the executor that made them; what is not there is made anew from the trees so far.

The objective is the softmax over all classes with one tree a class and round (with two classes, the logistic and one tree), with
second-order splits and leaves. Rows and columns are sampled for each tree by hashes, so a retried task draws the same.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerloom.functions import scalars as S
from fingerloom.operators.trees import Ensemble, PackedTrees, from_nodes
from fingerloom.session import discard, discard_path, materialized

#: Rounds between two checkpoints of the margins; between them the rows' state is kept in memory and recomputed if lost.
WRITE_EVERY = 5
TASK_ROWS = 4000
#: Rows of a block; blocks that are worked on together; the most rows of a task, some 100 MB with five folds and eight classes.
BLOCK_ROWS, BLOCKS, MOST_TASK_ROWS = 1000, 50, 250_000
#: Rows of a task from which on margins stay in local files, and a shuffle of the parents' sums costs less than summing both children.
LARGE_TASK_ROWS = 50_000
#: Rows for each cell of two features' joint bins from which on one pass for both costs less than two.
PAIR_ROWS = 2
_ACCURACY = 10_000
#: Rows reach the Java side as bytes, which need not be serialised once more.
_KEPT = StorageLevel.MEMORY_AND_DISK_DESER


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    ridge: float = 1.0
    min_weight: float = 1.0
    min_gain: float = 1e-6
    bins: int = 64
    seed: int = 42


def _mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def drawn(keys: np.ndarray, round_: int, tree: int, settings: Settings) -> np.ndarray:
    """Which rows a class's tree of a round sees, by the rows' keys."""
    salt = (settings.seed * 1_000_003 + round_) * 1_009 + tree
    u = _mix(keys.view(np.uint64) ^ _mix(np.array([salt], np.int64).view(np.uint64)))
    return (u >> np.uint64(11)).astype(float) * 2.0**-53 < settings.row_share


def drawn_columns(n: int, round_: int, tree: int, settings: Settings) -> np.ndarray:
    """Which columns a class's tree of a round may split."""
    rng = np.random.default_rng([settings.seed, round_, tree])
    out = np.zeros(n, bool)
    out[rng.permutation(n)[:max(1, round(settings.column_share * n))]] = True
    return out


def gradients(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss for margins (rows, trees of a round)."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins))
        return p - labels[:, None], np.maximum(p * (1 - p), 1e-16)
    p = np.array(margins.T, order="C")  # a class at a time: numpy is slow along short rows
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    h = 1 - p
    h *= p
    h *= 2
    p[labels, np.arange(len(labels))] -= 1
    return p.T, np.maximum(h, 1e-16, out=h).T


class Round:
    """The trees of one round as complete binary trees: child of i at 2i + 1 and 2i + 2; feature -1 is a leaf."""

    def __init__(self, trees: int, depth: int):
        size = (1 << (depth + 1)) - 1
        self.feature, self.bin = np.full((trees, size), -1, np.int16), np.zeros((trees, size), np.uint8)
        self.value, self.gain = np.zeros((trees, size)), np.zeros((trees, size))

    def rows_of(self, tree: int, bins: np.ndarray, seen: np.ndarray, wanted: list[int]) -> list[np.ndarray]:
        """The rows of ``bins`` (features, rows) that are ``seen`` and reach each of the ``wanted`` nodes, none of which is below another."""
        needed = set(wanted)
        for node in wanted:
            while node:
                node = (node - 1) // 2
                needed.add(node)
        found, ends, open_ = {}, set(wanted), [(0, seen)]
        while open_:
            node, inside = open_.pop()
            if node in ends:
                found[node] = np.flatnonzero(inside)
                continue
            right = bins[self.feature[tree, node]] > self.bin[tree, node]
            if 2 * node + 1 in needed:
                open_.append((2 * node + 1, inside > right))  # inside and not right
            if 2 * node + 2 in needed:
                open_.append((2 * node + 2, inside & right))
        return [found[node] for node in wanted]

    def reached(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The values of the leaves that the rows of ``bins`` reach. A row's turns, a bit a level, are the place of its leaf."""
        depth = (self.feature.shape[1] + 1).bit_length() - 2
        turns, values = [None] * depth, np.zeros(1 << depth)
        open_ = [(0, 0, 0, None)]
        while open_:
            node, level, place, inside = open_.pop()
            if self.feature[tree, node] < 0:
                values[place] = self.value[tree, node]
                continue
            right = bins[self.feature[tree, node]] > self.bin[tree, node]
            left = ~right if inside is None else inside > right
            if inside is not None:
                right &= inside
            turns[level] = right.copy() if turns[level] is None else np.logical_or(turns[level], right, out=turns[level])
            open_ += [(2 * node + 1, level + 1, place, left), (2 * node + 2, level + 1, place | 1 << level, right)]
        at = np.zeros(bins.shape[1], np.intp if depth > 8 else np.uint8)
        for level, turned in enumerate(turns):
            if turned is not None:
                at |= turned.astype(at.dtype) << at.dtype.type(level)
        return values.take(at)


def best_split(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, settings: Settings) -> tuple[int, int, float, float, float, float, float]:
    """(feature or -1, bin, gain, left and right sums) of a node's sums (features, bins); the first of equal splits."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    total_g, total_h = g[0].sum(), h[0].sum()
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g**2 / (left_h + settings.ridge) + right_g**2 / (right_h + settings.ridge) - total_g**2 / (total_h + settings.ridge)
    fits = (left_h >= settings.min_weight) & (right_h >= settings.min_weight) & allowed[:, None]
    gain = np.where(fits, gain, -np.inf)
    # Equal splits differ by rounding alone, so the first of those within it is taken.
    best = int((gain >= gain.max() - 1e-9 * max(1.0, abs(gain.max()))).argmax()) if np.isfinite(gain.max()) else 0
    f, b = divmod(best, gain.shape[1])
    if not gain[f, b] > settings.min_gain:
        return -1, 0, 0.0, float(total_g), float(total_h), 0.0, 0.0
    return f, b, float(gain[f, b]), float(left_g[f, b]), float(left_h[f, b]), float(right_g[f, b]), float(right_h[f, b])


@dataclass(frozen=True)
class _State:
    """What a level's tasks need: the cuts of the round's trees so far, and the nodes of each tree whose rows are summed.

    ``number`` has the group of each of those nodes; the groups' parents are at hand if ``differences``.
    """

    round: int
    level: int
    trees: Round
    wanted: list[list[int]]
    number: dict[tuple[int, int], int]
    folds: list[int]
    per_round: int
    settings: Settings
    sizes: list[int]
    differences: bool
    files: _Files | None

    def columns(self, tree: int) -> np.ndarray:
        return np.flatnonzero(drawn_columns(len(self.sizes), self.round, tree % self.per_round, self.settings))


@dataclass(frozen=True)
class _Rows:
    """The keys, folds, labels, bins (features, rows) and margins (trees, rows) of some rows.

    ``scale`` (fits, 2, rows) has the largest margin of a fit's classes and the sum of their exponentials above it.
    """

    key: np.ndarray
    fold: np.ndarray
    label: np.ndarray
    bins: np.ndarray
    margins: np.ndarray
    scale: np.ndarray

    def slopes(self, tree: int, per_round: int, own: np.ndarray) -> np.ndarray:
        """:func:`gradients` of a tree for the rows ``own``, both derivatives side by side, so that one pass adds both."""
        out = np.empty(len(own), complex)
        p, labels = self.margins[tree].take(own), self.label.take(own)
        if per_round == 1:
            p = 1 / (1 + np.exp(-p))
            out.real, out.imag = p - labels, np.maximum(p * (1 - p), 1e-16)
            return out
        top, total = self.scale[tree // per_round]
        p -= top.take(own)
        np.exp(p, out=p)
        p /= total.take(own)
        h = 1 - p
        h *= p
        h *= 2
        out.real, out.imag = p - (labels == tree % per_round), np.maximum(h, 1e-16, out=h)
        return out


def _scale(margins: np.ndarray, per_round: int) -> np.ndarray:
    """What turns the margins (trees, rows) of each fit into probabilities; nothing for two classes."""
    if per_round == 1:
        return np.zeros((0, 2, margins.shape[1]))
    out = np.empty((len(margins) // per_round, 2, margins.shape[1]))
    for own, (top, total) in zip(margins.reshape(-1, per_round, margins.shape[1]), out):
        np.max(own, axis=0, out=top)
        p = own - top
        np.sum(np.exp(p, out=p), axis=0, out=total)
    return out


@dataclass(frozen=True)
class _Files:
    """The margins of large data: a file for some rows and the rounds so far, on the disk of the executor that made it.

    A file goes by a digest of its rows' bins, which with the trees say all about the margins, so a task that finds none of its rows, or
    others, makes its own.
    """

    name: str
    rounds: tuple[Broadcast, ...]
    trees: int
    per_round: int

    def folders(self) -> list[str]:
        return [f"{path}/boosting-{self.name}" for path in os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")]

    def loaded(self, rows: _Rows) -> _Rows:
        """The rows with their margins."""
        n, fits = len(rows.key), 0 if self.per_round == 1 else self.trees // self.per_round
        digest = hashlib.blake2b(rows.bins, digest_size=16).hexdigest()
        folder = (folders := self.folders())[int(digest[:8], 16) % len(folders)]
        at, found = len(self.rounds), None
        for at in range(len(self.rounds), -1, -1):
            try:
                found = np.memmap(f"{folder}/{digest}-{at}", float, "r", shape=(self.trees + 2 * fits, n))
                break
            except (FileNotFoundError, ValueError):
                continue
        if found is None or at < len(self.rounds):
            margins = np.zeros((self.trees, n)) if found is None else np.array(found[:self.trees])
            for grown in self.rounds[at:]:
                for tree, margin in enumerate(margins):
                    margin += grown.value.reached(tree, rows.bins)
            made = f"{folder}/{digest}-{len(self.rounds)}"
            found, old = np.concatenate([margins, _scale(margins, self.per_round).reshape(2 * fits, n)]), found
            os.makedirs(folder, exist_ok=True)
            found.tofile(own := f"{made}-{uuid.uuid4().hex}")
            os.replace(own, made)  # whole or not at all
            if old is not None:
                try:
                    os.remove(f"{folder}/{digest}-{at}")
                except FileNotFoundError:  # a second attempt of the task
                    pass
        return replace(rows, margins=np.asarray(found[:self.trees]), scale=np.asarray(found[self.trees:]).reshape(fits, 2, n))

    def remove(self, _: Iterator) -> None:
        for folder in self.folders():
            shutil.rmtree(folder, ignore_errors=True)


def _arrays(trees: int, per_round: int, blocks: Iterator) -> Iterator[_Rows]:
    """A few blocks at a time, with margins of zero."""
    for some in batched(blocks, BLOCKS):
        flat = lambda c, kind: [np.frombuffer(b[c], kind) for b in some]  # noqa: B023, E731
        keys = flat("key", np.int64)
        bins = np.concatenate([v.reshape(-1, len(own)) for v, own in zip(flat("bins", np.uint8), keys)], axis=1)
        key, margins = np.concatenate(keys), np.zeros((trees, bins.shape[1]))
        yield _Rows(key, np.concatenate(flat("fold", np.int32)), np.concatenate(flat("label", np.int32)), bins, margins, _scale(margins, per_round))


def _values(arrays) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _sums(state: _State, part: int, parts: Iterator[_Rows]) -> Iterator[tuple]:
    """Gradient sums of the wanted nodes over a task's rows: ((group of the node, part), (tree, node, sums))."""
    k, held = state.per_round, {}
    for rows in parts if state.files is None else map(state.files.loaded, parts):
        codes = {(f,): own.astype(np.intp) for f, own in enumerate(rows.bins)}  # once for all trees
        others = {fold: rows.fold != fold for fold in state.folds}
        for c in range(k):
            fits = [f for f in range(len(state.folds)) if state.wanted[f * k + c]]
            if not fits:
                continue
            seen, columns = drawn(rows.key, state.round, c, state.settings), state.columns(c)  # the same for all fits
            for f in fits:
                tree = f * k + c
                nodes = state.trees.rows_of(tree, rows.bins, seen & others[state.folds[f]], state.wanted[tree])
                own, place = np.concatenate(nodes), np.repeat(np.arange(len(nodes)), list(map(len, nodes)))
                if tree not in held:
                    held[tree] = np.zeros((len(columns), len(nodes), state.settings.bins), complex)
                _add(held[tree], columns, codes, state.sizes, own, place, rows.slopes(tree, k, own))
            codes = {names: own for names, own in codes.items() if len(names) == 1}
    for tree, total in held.items():
        for i, node in enumerate(state.wanted[tree]):
            yield (state.number[tree, node], part), (tree, node, np.stack([total[:, i].real, total[:, i].imag]))


def _add(total: np.ndarray, columns: np.ndarray, codes: dict, sizes: list[int], own: np.ndarray, place: np.ndarray, values: np.ndarray) -> None:
    """Add the values of the rows ``own`` to ``total`` (columns, nodes, bins), by their node's ``place`` and their bins.

    A feature at a time, or two at a time by their joint bins, if there are rows enough: what a pass touches stays in the cache.
    """
    nodes, number = total.shape[1], 0
    at = lambda place, size, code: code.take(own) if nodes == 1 else place * size + code.take(own)
    for names in batched(columns.tolist(), 2):
        shape = [sizes[f] for f in names]
        if len(names) == 2 and len(own) >= PAIR_ROWS * nodes * shape[0] * shape[1]:
            if names not in codes:
                codes[names] = codes[names[:1]] * shape[1] + codes[names[1:]]
            joint = np.zeros((nodes, *shape), complex)
            np.add.at(joint.reshape(-1), at(place, shape[0] * shape[1], codes[names]), values)
            total[number, :, :shape[0]] += joint.sum(axis=2)
            total[number + 1, :, :shape[1]] += joint.sum(axis=1)
        else:
            for i, f in enumerate(names):
                np.add.at(total[number + i].reshape(-1), at(place, total.shape[2], codes[f,]), values)
        number += len(names)


def _splits(state: _State, sums: Iterator[tuple]) -> Iterator[tuple]:
    """The best split of each node and its sums. A group's sums come one after another in the order of their tasks, their parent's first."""
    for _, own in groupby(sums, lambda pair: pair[0][0]):
        _, (tree, node, total) = next(own)
        parent = None
        if state.differences:
            parent, (_, (_, node, total)) = total, next(own)
        for _, (_, _, more) in own:
            total = total + more
        columns = state.columns(tree)
        every = np.ones(len(columns), bool)
        for at, found in ((node, total),) if parent is None else ((node, total), (node + 1 if node % 2 else node - 1, parent - total)):
            f, *split = best_split(*found, every, state.settings)
            yield tree, at, int(columns[f]) if f >= 0 else -1, *split, found


def _parents(number: dict[tuple[int, int], int], done: tuple) -> Iterator[tuple]:
    """The sums of a node that was split, as the first of its children's group."""
    tree, node, *_, total = done
    for child in (2 * node + 1, 2 * node + 2):
        if (tree, child) in number:
            yield (number[tree, child], -1), (tree, node, total)


_BLOCK = T.StructType([T.StructField(n, T.BinaryType()) for n in ("key", "fold", "label", "bins", "margins")])


def _moved(trees: Round, per_round: int, rows: _Rows) -> _Rows:
    """The rows with the values of a round's trees added to their margins."""
    margins = np.stack([margin + trees.reached(t, rows.bins) for t, margin in enumerate(rows.margins)])
    return replace(rows, margins=margins, scale=_scale(margins, per_round))


def _binned(df: DataFrame, cuts: list[np.ndarray], trees: int, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` rows, with margins of zero."""
    shared = df.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            numbers = [batch.column(c).to_numpy().astype(kind) for c, kind in (("key", np.int64), ("fold", np.int32), ("label", np.int32))]
            bins = np.stack([np.searchsorted(c, v.to_numpy(zero_copy_only=False)) for c, v in zip(shared.value, batch.column("x").flatten())]).astype(np.uint8)
            for a in range(0, n, rows):
                block = [c[a:a + rows] for c in numbers], bins[:, a:a + rows], np.zeros((trees, min(rows, n - a)))
                yield pa.RecordBatch.from_arrays([_values([c]) for c in (*block[0], *block[1:])], names=_BLOCK.names)
    return df.mapInArrow(run, _BLOCK)


def feature_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 inner cuts of every feature, at its quantiles; a row goes left of a cut it equals."""
    levels = ", ".join(S.number((i + 1) / bins) for i in range(bins - 1))
    row = df.selectExpr(*[f"double(`{c}`) AS x{i}" for i, c in enumerate(features)]).selectExpr(
        *[f"percentile_approx(x{i}, array({levels}), {_ACCURACY}) AS q{i}" for i in range(len(features))], *[f"max(x{i}) AS m{i}" for i in range(len(features))]).first()
    out = []
    for i in range(len(features)):
        cuts = np.unique(np.array(row[f"q{i}"] if row[f"q{i}"] is not None else [], float))
        out.append(cuts[cuts < row[f"m{i}"]] if len(cuts) else cuts)  # a cut at the largest value parts nothing
    return out


@dataclass(frozen=True)
class Boosted:
    """The fit to all rows, and the out-of-fold probabilities of each row by its key, if there are folds."""

    model: PackedTrees
    out_of_fold: DataFrame | None


def fit(df: DataFrame, classes: Sequence[str], *, label: str, features: Sequence[str], key: str | None = None, fold: str | None = None, folds: int = 0,
        settings: Settings = Settings()) -> Boosted:
    """Boost on ``df``; with ``folds``, also without the rows of each fold. ``key`` names rows for the draws; without it their values do.

    ``out_of_fold`` has ``key``, ``label`` and ``prediction``.
    """
    spark = df.sparkSession
    key_column = F.col(f"`{key}`") if key else F.xxhash64(*[F.col(f"`{c}`") for c in features])
    left_out = [-1, *range(folds)]  # nobody's fold is -1
    k = 1 if len(classes) == 2 else len(classes)
    trees = k * len(left_out)
    cuts = feature_cuts(df, features, settings.bins)
    values = F.struct(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    staged = df.select(key_column.alias("key"), (F.col(f"`{fold}`") if fold else F.lit(-2)).cast("int").alias("fold"), S.encode_label(F.col(f"`{label}`"), classes).alias("label"), values.alias("x"))
    n, parallel = df.count(), spark.sparkContext.defaultParallelism
    tasks = max(1, min(parallel, -(-n // TASK_ROWS)))
    if n > tasks * MOST_TASK_ROWS:
        tasks = parallel * -(-n // (parallel * MOST_TASK_ROWS))
    written = materialized(_binned(staged, cuts, trees, max(1, min(BLOCK_ROWS, n // tasks))), "boosting")
    large = tasks > 1 and n >= tasks * LARGE_TASK_ROWS
    rows = _dealt(written.drop("margins"), tasks).rdd.mapPartitions(partial(_arrays, 0 if large else trees, k)).persist(_KEPT)
    sizes = [len(c) + 1 for c in cuts]
    files = _Files(uuid.uuid4().hex, (), trees, k) if large else None
    sample = _some_bins(written, len(features)) if large else None
    before, kept_file = None, None
    rounds: list[Round] = []
    for number in range(settings.rounds):
        grown = _grow(rows, tasks, number, left_out, k, sizes, sample, files, settings)
        rounds.append(grown)
        if files is not None:
            files = replace(files, rounds=(*files.rounds, spark.sparkContext.broadcast(grown)))
            continue
        if before is not None:
            before.unpersist()  # its successor is in memory since the first level
        if rows.isCheckpointed():  # what it was made of is of no more use
            discard_path(spark, kept_file)
            discard(written)
            kept_file = rows.getCheckpointFile()
        if not folds and number == settings.rounds - 1:
            break
        before, rows = rows, rows.map(partial(_moved, grown, k)).persist(_KEPT)
        if number % WRITE_EVERY == WRITE_EVERY - 1:
            rows.checkpoint()  # by the next job over it
    out = None
    if folds:
        out = materialized(_out_of_fold(spark, rows if files is None else rows.map(files.loaded), classes, k), "out-of-fold")
        if rows.isCheckpointed() and rows.getCheckpointFile() != kept_file:
            discard_path(spark, rows.getCheckpointFile())
    if files is not None:
        rows.foreachPartition(files.remove)
        for grown in files.rounds:
            grown.destroy()
    for held in (before, rows):
        if held is not None:
            held.unpersist()
    discard_path(spark, kept_file)
    discard(written)
    return Boosted(_packed(rounds, cuts, k, classes, features, settings), out)


def _dealt(blocks: DataFrame, tasks: int) -> DataFrame:
    """Stored blocks in ``tasks`` parts, so that no part waits for another; files that were read together are parted again."""
    return blocks.repartition(tasks) if blocks.rdd.getNumPartitions() != tasks and tasks > 1 else blocks.coalesce(tasks)


def _some_bins(blocks: DataFrame, n_features: int) -> np.ndarray:
    """The bins of a few stored blocks, by which the children of a split are taken to be large or small."""
    return np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(n_features, -1) for r in blocks.select("bins").take(4)], axis=1)


def _grow(rows: RDD, tasks: int, number: int, left_out: list[int], k: int, sizes: list[int], sample: np.ndarray | None, files: _Files | None, settings: Settings) -> Round:
    """The trees of one round: a job for each level, until no node splits.

    With a ``sample`` of rows, only that child of a split is summed which has the fewer of them; which one that is changes no more than
    the rounding of the sums.
    """
    trees = k * len(left_out)
    grown, open_, wanted, done = Round(trees, settings.depth), [[0] for _ in range(trees)], [[0] for _ in range(trees)], None
    leaf = lambda g, h: -settings.rate * g / (h + settings.ridge)
    for level in range(settings.depth):
        if not any(open_):
            break
        groups = {node: i for i, node in enumerate((tree, node) for tree, own in enumerate(wanted) for node in own)}
        state = _State(number, level, grown, wanted, groups, left_out, k, settings, sizes, done is not None, files)
        sums, before = rows.mapPartitionsWithIndex(partial(_sums, state)), done
        if before is not None:
            sums = sums.union(before.flatMap(partial(_parents, groups)))
        if tasks > 1:  # the sums of an only task are whole, so nothing needs to be dealt out
            sums = sums.repartitionAndSortWithinPartitions(min(tasks, rows.context.defaultParallelism, len(groups)), lambda place: place[0])
        done = sums.mapPartitions(partial(_splits, state))
        if sample is not None and level < settings.depth - 1:
            done.persist(_KEPT)  # the next level takes its sums from these
        found = done.map(lambda row: row[:-1]).collect()
        if before is not None:
            before.unpersist()
        open_ = [[] for _ in range(trees)]
        for tree, node, feature, cut, gain, left_g, left_h, right_g, right_h in sorted(found):
            if feature < 0:
                grown.value[tree, node] = leaf(left_g, left_h)
                continue
            grown.feature[tree, node], grown.bin[tree, node], grown.gain[tree, node] = feature, cut, gain
            grown.value[tree, 2 * node + 1], grown.value[tree, 2 * node + 2] = leaf(left_g, left_h), leaf(right_g, right_h)
            open_[tree] += [2 * node + 1, 2 * node + 2]
        if sample is None:
            wanted, done = open_, None
        else:
            wanted = [_smaller(grown, tree, sample, own) for tree, own in enumerate(open_)]
    if done is not None:
        done.unpersist()
    return grown


def _smaller(grown: Round, tree: int, sample: np.ndarray, children: list[int]) -> list[int]:
    """Of each two siblings the one that fewer rows of the sample reach."""
    reached = list(map(len, grown.rows_of(tree, sample, np.ones(sample.shape[1], bool), children))) if children else []
    return [left if a <= b else right for (left, right), (a, b) in zip(batched(children, 2), batched(reached, 2))]


def _out_of_fold(spark: SparkSession, rows: RDD, classes: Sequence[str], k: int) -> DataFrame:
    """The class that the fit without a row's fold gives it; the first class wins a tie."""
    names = list(classes)

    def best(own: _Rows) -> tuple[bytes, bytes, bytes]:
        margins = own.margins.reshape(-1, k, len(own.key))[own.fold + 1, :, np.arange(len(own.key))]
        found = (margins[:, 0] > 0).astype(np.int32) if k == 1 else margins.argmax(axis=1).astype(np.int32)
        return own.key.tobytes(), own.label.tobytes(), found.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, *codes in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                texts = [pa.array([names[i] for i in np.frombuffer(c, np.int32)], pa.string()) for c in codes]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(key, np.int64)), *texts], names=["key", "label", "prediction"])
    return spark.createDataFrame(rows.map(best), "key binary, label binary, found binary").mapInArrow(run, "key bigint, label string, prediction string")


def _packed(rounds: list[Round], cuts: list[np.ndarray], k: int, classes: Sequence[str], features: Sequence[str], settings: Settings) -> PackedTrees:
    """The fit to all rows as a pipeline stage. A feature's importance is the mean gain of its splits, as a share."""
    trees, gains, splits = [], np.zeros(len(features)), np.zeros(len(features))
    for grown in rounds:
        for c in range(k):
            nodes, queue = {}, [0]
            for i in queue:
                f = int(grown.feature[c, i])
                value = [0.0] * k
                if f < 0:
                    value[c] = float(grown.value[c, i])
                    nodes[i] = (-1, 0.0, 0, 0, value)
                else:
                    nodes[i] = (f, float(cuts[f][grown.bin[c, i]]), 2 * i + 1, 2 * i + 2, value)
                    queue += [2 * i + 1, 2 * i + 2]
                    gains[f] += grown.gain[c, i]
                    splits[f] += 1
            trees.append(nodes)
    mean = np.divide(gains, splits, out=np.zeros_like(gains), where=splits > 0)
    return PackedTrees.of(from_nodes(trees, "logistic" if k == 1 else "softmax", k), features, mean / mean.sum() if mean.sum() else mean)
