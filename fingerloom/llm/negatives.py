"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction. For each cluster the candidates at hand are sorted once by an angular upper bound that holds for every
member: the candidate's norm times the cosine of its angle to the cluster's centre, less the cluster's widest angle. All members walk that one
list in steps, and a member stops where the bound, times its own norm, is below what it still could take: its last positive, or the
least score its open windows need. Angles carry a margin for rounding, and scores are exact integers, so stopping is certified.

Anchors are the query set and come in blocks of ``block`` rows, ordered by cluster; each block is broadcast and walked over all rows, which are
never shuffled. A bounded sample of rows gives every anchor a first threshold, a true lower bound of its last positive, so few candidates leave a
task; those are ranked by a window whose groups are cut before and after the shuffle. The centres are fitted on at most
``sample`` anchors. Both only decide what is skipped, never what is found.

Defined results: rows with a NULL id, label or vector, or with a NULL, non-finite or too large component (2**31 and more) take no part; whole repeated
rows count once; rows that share an id are rows of their own, and only the anchor's own row is not its positive; vectors of another
length than the anchor's do not meet it; ties go to the smaller id, then label and vector; a negative or no positive score has an empty window;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fingerloom.llm.common import bounded_sample
from fingerloom.session import materialized

BLOCK = 20_000
SAMPLE = 10_000
MAX_CLUSTERS = 64
STEP = 1024
#: Rows sorted into one list at a time, and the most anchors that one product of a step takes.
LIST_ROWS = 1 << 15
MEMBERS = 2048
#: Radians that an angle may be wrong by.
MARGIN = 1e-6
LIMIT = 2.0**31
#: Scores below this are exact in doubles.
EXACT = 2.0**52
LEAST = -(1 << 62)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose components are all finite and small enough, as integers."""
    for batch in batches:
        column = batch.column("v")
        offsets = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
        missing = flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        bad = missing | ~np.isfinite(values) | ~(np.abs(values) < LIMIT)
        wrong = np.concatenate([[0], np.cumsum(bad)])
        offsets = offsets - offsets[0]
        good = np.flatnonzero(wrong[offsets[1:]] == wrong[offsets[:-1]])
        values = np.where(bad, 0, values).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)).take(pa.array(good))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(good)), batch.column("label").take(pa.array(good)), lists], names=["id", "label", "v"])


def usable_rows(rows: DataFrame, *, id_column: str, label: str, vector: str) -> DataFrame:
    """(id, label, v): the distinct rows that take part, with whole components."""
    df = rows.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return df.where("id is not null and label is not null and v is not null").mapInArrow(_usable, "id bigint, label bigint, v array<bigint>").distinct()


class Rows(NamedTuple):
    """Rows of one vector length."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # int64, a row each

    @property
    def norms(self) -> np.ndarray:
        return np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1))


def _by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[Rows]:
    column = batch.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in ("id", "label"))
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        yield Rows(ids[own], labels[own], flat[offsets[own][:, None] + np.arange(length)].astype(np.int64).reshape(len(own), int(length)))


def scores(a: Rows, b: Rows) -> np.ndarray:
    """Exact inner products."""
    if not len(a.ids) or not len(b.ids) or not a.vectors.shape[1]:
        return np.zeros((len(a.ids), len(b.ids)), np.int64)
    if a.norms.max() * b.norms.max() < EXACT:
        return (a.vectors.astype(float) @ b.vectors.astype(float).T).astype(np.int64)
    return a.vectors @ b.vectors.T


def centres(anchors: Rows, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centres of directions by spherical k-means."""
    some = anchors.norms > 0
    x = anchors.vectors[some] / anchors.norms[some][:, None]
    k = min(MAX_CLUSTERS, max(1, len(x) // 64))
    if not len(x):
        return np.zeros((1, anchors.vectors.shape[1]))
    found = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ found.T).argmax(axis=1)
        for c in range(k):
            mean = x[own == c].sum(axis=0)
            size = np.linalg.norm(mean)
            if size > 0:
                found[c] = mean / size
    return found


def _angles(rows: Rows, units: np.ndarray) -> np.ndarray:
    norms = rows.norms
    return np.arccos(np.clip(rows.vectors @ units.T / np.where(norms > 0, norms, 1)[:, None], -1, 1))


class Block(NamedTuple):
    """Anchors of one vector length with what each still needs, and their clusters."""

    anchors: Rows
    least: np.ndarray  # a score below this is of no use to the anchor; exact integers
    windows: list | None  # per anchor: (positive id, positive score, low, high); None while positives are looked for
    units: np.ndarray
    cluster: np.ndarray
    widest: np.ndarray

    @classmethod
    def of(cls, anchors: Rows, units: np.ndarray, least: np.ndarray, windows=None) -> "Block":
        angle = _angles(anchors, units)
        cluster = angle.argmin(axis=1)
        widest = np.array([angle[cluster == c, c].max(initial=0.0) for c in range(len(units))])
        return cls(anchors, least, windows, units, cluster, widest)


def _steps(block: Block, rows: Rows, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor numbers, row numbers, scores) of each step of each cluster's shared list; ``least`` may rise meanwhile."""
    angle, norms, own = _angles(rows, block.units), rows.norms, block.anchors.norms
    for c in np.unique(block.cluster):
        members = np.flatnonzero(block.cluster == c)
        bound = norms * np.cos(np.clip(angle[:, c] - block.widest[c] - MARGIN, 0, np.pi))
        order = np.argsort(-bound)
        for at in range(0, len(members), MEMBERS):
            part = members[at:at + MEMBERS]
            for start in range(0, len(order), STEP):
                # Rounding moves a bound by far less than one part in 2**30, and a score is a whole number.
                top = own[part] * bound[order[start]]
                part = part[top + np.abs(top) * 1e-9 + 1e-6 >= least[part].astype(float)]
                if not len(part):
                    break
                listed = order[start:start + STEP]
                yield part, listed, scores(Rows(*(x[part] for x in block.anchors)), Rows(*(x[listed] for x in rows)))


def _top(keys: list[tuple], size: int) -> list[tuple]:
    return sorted(keys)[:size]


def _found_positives(block: Block, rows: Rows, size: int) -> Iterator[tuple[int, int, int, tuple, int]]:
    """(anchor, score, id, ...) candidates of each anchor's first positives: the best ``size`` of this list."""
    least, best = block.least.copy(), [[] for _ in block.anchors.ids]
    for part, listed, values in _steps(block, rows, least):
        a, b = part, listed
        fits = (block.anchors.labels[a][:, None] == rows.labels[b][None, :]) & (values >= least[a][:, None])
        fits &= ~((block.anchors.ids[a][:, None] == rows.ids[b][None, :]) & _equal_rows(block.anchors, a, rows, b))
        i, j = np.nonzero(fits)
        for k in np.unique(i):
            anchor = int(a[k])
            own = j[i == k]
            best[anchor] = _top(best[anchor] + [(-int(values[k, x]), int(rows.ids[b[x]]), rows.vectors[b[x]].tolist()) for x in own], size)
            if len(best[anchor]) == size:
                least[anchor] = max(least[anchor], -best[anchor][-1][0])
    for anchor, own in enumerate(best):
        for minus, id_, vector in own:
            yield anchor, -minus, id_, vector


def _equal_rows(anchors: Rows, a: np.ndarray, rows: Rows, b: np.ndarray) -> np.ndarray:
    """Where an anchor and a row of equal id and label are the same row."""
    out = np.zeros((len(a), len(b)), bool)
    i, j = np.nonzero(anchors.ids[a][:, None] == rows.ids[b][None, :])
    if len(i):
        out[i, j] = (anchors.vectors[a[i]] == rows.vectors[b[j]]).all(axis=1)
    return out


def _found_negatives(block: Block, rows: Rows, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, window, score, id): of each window the best ``size`` rows of another label on this list."""
    best = {(a, w): [] for a, own in enumerate(block.windows) for w in range(len(own))}
    least = block.least.copy()

    def needed(anchor: int) -> int:
        """The least score that one of the anchor's windows has use for."""
        need = [max(low, -best[anchor, w][-1][0]) if len(best[anchor, w]) == size else low for w, (_, _, low, _) in enumerate(block.windows[anchor])]
        return min(need, default=np.iinfo(np.int64).max)

    for anchor in range(len(least)):
        least[anchor] = max(least[anchor], needed(anchor))
    highest = np.array([max((w[3] for w in own), default=LEAST) for own in block.windows])
    for part, listed, values in _steps(block, rows, least):
        fits = (block.anchors.labels[part][:, None] != rows.labels[listed][None, :]) & (values >= least[part][:, None]) & (values <= highest[part][:, None])
        i, j = np.nonzero(fits)
        for k in np.unique(i):
            anchor = int(part[k])
            at = j[i == k]
            own = [(-int(values[k, x]), int(rows.ids[listed[x]]), int(rows.labels[listed[x]]), rows.vectors[listed[x]].tolist()) for x in at]
            for w, (_, _, low, high) in enumerate(block.windows[anchor]):
                best[anchor, w] = _top(best[anchor, w] + [c for c in own if low <= -c[0] <= high], size)
            least[anchor] = max(least[anchor], needed(anchor))
    for (anchor, w), own in best.items():
        for minus, id_, label, vector in own:
            yield anchor, w, -minus, id_, label, vector


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """The rows of a task in lists of at most ``LIST_ROWS`` rows and a batch."""
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch)
        if n >= LIST_ROWS:
            yield from _by_length(pa.Table.from_batches(held))
            held, n = [], 0
    if held:
        yield from _by_length(pa.Table.from_batches(held))


def _walk(shared, size: int, positives: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        for rows in _lists(batches):
            for number, block in enumerate(blocks):
                if block.anchors.vectors.shape[1] != rows.vectors.shape[1]:
                    continue
                if positives:
                    found = [(number, a, 0, s, i, int(block.anchors.labels[a]), v) for a, s, i, v in _found_positives(block, rows, size)]
                else:
                    found = [(number, *r) for r in _found_negatives(block, rows, size)]
                if found:
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["block", "anchor", "w", "score", "id", "label", "v"])
    return run


def _ranked(rows: DataFrame, shared, size: int, positives: bool) -> DataFrame:
    found = rows.mapInArrow(_walk(shared, size, positives), "block int, anchor bigint, w int, score bigint, id bigint, label bigint, v array<bigint>")
    order = Window.partitionBy("block", "anchor", "w").orderBy(F.desc("score"), "id", "label", "v")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).drop("v", "label")


def _anchor_blocks(anchors: DataFrame, units: dict[int, np.ndarray], block: int) -> Iterator[pa.Table]:
    """Anchors in blocks, near ones together; one block at a time stands in the driver."""
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_length(batch):
                length = rows.vectors.shape[1]
                own = _angles(rows, units[length]).argmin(axis=1) if length in units else np.zeros(len(rows.ids), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), length), pa.int64()), pa.array(own, pa.int64()), pa.array(rows.ids), pa.array(rows.labels),
                                                  pa.array(list(rows.vectors), pa.list_(pa.int64()))], names=["length", "cluster", "id", "label", "v"])

    ordered = materialized(anchors.mapInArrow(assigned, "length bigint, cluster bigint, id bigint, label bigint, v array<bigint>").orderBy("length", "cluster", "id", "label", "v"), "anchors")
    held = []
    for row in ordered.select("id", "label", "v").toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield _table(held)
            held = []
    if held:
        yield _table(held)


def _table(rows: list) -> pa.Table:
    return pa.table({"id": pa.array([r["id"] for r in rows], pa.int64()), "label": pa.array([r["label"] for r in rows], pa.int64()), "v": pa.array([list(r["v"]) for r in rows], pa.list_(pa.int64()))})


def _first_thresholds(anchors: Rows, sampled: list[Rows], size: int) -> np.ndarray:
    """A lower bound of each anchor's last positive: that among the sampled rows, or nothing."""
    best = np.full((len(anchors.ids), size), LEAST)
    for rows in sampled:
        if rows.vectors.shape[1] != anchors.vectors.shape[1]:
            continue
        for at in range(0, len(anchors.ids), MEMBERS):
            part = slice(at, at + MEMBERS)
            values = scores(Rows(*(x[part] for x in anchors)), rows)
            fits = (anchors.labels[part][:, None] == rows.labels[None, :]) & (anchors.ids[part][:, None] != rows.ids[None, :])
            values = np.concatenate([best[part], np.where(fits, values, LEAST)], axis=1)
            best[part] = -np.sort(-values, axis=1)[:, :size]
    return best[:, -1]


def mine(rows: DataFrame, anchors: Column, *, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3,
         low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows that ``anchors`` (a condition on ``id``) marks.

    Of each anchor and each of its first ``positives`` rows of equal label, the first ``negatives`` rows of another label whose score s has
    low[0] * positive <= low[1] * s and high[1] * s <= high[0] * positive. Components must be whole numbers.
    """
    spark = rows.sparkSession
    stored = materialized(usable_rows(rows, id_column=id_column, label=label, vector=vector), "vectors")
    own = stored.where(anchors)
    hashed = F.xxhash64("id", "label", "v")
    # Centres are fitted to a bounded sample of anchors, first thresholds come from a bounded sample of rows.
    units = {r.vectors.shape[1]: centres(r) for r in _by_length(bounded_sample(own, sample, hashed).toArrow())}
    sampled = list(_by_length(bounded_sample(stored, sample, hashed).toArrow()))
    out = None
    for table in _anchor_blocks(own, units, block):
        groups = list(_by_length(table))
        found = [Block.of(g, units.get(g.vectors.shape[1], np.zeros((1, g.vectors.shape[1]))), _first_thresholds(g, sampled, positives)) for g in groups]
        tops = _ranked(stored, spark.sparkContext.broadcast(found), positives, True).collect()  # at most ``positives`` rows for each anchor of the block
        windows = [[[] for _ in g.ids] for g in groups]
        for r in sorted(tops, key=lambda r: (r["block"], r["anchor"], r["rank"])):
            s = r["score"]
            windows[r["block"]][r["anchor"]].append((r["id"], s, -(-low[0] * s // low[1]), high[0] * s // high[1]))
        walked = [b._replace(windows=w, least=np.full(len(b.least), LEAST)) for b, w in zip(found, windows)]
        names = spark.createDataFrame([(k, a, w, int(g.ids[a]), p, s) for k, (g, own_) in enumerate(zip(groups, windows)) for a, o in enumerate(own_) for w, (p, s, _, _) in enumerate(o)],
                                      "block int, anchor bigint, w int, anchor_id bigint, positive_id bigint, positive_score bigint")
        part = _ranked(stored, spark.sparkContext.broadcast(walked), negatives, False).join(F.broadcast(names), ["block", "anchor", "w"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part = materialized(part, "negatives")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return out
