"""Suffix-array dedup: bytes covered by a long string that also starts somewhere else.

The suffix arrays are sparse. A suffix is sampled where its first ``SEED`` bytes have the least hash among all starts of
a window of ``length`` bytes, so every such window holds a sample, equal windows hold it at the same place, and a sample
stands for the run of windows that chose it. An array's rows are ordered by the fingerprint of those first bytes, then by
that of the whole stretch which the sample's windows cover.

A family of arrays grows by batches. A new batch's samples are merge-scanned with all levels: neighbours in suffix order
whose whole stretches agree are long matches, and neighbours that only share the first bytes are candidates. A level holds
one row for each distinct suffix; a new level and its equal-sized neighbour become one of twice the size, so the number of
levels grows with the logarithm of the number of batches.

Candidates are settled window by window on 64-bit fingerprints of all their bytes, grouped by their first bytes; of groups
with more than ``group`` members only window fingerprints travel, one row for each, so no task holds an unbounded group. Bytes are
not compared: two unlike windows of one fingerprint, among those that share their first bytes, would both be removed.

Results depend on a text alone, so they are keyed by its 64-bit content hash (two unlike texts of one hash would be taken for one), and rows
without an id, or repeated rows, are served like any other: a text of ``length`` bytes or more that occurs twice is removed whole. NULL and empty texts
have no bytes and nothing to remove; an empty table gives no rows; extra columns are ignored or carried through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fingerloom.llm.common import buffers, chunks, gathered, mixed, prefix_hash, span_hash
from fingerloom.session import materialized, shared_dir

LENGTH = 200
SEED = 32
GROUP = 2000
BATCHES = 2
_LOW = np.uint64((1 << 24) - 1)
#: A sample: fingerprints of its first bytes and of its whole stretch, its text, its place in it; how often (1 or 2 for
#: more) its block holds an equal one, and whether an equal one went before.
SAMPLED = "seed bigint, whole bigint, key bigint, place bigint, n bigint, again boolean"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def samples(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, sample, seed hash) of the sampled suffixes; places are in ``data``."""
    n, windows = len(data), np.maximum(np.diff(offsets) - length + 1, 0)
    if not windows.any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    at = np.arange(n - seed + 1)
    hashes = span_hash(prefix_hash(data), at, at + seed)
    width, step = length - seed + 1, 1 << 23
    chosen = np.empty(n - length + 1, np.int64)
    for lo in range(0, len(chosen), step):  # places fit 24 bits in each stretch; ties go to the first place
        hi = min(lo + step, len(chosen))
        part = hashes[lo: hi + width - 1]
        chosen[lo:hi] = lo + (_sliding_min((part & ~_LOW) | np.arange(len(part), dtype=np.uint64), width) & _LOW).astype(np.int64)
    first, _ = gathered(np.arange(n), offsets[:-1], windows)
    text, sample = np.repeat(np.arange(len(windows)), windows), chosen[first]
    new = np.flatnonzero(np.concatenate([[True], (sample[1:] != sample[:-1]) | (text[1:] != text[:-1])]))
    last = first[np.concatenate([new[1:] - 1, [len(first) - 1]])]
    return text[new], first[new], last, sample[new], hashes[sample[new]]


def _sample_rows(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for row, _, data, offsets in chunks(batch.column("text")):
                text, first, last, sample, hashes = samples(data, offsets, length, seed)
                raw = data.tobytes()
                whole = [xxhash.xxh3_64_intdigest(raw[a:b + length]) for a, b in zip(first.tolist(), last.tolist())]
                whole = np.array(whole, np.uint64)
                place = ((first - offsets[text]) << 16) | ((last - first) << 8) | (sample - first)
                # Equal suffixes of one block meet here: the first goes on to the scan, as one that occurs twice.
                _, lead, group, counts = np.unique(mixed(hashes) + whole, return_index=True, return_inverse=True, return_counts=True)
                again = np.ones(len(group), bool)
                again[lead] = False
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes.view(np.int64)), pa.array(whole.view(np.int64), pa.int64()), pa.array(keys[row + text], pa.int64()),
                    pa.array(place, pa.int64()), pa.array(np.minimum(counts, 2)[group], pa.int64()), pa.array(again),
                ], names=["seed", "whole", "key", "place", "n", "again"])
    return run


def _first() -> F.Column:
    return F.shiftright("place", 16)


def _last() -> F.Column:
    return _first() + F.shiftright("place", 8).bitwiseAND(255)


class SuffixFamily:
    """Arrays of distinct sampled suffixes, as (number of batches, table in the shared folder), largest first."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame, *, final: bool = False) -> DataFrame:
        """Merge-scan a batch's samples (:data:`SAMPLED`) with the levels and take it in; returns the rows that match.

        Columns: seed, whole, key, place, ``long`` (the whole stretch occurs elsewhere), ``check`` (its windows are to be
        compared with those of the same seed). Matches between old rows alone were returned before. With ``final`` no
        batch follows and no level is written.
        """
        batch = materialized(batch, "suffix-samples")
        rows = batch.where("not again").select("seed", "whole", "key", "place", "n", F.lit(True).alias("new"))
        for _, level in self.levels:
            rows = rows.union(level.select("seed", "whole", "key", "place", "n", F.lit(False)))
        group = Window.partitionBy("seed")
        ordered = group.orderBy("whole", "key", "place")
        near = {"before": F.lag("whole").over(ordered), "after": F.lead("whole").over(ordered), "size": F.sum("n").over(group),
                "several": F.min("whole").over(group) != F.max("whole").over(group), "any_new": F.max("new").over(group)}
        scanned = rows.withColumns(near).select(
            "seed", "whole", "key", "place", "n", (F.col("any_new") & (F.col("size") > 1)).alias("hit"),
            (F.coalesce(F.col("before") == F.col("whole"), F.lit(False)) | F.coalesce(F.col("after") == F.col("whole"), F.lit(False)) | (F.col("n") > 1)).alias("long"),
            F.coalesce(F.col("before") != F.col("whole"), F.lit(True)).alias("lead"), "several")
        if final:
            kept = materialized(scanned.where("hit"), "suffix-matches")
        else:
            kept = materialized(scanned.sortWithinPartitions("seed", "whole"), "suffix-array")
            array = kept.where("lead").select("seed", "whole", "key", "place", F.when(F.col("long"), 2).otherwise(1).cast("bigint").alias("n"))
            self._take_in(array)
        found = kept.where("hit").select("seed", "whole", "key", "place", "long", (F.col("several") & F.col("lead")).alias("check"))
        return found.union(batch.where("again").select("seed", "whole", "key", "place", F.lit(True), F.lit(False)))

    def _take_in(self, scanned: DataFrame) -> None:
        """The scan has merged the batch with every level already: keep that as one level, as a carry does in binary.

        Levels that the carry does not reach stay; the array then holds their rows too, and only its own are kept.
        """
        size = 1
        absorbed = []
        while self.levels and self.levels[-1][0] == size:
            absorbed.append(self.levels.pop())
            size *= 2
        for _, level in self.levels:
            scanned = scanned.join(level.select("seed", "whole"), ["seed", "whole"], "left_anti")
        self.levels.append((size, materialized(scanned, "suffix-level") if self.levels else scanned))


def _contexts(length: int):
    """Cut the bytes around candidate samples out of their texts; windows of large groups go on as fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            checks = batch.column("checks")
            for row, end, data, offsets in chunks(batch.column("text")):
                part = checks.slice(row, end - row)
                counts = np.diff(part.offsets.to_numpy())
                flat = part.flatten()
                if not len(flat):
                    continue
                text = np.repeat(np.arange(end - row), counts)
                seed, place, large = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                first, runs, lead = place >> 16, ((place >> 8) & 255) + 1, place & 255
                at = offsets[text] + first
                small = np.flatnonzero(~large)
                if len(small):
                    cut, ofs = gathered(data, at[small], runs[small] + length - 1)
                    yield _context_rows(seed[small], batch.column("key").to_numpy()[row + text[small]], first[small], lead[small],
                                        pa.Array.from_buffers(pa.large_binary(), len(small), [None, pa.py_buffer(ofs), pa.py_buffer(cut)]).cast(pa.binary()))
                big = np.flatnonzero(large)
                if len(big):
                    window, ofs = gathered(np.arange(len(data)), at[big], runs[big])
                    own = np.repeat(big, runs[big])
                    hashes = span_hash(prefix_hash(data), window, window + length)
                    start = window - offsets[text[own]]
                    yield _context_rows(hashes.view(np.int64), batch.column("key").to_numpy()[row + text[own]], start,
                                        first[own] + lead[own] - start, pa.nulls(len(own), pa.binary()))
    return run


def _context_rows(seed, key, first, lead, bytes_) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seed, pa.int64()), pa.array(key, pa.int64()), pa.array(first, pa.int64()),
                                       pa.array(lead, pa.int64()), bytes_], names=["seed", "key", "first", "lead", "bytes"])


def _runs(key: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive windows of one text."""
    order = np.lexsort((window, key))
    key, window = key[order], window[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (window[1:] > window[:-1] + 1)])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(key) - 1)
    return pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(window[new]), pa.array(window[ends])], names=["key", "first", "last"])


def _settled(length: int):
    """Over rows sorted by seed: windows that two members of a group share, at the same distance from the sample."""
    def of(seed, key, first, lead, data, offsets) -> Iterator[pa.RecordBatch]:
        runs = np.diff(offsets) - length + 1
        window, _ = gathered(np.arange(len(data)), offsets[:-1], runs)
        own = np.repeat(np.arange(len(seed)), runs)
        start = first[own] + window - offsets[own]
        distance = (first + lead)[own] - start
        hashes = mixed(span_hash(prefix_hash(data), window, window + length) + mixed(seed.view(np.uint64))[own] + distance.astype(np.uint64))
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        hit = np.zeros(len(order), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        if hit.any():
            yield _runs(key[own][hit], start[hit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            data, offsets = _binary(table.column("bytes"))
            yield from of(*(table.column(c).to_numpy() for c in ("seed", "key", "first", "lead")), data, offsets)

        for batch in batches:
            for at in range(0, len(batch), GROUP):  # groups are at most GROUP rows, so at most two parts stand here
                part = batch.slice(at, GROUP)
                seeds = part.column("seed").to_numpy()
                # The last group may go on. What is held is of one group: it ends where the seed changes, nowhere else.
                done = rows + int(np.searchsorted(seeds, seeds[-1]))
                if done == rows and rows and held[-1].column("seed")[0].as_py() == seeds[-1]:
                    done = 0
                held.append(part)
                rows += len(part)
                if done:
                    table = pa.Table.from_batches(held)
                    held, rows = table.slice(done).combine_chunks().to_batches(), rows - done
                    yield from settle(table.slice(0, done))
        if rows:
            yield from settle(pa.Table.from_batches(held))
    return run


def _binary(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def _kept(whole_characters: bool, length: int):
    """Cut the covered bytes out of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covers = batch.column("covers")
            for row, end, data, offsets in chunks(batch.column("text")):
                part = covers.slice(row, end - row)
                out, spans_out = [], []
                for k, spans in enumerate(part.to_pylist()):
                    own = data[offsets[k]: offsets[k + 1]]
                    spans = _united(spans or [], length)
                    if whole_characters:
                        spans = [(a, b) for a, b in ((_forward(own, a), _back(own, b)) for a, b in spans) if a < b]
                    at = 0
                    pieces = []
                    for a, b in spans:
                        pieces.append(own[at:a].tobytes())
                        at = b
                    pieces.append(own[at:].tobytes())
                    out.append(b"".join(pieces))
                    spans_out.append([{"start": a, "end": b} for a, b in spans])
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(row, end - row), pa.array(np.diff(offsets), pa.int64()),
                    pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out, pa.binary()),
                ], names=["row", "n_bytes", "spans", "kept"])
    return run


def _united(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte spans under runs of windows (first, last), merged where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["first"], r["last"] + length) for r in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _forward(data: np.ndarray, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _back(data: np.ndarray, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def without_repeats(docs: DataFrame, *, keep: list[str], text: str = "text", length: int = LENGTH, seed: int = SEED,
                    batches: int = BATCHES, group: int = GROUP, whole_characters: bool = False) -> DataFrame:
    """A row for each document: ``row`` (struct of the kept columns), n_bytes, spans (maximal removed byte runs), kept bytes.

    With ``whole_characters`` a span gives back the parts of characters at its ends, so that the kept bytes are text.
    """
    if not seed <= length <= seed + 255:
        raise ValueError("The seed is at most as long as the strings, and at most 255 bytes shorter.")
    shared_dir(docs.sparkSession)
    keyed = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("text"))
    family, matches = SuffixFamily(), []
    for k in range(batches):
        batch = keyed.where(F.pmod("key", F.lit(batches)) == k).select("key", "text").mapInArrow(_sample_rows(length, seed), SAMPLED)
        matches.append(family.add(batch, final=k == batches - 1))
    found = matches[0]
    for more in matches[1:]:
        found = found.union(more)
    long = found.where("long").select("key", _first().alias("first"), _last().alias("last"))
    checks = found.where("check").select("seed", "key", "place").distinct()
    large = checks.groupBy("seed").agg((F.count(F.lit(1)) > min(group, GROUP)).alias("large")).where("large")
    wanted = checks.join(large, "seed", "left").select("key", F.struct("seed", "place", F.coalesce("large", F.lit(False)).alias("large")).alias("c"))
    # One row for each text: a key's candidates are bounded by the length of its text.
    by_text = wanted.groupBy("key").agg(F.collect_set("c").alias("checks"))
    # Texts are shuffled once: both joins below are part of one query and read the same exchange, for which the first takes
    # all its columns as well.
    stored = keyed.repartition("key")
    # Candidates are counted by text, so contexts are cut from one of a text's copies; the join has dealt texts by key.
    cut = stored.join(by_text, "key").dropDuplicates(["key"]).mapInArrow(_contexts(length), "seed bigint, key bigint, first bigint, lead bigint, bytes binary")
    small = cut.where("bytes is not null").repartition("seed").sortWithinPartitions("seed").mapInArrow(
        _settled(length), "key bigint, first bigint, last bigint")
    shared = Window.partitionBy("seed", "lead")
    wide = cut.where("bytes is null").select("seed", "lead", "key", "first").distinct().withColumn("n", F.count(F.lit(1)).over(shared)).where("n > 1")
    covers = long.union(small).union(wide.select("key", "first", F.col("first").alias("last")))
    by_key = covers.distinct().groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("covers"))
    rows = stored.join(by_key, "key", "left").select("row", "text", "covers")
    return rows.mapInArrow(_kept(whole_characters, length), f"row {keyed.schema['row'].dataType.simpleString()}, n_bytes bigint, "
                           "spans array<struct<start:bigint,end:bigint>>, kept binary")
