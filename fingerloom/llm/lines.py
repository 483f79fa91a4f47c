"""Line dedup by range-partitioned hashes.

Every line of enough characters becomes a narrow row: a 128-bit hash of its key, its document and its position. The rows are
range-partitioned and sorted by hash, document and position, so a line's occurrences stand in one run, whose first document
keeps its lines. A run is streamed, never gathered, and one that is longer than a partition goes on in the next: each partition
reports its first and last hash with the run's first document, and those few rows decide what the partition could not. What
comes back is a compressed keep bitmap for each document instead of its text.

A key is the line without white space at its ends, A-Z lower-cased. Keys are known by 16 bytes of BLAKE2b, for which no two texts
of equal hash are known; a document is known by its id and two 64-bit hashes of its text.

Defined results: a NULL or empty text is one empty line; rows that share an id are one document, in which nothing counts as found
elsewhere; NULL ids are one document behind all others; repeated rows get equal bitmaps; an empty table gives no rows; extra columns
are ignored or carried through unchanged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerloom.session import materialized

MIN_CHARS = 10
#: Fixed value: what is stripped from both ends of a line.
BLANK = b" \t\n\x0b\x0c\r"
#: Kinds of streamed rows: a document's number of lines, a line that goes, a line of a partition's first run, and its first and last run.
LINES, GONE, OPEN, FIRST, LAST = range(5)
_ROWS = 20_000


def _identity(id_: Column, text: Column) -> list[Column]:
    """A document: its id and 128 bits of its text."""
    return [id_.alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(11), text).alias("t2")]


def _line_rows(min_chars: int):
    """(h1, h2, doc, t1, t2, at): each line that counts, and for each document its number of lines as -1 - n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, whole = batch.column("text"), [batch.column(c) for c in ("doc", "t1", "t2")]
            digests: list[bytes] = []
            rows: list[int] = []
            places: list[int] = []

            def flushed() -> pa.RecordBatch:
                hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                owner = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), *[c.take(owner) for c in whole], pa.array(places, pa.int64())],
                                                  names=["h1", "h2", "doc", "t1", "t2", "at"])

            for row, text in enumerate(texts):
                lines = (text.as_py() or "").encode().split(b"\n")
                # The document's own row takes its place by its text, so that these rows are spread as well.
                digests.append(np.array([whole[1][row].as_py(), whole[2][row].as_py()], np.int64).tobytes())
                rows.append(row)
                places.append(-1 - len(lines))
                for at, line in enumerate(lines):
                    key = line.strip(BLANK).lower()
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        rows.append(row)
                        places.append(at)
                    if len(rows) >= _ROWS:
                        yield flushed()
                        digests, rows, places = [], [], []
            if rows:
                yield flushed()
    return run


def _same(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before; NULL equals NULL."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _is(column: pa.Array, value: pa.Scalar) -> np.ndarray:
    if not value.is_valid:
        return pc.is_null(column).to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.equal(column, value), False).to_numpy(zero_copy_only=False)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: what is decided, the rows of its first run, and its first and last run."""
    part = TaskContext.get().partitionId()
    before = None  # the last row: hash, first document of its run, whole row, whether in the first run

    def out(kind, h1, h2, doc, t1, t2, at, gone) -> pa.RecordBatch:
        n = len(h1)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, kind, np.int32)), h1, h2, doc, t1, t2, at, pa.array(gone)],
                                          names=["part", "kind", "h1", "h2", "doc", "t1", "t2", "at", "gone"])

    for batch in batches:
        if not len(batch):
            continue
        h1, h2, doc, t1, t2, at = (batch.column(c) for c in ("h1", "h2", "doc", "t1", "t2", "at"))
        n = len(batch)
        a, b = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
        place = at.to_numpy(zero_copy_only=False)
        header = place < 0
        new_run = np.ones(n, bool)  # a document's own row is a run by itself
        new_run[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (header[1:] != header[:-1])
        again = np.zeros(n, bool)  # an equal row right before: a repeated document
        again[1:] = ~new_run[1:] & _same(doc) & _same(t1) & _same(t2) & (place[1:] == place[:-1])
        if before is not None:
            went_on = before["h"] == (a[0], b[0], header[0])
            new_run[0] = not went_on
            again[0] = went_on and all(x.equals(y) for x, y in zip(before["row"], (doc[0], t1[0], t2[0], at[0])))
        run = np.cumsum(new_run)  # 0 is the run that goes on from the batch before
        starts = np.flatnonzero(new_run)
        other = np.zeros(n, np.int64)  # changes of document
        other[1:] = ~_same(doc)
        changes = np.cumsum(other)
        base = np.concatenate([[0], changes[starts]])
        gone = changes - base[run] > 0
        opened = np.zeros(n, bool)
        if before is None:
            opened = run == 1
            yield out(FIRST, *(c.slice(0, 1) for c in (h1, h2, doc, t1, t2, at)), np.zeros(1, bool))
        elif not new_run[0]:
            head = run == 0
            gone[head] = ~_is(doc.filter(pa.array(head)), before["first"])
            if before["open"]:
                opened = head
        keep = ~again
        for kind, wanted in ((LINES, header), (GONE, gone & ~opened & ~header), (OPEN, opened & ~header)):
            chosen = np.flatnonzero(wanted & keep)
            if len(chosen):
                pick = pa.array(chosen)
                yield out(kind, *(c.take(pick) for c in (h1, h2, doc, t1, t2, at)), gone[chosen])
        first = doc[int(starts[-1])] if len(starts) else before["first"]
        before = {"h": (a[-1], b[-1], header[-1]), "first": first, "row": (doc[n - 1], t1[n - 1], t2[n - 1], at[n - 1]), "open": bool(opened[-1]),
                  "last": [c.slice(n - 1, 1) for c in (h1, h2, doc, t1, t2, at)]}
    if before is not None:
        last = before["last"]
        yield out(LAST, last[0], last[1], pa.array([before["first"].as_py()], last[2].type), *last[3:], np.array([before["open"]]))


def _carries(stored: DataFrame) -> DataFrame | None:
    """(part, carried): the first document of the run that each partition's first run continues; a row for each partition at most."""
    rows = stored.where(F.col("kind") >= FIRST).select("part", "kind", "h1", "h2", "doc", "at", "gone").collect()
    first, last = ({r["part"]: r for r in rows if r["kind"] == kind} for kind in (FIRST, LAST))
    found, run = [], None  # the run that the partition before ended in
    for part in sorted(first):
        own, end = first[part], last[part]
        key = (own["h1"], own["h2"], own["at"] < 0)
        goes_on = run is not None and run[0] == key
        if goes_on:
            found.append((part, run[1]))
        # A partition that holds nothing but its first run passes the first document on.
        if not (goes_on and end["gone"]):
            run = ((end["h1"], end["h2"], end["at"] < 0), end["doc"])
    if not found:
        return None
    kind = stored.schema["doc"].dataType.simpleString()
    return stored.sparkSession.createDataFrame(found, f"part int, carried {kind}")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, bitmaps = [], [], []
        for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("places")):
            keep = np.ones(n, bool)
            keep[places.values.to_numpy(zero_copy_only=False)] = False
            counts.append(n)
            gone.append(n - int(keep.sum()))
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc", "t1", "t2")], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(bitmaps, pa.binary())],
                                         names=["doc", "t1", "t2", "n_lines", "n_dropped", "bitmap"])


def keep_bitmaps(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, t1, t2, n_lines, n_dropped, bitmap) of each distinct document: its id, two hashes of its text, and which lines stay.

    The bitmap has a bit for each line, the first line's highest, zlib-compressed; :func:`kept_lines` reads it.
    """
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    df = docs.select(own.alias("text"), *_identity(F.col(f"`{id_column}`"), own))
    kind = df.schema["doc"].dataType.simpleString()
    order = [F.col("h1"), F.col("h2"), (F.col("at") < 0), F.col("doc").asc_nulls_last(), F.col("t1"), F.col("t2"), F.col("at")]
    rows = df.mapInArrow(_line_rows(min_chars), f"h1 bigint, h2 bigint, doc {kind}, t1 bigint, t2 bigint, at bigint")
    runs = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = runs.mapInArrow(_stream, f"part int, kind int, h1 bigint, h2 bigint, doc {kind}, t1 bigint, t2 bigint, at bigint, gone boolean")
    stored = materialized(streamed, "line-runs")
    carries = _carries(stored)
    decided = stored.where(F.col("kind") < FIRST)
    gone = F.when(F.col("kind") == OPEN, F.col("gone")).otherwise(F.col("kind") == GONE)
    if carries is not None:
        decided = decided.join(F.broadcast(carries.withColumn("goes_on", F.lit(True))), "part", "left")
        gone = F.when((F.col("kind") == OPEN) & F.col("goes_on").isNotNull(), ~F.col("doc").eqNullSafe(F.col("carried"))).otherwise(gone)
    grouped = decided.groupBy("doc", "t1", "t2").agg(
        F.max(F.when(F.col("kind") == LINES, -1 - F.col("at"))).alias("n_lines"), F.collect_set(F.when((F.col("kind") != LINES) & gone, F.col("at"))).alias("places"))
    return grouped.mapInArrow(_bitmaps, f"doc {kind}, t1 bigint, t2 bigint, n_lines bigint, n_dropped bigint, bitmap binary")


def kept_lines(text: str | None, n: int, bitmap: bytes) -> str:
    """The text without the lines whose bit is 0."""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n)
    return "\n".join(line for line, k in zip((text or "").split("\n"), keep) if k)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            rows = zip(part.column("text"), *[part.column(c).to_pylist() for c in ("n_lines", "n_dropped", "bitmap")])
            kept = [t.as_py() if not gone else kept_lines(t.as_py(), n, bitmap) for t, n, gone, bitmap in rows]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("row", "n_lines", "n_dropped")], pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "kept"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, keep: list[str], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (struct of the kept columns), n_lines, n_dropped and the ``kept`` text of every row of ``docs``."""
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), own.alias("text"), *_identity(F.col(f"`{id_column}`"), own))
    found = bitmaps.select(F.col("doc").alias("b_doc"), F.col("t1").alias("b1"), F.col("t2").alias("b2"), "n_lines", "n_dropped", "bitmap")
    joined = df.join(found, F.col("t1").eqNullSafe(F.col("b1")) & (F.col("t2") == F.col("b2")) & F.col("doc").eqNullSafe(F.col("b_doc")))
    return joined.select("row", "text", "n_lines", "n_dropped", "bitmap").mapInArrow(
        _applied, f"row {df.schema['row'].dataType.simpleString()}, n_lines bigint, n_dropped bigint, kept string")
