"""Helpers that the operators of this folder share: whole texts as byte buffers, word bounds, hashes, splits.

Texts reach a task as Arrow batches. Their UTF-8 bytes are handled as numpy buffers, a megabyte at a time, so
memory is bounded by ``CHUNK_BYTES`` or the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20

_SEED = np.random.default_rng(20260420)
#: Random values of the bytes and a random odd factor: the parameters of the polynomial hash.
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(int(_SEED.integers(1 << 61, 1 << 62)) * 2 + 1)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def crc_split(column: Column, modulus: int) -> Column:
    """CRC-32 of an id as text, modulo ``modulus``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with ``size`` bytes, or of one longer text."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def word_bounds(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``mask`` holds; no run crosses an offset."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[0] = cut[n] = True
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = mask[0], mask[-1]
    np.not_equal(mask[1:], mask[:-1], out=edge[1:n])
    inner = np.flatnonzero(cut[1:n]) + 1  # two runs that meet at an offset
    both = inner[mask[inner] & mask[inner - 1]]
    starts = np.flatnonzero(edge[:n] & mask)
    ends = np.flatnonzero(edge[1:] & mask) + 1
    if len(both):
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    return starts, ends


#: The polynomial hash below lets any span of a text be hashed at once, which suffixes need; words use :func:`word_hash`.
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash factor and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, factor in (("up", _FACTOR), ("down", _INVERSE)):
            values = np.full(size, factor, np.uint64)
            values[0] = 1
            _POWERS[name] = np.multiply.accumulate(values)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; :func:`span_hash` reads any span from them."""
    sums = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(_BYTE[data] * powers(len(data))[0], out=sums[1:])
    return sums


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes give equal hashes wherever they stand."""
    down = powers(len(sums))[1]
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words beyond this many bytes are handled one by one.
_LONG = 256


def padded(data: np.ndarray) -> bytes:
    """A copy of ``data`` with eight bytes more, so that eight bytes can be read from each place."""
    return np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()


def lanes(buffer: bytes) -> np.ndarray:
    """The eight bytes that begin at each byte of a padded buffer, as one number; nothing is copied."""
    return np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, own_lanes: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of spans, eight bytes at a time. Equal bytes have equal hashes; :func:`differing` tells whether equal hashes are equal bytes."""
    lengths = ends - starts
    out = mixed(lengths.astype(np.uint64) + _MIX)
    whole, own, at = lanes(padded(data)) if own_lanes is None else own_lanes, np.flatnonzero(lengths <= _LONG), 0
    while len(own := own[lengths[own] > at]):
        value = whole[starts[own] + at] & _MASKS[np.minimum(lengths[own] - at, 8)]
        out[own] = mixed((out[own] ^ value) * _FACTOR + _MIX)
        at += 8
    for i in np.flatnonzero(lengths > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes())
    return out


def differing(buffer: bytes, starts: np.ndarray, ends: np.ndarray, other: bytes, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span's bytes differ from those of the other span; both are spans of padded buffers."""
    lengths = ends - starts
    out = lengths != other_ends - other_starts
    a, b, at = lanes(buffer), lanes(other), 0
    own = np.flatnonzero(~out & (lengths <= _LONG))
    while len(own := own[lengths[own] > at]):
        unlike = ((a[starts[own] + at] ^ b[other_starts[own] + at]) & _MASKS[np.minimum(lengths[own] - at, 8)]) != 0
        out[own[unlike]] = True
        own = own[~unlike]
        at += 8
    for i in np.flatnonzero(~out & (lengths > _LONG)):
        out[i] = buffer[starts[i]:ends[i]] != other[other_starts[i]:other_ends[i]]
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a span of each distinct content, each span's number among them, their hashes). Contents of equal hash are told apart by their bytes."""
    buffer = padded(data)
    hashes = word_hash(data, starts, ends, lanes(buffer))
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[inverse]
    wrong = np.flatnonzero(differing(buffer, starts, ends, buffer, starts[like], ends[like]))
    if len(wrong):
        more: dict[bytes, int] = {}
        for i in wrong:
            inverse[i] = more.setdefault(data[starts[i]:ends[i]].tobytes(), len(first) + len(more))
        first = np.concatenate([first, wrong[np.unique(inverse[wrong], return_index=True)[1]]])
    return first, inverse, hashes[first]


class SpanTable:
    """Distinct words in one buffer, found by hash and compared by bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.buffer, self.offsets = padded(data), offsets
        hashes = word_hash(data, offsets[:-1], offsets[1:], lanes(self.buffer))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.order = hashes[order], order.astype(np.int32 if len(order) < 1 << 31 else np.int64)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of the equal word for each span, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        at, buffer = np.searchsorted(self.hashes, hashes), padded(data)
        left = np.flatnonzero(at < len(self.hashes))
        while len(left := left[self.hashes[at[left]] == hashes[left]]):
            number = self.order[at[left]]
            unlike = differing(buffer, starts[left], ends[left], self.buffer, self.offsets[number], self.offsets[number + 1])
            out[left[~unlike]] = number[~unlike]
            at[left] += 1  # another word of the same hash may follow
            left = left[unlike & (at[left] < len(self.hashes))]
        return out


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``data`` one after another, and their offsets."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return data[at], offsets


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column of consecutive spans."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def with_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name; extra columns never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def bounded_sample(df: DataFrame, rows: int, hash_: Column) -> DataFrame:
    """At most ``rows`` rows, the same each time: one in so many by a hash of their content, so few rows move in any task.

    All rows if there are no more than ``rows``.
    """
    every = -(-df.count() // rows)
    return df.where(F.pmod(hash_, F.lit(max(every, 1))) == 0).orderBy(hash_).limit(rows)


def most_frequent(counts: DataFrame, size: int, column: str = "n") -> DataFrame:
    """Rows whose count is above the least bound that at most ``size`` rows pass: no sort, no single task.

    Bounds are counts of at most ten significant bits, so that their histogram is a few thousand rows at any size.
    """
    n = F.col(column)
    low = F.greatest(F.floor(F.log2(n.cast("double"))).cast("int") - 9, F.lit(0))
    bound = F.expr(f"shiftleft(shiftright({column}, least), least)")
    binned = counts.where(n > 0).withColumn("least", low).select(bound.alias("bound"))
    cells = sorted(binned.groupBy("bound").agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    total, least = 0, None
    for cell in cells:
        total += cell["rows"]
        if total > size:
            break
        least = cell["bound"]
    return counts.where(n >= least) if least is not None else counts.limit(0)
