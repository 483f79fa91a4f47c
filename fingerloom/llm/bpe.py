"""Byte-level BPE over global distinct words.

Texts are cut into pre-tokens. Every block of documents sends each of its distinct pre-tokens once, with its count, into
one global shuffle; the ``dictionary`` most frequent are encoded once each and their ids joined back from a broadcast table, whose size
is bounded by that parameter. Words are found by hash and compared by their bytes. A pre-token beyond the dictionary is encoded where it stands,
once for each block of documents. Ids are reassembled by position. Decoding joins the token-byte table to the ids.

Why positions do not travel: one row for each pre-token with its position is four times the input in shuffle files. With
positions kept in the block that holds the document, only distinct words are shuffled, and the result is the same.

Defined results: a NULL text counts as empty and has no ids; very long texts are one block of their own; repeated rows are
encoded each for itself; an empty table gives no rows; extra columns are ignored or carried through unchanged.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.llm.common import SpanTable, binary_array, chunks, distinct_spans, gathered, most_frequent
from fingerloom.session import materialized

DICTIONARY = 1 << 19

#: The classes of a character in the pre-token pattern.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Fixed values of the pattern: White_Space beyond ASCII, and the endings after an apostrophe.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The class of every code point, built once for each Python worker."""
    if not _CLASSES:
        table = np.zeros(0x110000, np.uint8)
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, points):
                a, b = ord(points[m.start()]), ord(points[m.end() - 1])
                table[a:b + 1] = kind
        table[_SPACES] = SPACE
        table[0xD800:0xE000] = OTHER
        _CLASSES.append(table)
    return _CLASSES[0]


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the pre-tokens, n + 1 of them, and the first pre-token of each text.

    The pre-tokens are the matches of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, found for all texts at once: a match
    starts where the class changes, a single space goes with the run behind it, and white space before a run gives
    up its last character.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    kind = char_classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, offsets)] = True
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last white space of a run, if something that is no white space follows in the same text.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    last = np.flatnonzero(last)
    start[last] = True
    joined = last[points[last] == 32] + 1
    start[joined] = False
    # An apostrophe at the start of its match takes a following ending with it.
    mark = np.flatnonzero((points == 39) & start[:n])
    mark = mark[(mark + 1 < n)]
    mark = mark[(kind[mark + 1] == LETTER) & ~edge[mark + 1]]
    open_ = np.ones(len(mark), bool)
    for ending in _ENDINGS:
        fits = open_.copy()
        for k, c in enumerate(ending):
            place = np.minimum(mark + 1 + k, n - 1)
            fits &= (mark + 1 + k < n) & (points[place] == ord(c))
            if k:
                fits &= ~edge[place]
        hit = mark[fits]
        open_ &= ~fits
        start[hit + 1] = False
        after = hit + 1 + len(ending)
        start[after[kind[np.minimum(after, n - 1)] == LETTER]] = True
    begins = np.flatnonzero(start[:n])
    bounds = np.append(at[begins], len(data))
    return bounds, np.searchsorted(bounds, offsets)


class Tokenizer:
    """The ranks of a vocabulary file of lines ``base64 rank``, and what is derived from them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        size = max(self.ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        #: The token-byte table: all tokens' bytes, and their offsets.
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def encode(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(word.decode("utf-8"))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join the token-byte table to ids: the bytes of all texts, and each text's offsets in them."""
        data, ofs = gathered(self.bytes, self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids])
        return data, ofs[offsets]


_TOKENIZERS: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each Python worker; the vocabulary file is installed on every machine."""
    if (path, pattern) not in _TOKENIZERS:
        _TOKENIZERS[path, pattern] = Tokenizer(path, pattern)
    return _TOKENIZERS[path, pattern]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct pre-tokens and their counts."""
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text")):
            bounds, _ = pre_tokens(data, offsets)
            if len(bounds) < 2:
                continue
            first, inverse, _ = distinct_spans(data, bounds[:-1], bounds[1:])
            counts = np.bincount(inverse, minlength=len(first)).astype(np.int64)
            cut, ofs = gathered(data, bounds[first], bounds[first + 1] - bounds[first])
            yield pa.RecordBatch.from_arrays([binary_array(cut, ofs), pa.array(counts, pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often every distinct pre-token occurs: the global distinct-word shuffle."""
    found = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_distinct, "word binary, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _encode_words(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            ids = [np.array(own.encode(w), "<u4").tobytes() for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.binary())], names=["word", "ids"])
    return run


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def dictionary(counts: DataFrame, path: str, pattern: str, size: int = DICTIONARY) -> tuple[SpanTable, np.ndarray, np.ndarray]:
    """The ``size`` most frequent words, each encoded once: a table of them, their ids and offsets; at most ``size`` rows reach the driver."""
    counts = materialized(counts, "bpe-words")
    frequent = most_frequent(counts, size).select("word").repartition(counts.sparkSession.sparkContext.defaultParallelism)
    rows = frequent.mapInArrow(_encode_words(path, pattern), "word binary, ids binary").toArrow()
    whole = lambda c: _words(pa.concat_arrays(rows.column(c).chunks) if rows.column(c).num_chunks else pa.array([], pa.binary()))
    data, ofs = whole("ids")
    return SpanTable(*whole("word")), data.view("<u4"), ofs // 4


def encoded_block(data: np.ndarray, offsets: np.ndarray, own: Tokenizer, table: tuple[SpanTable, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block of texts, and each text's offsets in them."""
    bounds, first = pre_tokens(data, offsets)
    if len(bounds) < 2:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    words, known_ids, known_offsets = table
    at, inverse, distinct = distinct_spans(data, bounds[:-1], bounds[1:])
    place = words.find(data, bounds[at], bounds[at + 1], distinct)
    found = place >= 0
    rest = [own.encode(data[bounds[i]: bounds[i + 1]].tobytes()) for i in at[~found]]
    ids = np.concatenate([known_ids.astype(np.int64), np.array([t for r in rest for t in r], np.int64)])
    lengths, starts = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    starts[found] = known_offsets[place[found]]
    lengths[found] = known_offsets[place[found] + 1] - starts[found]
    lengths[~found] = [len(r) for r in rest]
    starts[~found] = len(known_ids) + np.cumsum(lengths[~found]) - lengths[~found]
    out, ofs = gathered(ids, starts[inverse], lengths[inverse])
    return out, ofs[first]


def _with_digests(row: pa.Array, ids: np.ndarray, ofs: np.ndarray, own: Tokenizer, with_ids: bool) -> pa.RecordBatch:
    """Rows with their number of ids, the digests of the ids and of what they decode to, and the ids if wanted."""
    data, at = own.decode(ids, ofs)
    raw = ids.astype("<u4")
    lists = [pa.ListArray.from_arrays(pa.array(ofs, pa.int32()), pa.array(ids, pa.int32()))] if with_ids else []
    return pa.RecordBatch.from_arrays([
        row, pa.array(np.diff(ofs), pa.int64()),
        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ofs[:-1], ofs[1:])], pa.string()),
        pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string()),
        *lists,
    ], names=["row", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])


def _encode(path: str, pattern: str, shared, digests: bool, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = tokenizer(path, pattern), shared.value
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                ids, ofs = encoded_block(data, offsets, own, table)
                part = batch.column("row").slice(row, end - row)
                if digests:
                    yield _with_digests(part, ids, ofs, own, with_ids)
                else:
                    yield pa.RecordBatch.from_arrays([part, pa.ListArray.from_arrays(pa.array(ofs, pa.int32()), pa.array(ids, pa.int32()))], names=["row", "ids"])
    return run


def _encoded(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str, size: int, digests: bool, with_ids: bool) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionary(word_counts(docs, text), path, pattern, size))
    df = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids if digests else "ids array<int>"
    return df.mapInArrow(_encode(path, pattern, shared, digests, with_ids), f"row {df.schema['row'].dataType.simpleString()}, {fields}")


def encode(docs: DataFrame, path: str, pattern: str, *, keep: list[str], text: str = "text", size: int = DICTIONARY) -> DataFrame:
    """``row`` (struct of the kept columns) and ``ids`` of every text."""
    return _encoded(docs, path, pattern, keep, text, size, False, True)


def encode_and_check(docs: DataFrame, path: str, pattern: str, *, keep: list[str], text: str = "text", size: int = DICTIONARY, with_ids: bool = False) -> DataFrame:
    """``row``, number of ids, SHA-256 of the ids (little-endian, 32 bits) and of the bytes they decode to, and the ids if wanted.

    The ids are decoded in the task that has them, so they need not travel for it.
    """
    return _encoded(docs, path, pattern, keep, text, size, True, with_ids)


def _id_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) of about a million ids at a time."""
    limits = column.offsets.to_numpy().astype(np.int64)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(limits, limits[row] + (1 << 20), "right")) - 1)
        yield row, end, column.slice(row, end - row).flatten().to_numpy(zero_copy_only=False).astype(np.int64), limits[row: end + 1] - limits[row]
        row = end


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            for row, end, ids, ofs in _id_blocks(batch.column("ids")):
                data, at = own.decode(ids, ofs)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, end - row), batch.column("ids").slice(row, end - row), binary_array(data, at)], names=["row", "ids", "decoded"])
    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``row``, ``ids`` and the ``decoded`` bytes."""
    return encoded.mapInArrow(_decode(path, pattern), f"row {encoded.schema['row'].dataType.simpleString()}, ids array<int>, decoded binary")


def _digested(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            for row, end, ids, ofs in _id_blocks(batch.column("ids")):
                yield _with_digests(batch.column("row").slice(row, end - row), ids, ofs, own, with_ids)
    return run


def digests(encoded: DataFrame, path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """What :func:`encode_and_check` gives, of texts that are encoded already."""
    return encoded.mapInArrow(_digested(path, pattern, with_ids), f"row {encoded.schema['row'].dataType.simpleString()}, "
                              "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
