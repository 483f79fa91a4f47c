"""Language-model scoring with a subword lattice.

The pieces of an existing vocabulary file span a lattice over every word. The sum over all segmentations is found by the
forward recursion in log space. The weights start from the vocabulary's own scores and are fitted to the corpus by
expectation maximisation: expected piece counts over all segmentations of the distinct training words, by forward and
backward recursion. The vocabulary itself is never trained.

A word of the training rows is one more arc over the whole word. With its count c, N training tokens and V distinct ones,
P(word) = (c + (V + 1) * lattice) / (N + V + 2) and P(end) = (ends + 1) / (N + V + 2): as often as new words turn up, the
lattice spells one. These sum to at most one over all words there are, and a text's probability is the product over its
words and one end. (The base score is no such distribution: it gives each of the endless unseen words the same share.)

Everything is computed once for each distinct word of the corpus, after one global count, and joined back: the ``frequent``
most frequent words through a broadcast table of bounded size, all others through an equality join of their (row, word) pairs.

Defined results: NULL, empty and blank texts have one token, the end; a NULL id falls in the split of the empty text;
repeated rows are scored each for itself; without training rows N is 0 and the weights are those of the vocabulary; an empty
table gives no rows; extra columns are ignored or carried through unchanged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.llm.common import SpanTable, binary_array, chunks, distinct_spans, gathered, most_frequent, word_bounds
from fingerloom.session import materialized

FREQUENT = 1 << 19
ROUNDS = 2
PSEUDO = 0.1
#: Rank offset of the start weights: the vocabulary's scores are ranks, and frequencies fall as their inverse.
RANK_OFFSET = 10.0
MARK = "▁".encode()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False


class Vocabulary(NamedTuple):
    """A trie over the pieces' bytes: ``step[node, byte]`` is the next node or 0; ``piece[node]`` a piece number or -1."""

    step: np.ndarray
    piece: np.ndarray
    start_weights: np.ndarray  # natural logs


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The pieces that lower-cased text can hold, and a piece for every single byte; built once for each Python worker."""
    if path in _VOCABULARIES:
        return _VOCABULARIES[path]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name = model.id_to_piece(i)
        piece = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.encode()
        if not any(65 <= b <= 90 for b in piece):
            score = model.get_score(i)
            scores[piece] = max(score, scores.get(piece, -np.inf))
    worst = min(scores.values())
    for b in range(256):
        scores.setdefault(bytes([b]), worst)
    pieces = sorted(scores)
    ranks = np.array([-scores[p] for p in pieces])
    weights = -np.log(np.maximum(ranks, 0) + RANK_OFFSET)
    step, piece = [defaultdict(int)], [-1]
    for number, text in enumerate(pieces):
        node = 0
        for b in text:
            if not step[node][b]:
                step[node][b] = len(step)
                step.append(defaultdict(int))
                piece.append(-1)
            node = step[node][b]
        piece[node] = number
    table = np.zeros((len(step), 256), np.int32)
    for node, following in enumerate(step):
        for b, to in following.items():
            table[node, b] = to
    total = np.log(np.exp(weights).sum())
    _VOCABULARIES[path] = Vocabulary(table, np.array(piece, np.int64), weights - total)
    return _VOCABULARIES[path]


def _add_log(target: np.ndarray, at, values: np.ndarray) -> None:
    target[at] = np.logaddexp(target[at], values)


def forward(words: np.ndarray, own: Vocabulary, weights: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Log marginals of words of one length (rows of bytes), with all lattice edges (start, end, rows, pieces)."""
    n, length = words.shape
    alpha = np.full((length + 1, n), -np.inf)
    alpha[0] = 0.0
    edges = []
    for start in range(length):
        rows, node = np.arange(n), np.zeros(n, np.int64)
        for end in range(start + 1, length + 1):
            node = own.step[node, words[rows, end - 1]]
            going = node > 0
            if not going.all():
                rows, node = rows[going], node[going]
            if not len(rows):
                break
            piece = own.piece[node]
            full = piece >= 0
            hit, number = rows[full], piece[full]
            if len(hit):
                _add_log(alpha[end], hit, alpha[start, hit] + weights[number])
                edges.append((start, end, hit, number))
    return alpha, edges


def expected(words: np.ndarray, counts: np.ndarray, own: Vocabulary, weights: np.ndarray, totals: np.ndarray) -> None:
    """Add the expected piece counts of words of one length to ``totals``."""
    alpha, edges = forward(words, own, weights)
    length, n = len(alpha) - 1, len(words)
    beta = np.full((length + 1, n), -np.inf)
    beta[length] = 0.0
    for start, end, rows, pieces in reversed(edges):
        _add_log(beta[start], rows, beta[end, rows] + weights[pieces])
    for start, end, rows, pieces in edges:
        share = np.exp(alpha[start, rows] + weights[pieces] + beta[end, rows] - alpha[length, rows]) * counts[rows]
        totals += np.bincount(pieces, share, len(totals)).astype(float)


def _by_length(column: pa.Array, rows: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, byte rows) of marked words of equal length; the cells of one step are bounded."""
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(lengths[order])) + 1, [len(order)]]) if len(order) else [0]
    mark = np.frombuffer(MARK, np.uint8)
    for a, b in zip(bounds[:-1], bounds[1:]):
        length = int(lengths[order[a]])
        size = max(1, min(rows, (1 << 20) // (length + len(mark))))
        for lo in range(a, b, size):
            own = order[lo:min(b, lo + size)]
            words = data[offsets[own][:, None] + np.arange(length)]
            yield own, np.concatenate([np.broadcast_to(mark, (len(own), len(mark))), words], axis=1)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct words: how often in training rows."""
    for batch in batches:
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for row, end, data, offsets in chunks(batch.column("text")):
            data = _LOWER[data]
            starts, ends = word_bounds(_WORD[data], offsets)
            if not len(starts):
                continue
            first, inverse, _ = distinct_spans(data, starts, ends)
            trains = ~np.repeat(held[row:end], np.diff(np.searchsorted(starts, offsets)))
            counts = np.bincount(inverse, trains, len(first)).astype(np.int64)
            cut, ofs = gathered(data, starts[first], ends[first] - starts[first])
            yield pa.RecordBatch.from_arrays([binary_array(cut, ofs), pa.array(counts)], names=["word", "c"])


def _expected(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = vocabulary(path), shared.value
        totals = np.zeros(len(weights))
        for batch in batches:
            for rows, words in _by_length(batch.column("word")):
                expected(words, np.ones(len(rows)), own, weights, totals)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], names=["piece", "n"])
    return run


def _marginals(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (weights, n, v) = vocabulary(path), shared.value
        for batch in batches:
            spelled = np.zeros(len(batch))
            for rows, words in _by_length(batch.column("word")):
                spelled[rows] = forward(words, own, weights)[0][-1]
            with np.errstate(divide="ignore"):
                whole = np.log(batch.column("c").to_numpy().astype(float))
            out = np.logaddexp(whole, spelled + np.log(v + 1)) - np.log(n + v + 2)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(out)], names=["word", "c", "logp"])
    return run


def fit(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces, fitted to all words with a count ``c``; a row for each piece reaches the driver."""
    spark, weights = words.sparkSession, vocabulary(path).start_weights
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)
        found = words.where("c > 0").mapInArrow(_expected(path, shared), "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = np.full(len(weights), PSEUDO)
        for r in found.collect():
            counts[r.piece] += r.n
        weights = np.log(counts / counts.sum())
    return weights


def _scored(shared):
    """Sum what the broadcast table knows of each text; its other words go on with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, logp, trained = shared.value
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                data = _LOWER[data]
                starts, ends = word_bounds(_WORD[data], offsets)
                bounds = np.searchsorted(starts, offsets)
                n = end - row
                text = np.repeat(np.arange(n), np.diff(bounds))
                some, number, hashes = distinct_spans(data, starts, ends)
                at = known.find(data, starts[some], ends[some], hashes)[number] if len(starts) else np.zeros(0, np.int64)
                found = at >= 0
                sums = [np.bincount(text[found], values[at[found]], n).astype(float) for values in (base, logp, trained)]
                rest = np.flatnonzero(~found)
                # One entry for each text and distinct word.
                pair, first, counts = np.unique(np.stack([text[rest], number[rest]]), axis=1, return_index=True, return_counts=True) \
                    if len(rest) else (np.zeros((2, 0), np.int64), rest, rest)
                own = rest[first]
                cut, ofs = gathered(data, starts[own], ends[own] - starts[own])
                limits = np.searchsorted(pair[0], np.arange(n + 1))
                entries = pa.StructArray.from_arrays([binary_array(cut, ofs), pa.array(counts, pa.int64())], names=["word", "n"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(row, n), pa.array(np.diff(bounds) + 1, pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                    pa.array(sums[2].astype(np.int64)), pa.ListArray.from_arrays(pa.array(limits, pa.int32()), entries),
                ], names=["row", "n_tokens", "base", "logp", "n_known", "rest"])
    return run


def _table(rows: pa.Table, n: int, v: int) -> tuple[SpanTable, np.ndarray, np.ndarray, np.ndarray]:
    """The words, and their base score, log marginal and whether training rows hold them."""
    column = rows.column("word").combine_chunks().cast(pa.large_binary())
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    counts = rows.column("c").to_numpy()
    return SpanTable(data, offsets), np.log10((counts + 1) / (n + v + 1)), rows.column("logp").to_numpy(), (counts > 0).astype(float)


def score(docs: DataFrame, held_out: F.Column, path: str, *, keep: list[str], text: str = "text", frequent: int = FREQUENT,
          rounds: int = ROUNDS) -> DataFrame:
    """``row`` (struct of the kept columns), held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    df = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), held_out.alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    found = df.select("held_out", "text").mapInArrow(_word_rows, "word binary, c bigint")
    words = materialized(found.groupBy("word").agg(F.sum("c").alias("c")), "lattice-words")
    ends = df.where("not held_out").count()
    used, total = words.where("c > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    n, v = total + ends, used + (1 if ends else 0)  # the end is a token too
    weights = fit(words, path, rounds) if used else vocabulary(path).start_weights
    end = float(np.log((ends + 1) / (n + v + 2)))
    shared = spark.sparkContext.broadcast((weights, n, v))
    scored = materialized(words.mapInArrow(_marginals(path, shared), "word binary, c bigint, logp double"), "lattice-marginals")
    top = spark.sparkContext.broadcast(_table(most_frequent(scored, frequent, "c").toArrow(), n, v))
    kind = df.schema["row"].dataType.simpleString()
    partial = df.select(F.struct("row", "held_out").alias("row"), "text").mapInArrow(
        _scored(top), f"row struct<row:{kind},held_out:boolean>, n_tokens bigint, base double, logp double, n_known bigint, rest array<struct<word:binary,n:bigint>>")
    partial = materialized(partial.withColumn("number", F.monotonically_increasing_id()), "lattice-texts")
    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    tail = partial.select("number", F.explode("rest").alias("e")).select("number", "e.word", "e.n").join(scored, "word").groupBy("number").agg(
        F.sum(F.col("n") * base).alias("more_base"), F.sum(F.col("n") * F.col("logp")).alias("more_logp"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    zero = F.lit(0.0)
    end_base = float(np.log10((ends + 1) / (n + v + 1)))
    return partial.join(tail, "number", "left").select(
        "row.row", "row.held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) + F.lit(end_base)).alias("base_score"),
        ((F.col("logp") + F.coalesce("more_logp", zero) + F.lit(end)) / F.lit(float(np.log(10)))).alias("score"))
