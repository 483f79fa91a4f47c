"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of whole documents of about ``CHUNK_BYTES`` bytes. Its words become symbols: 0 for every word that no
test phrase holds, which is where no phrase can go on, and stretches shorter than the shortest phrase shrink to one 0. The
shard's Burrows-Wheeler transform stands in a wavelet matrix, test phrases are found by backward search through its
ranks, all at once, and every occurrence is located by walking to a sampled suffix position. Spans of an occurrence
are merged for each document. Nothing is shuffled: a document's result is complete where its shard is indexed.

The benchmark is the query set. It reaches the tasks in blocks of at most ``block_words`` words (or of one longer item);
a further block is a further pass over the shards, so what is broadcast never grows with either table.

Defined results: NULL or word-less text has no words, is not contaminated and matches nothing; repeated rows are judged
each for itself; repeated items count once by id, and an item whose id is NULL marks words but is not listed; an empty
benchmark marks nothing; extra columns of any name are ignored or, if kept, carried through unchanged.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.llm.common import CHUNK_BYTES, SpanTable, chunks, distinct_spans, gathered, word_bounds, word_hash
from fingerloom.session import materialized

WINDOW = 13
BLOCK_WORDS = 200_000
SAMPLE = 16

#: Lower-cases A-Z; word bytes are digits, letters and everything beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Phrases:
    """The distinct windows of a block of items, as rows of word symbols, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        text = pa.array([t or "" for _, t in items], pa.large_string())
        seen, bounds, symbols = defaultdict(set), np.zeros(len(items) + 1, np.int64), np.zeros(0, np.int64)
        words, limits = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        for _, _, data, offsets in chunks(text, 1 << 62):
            data = _LOWER[data]
            starts, ends = word_bounds(_WORD[data], offsets)
            first, inverse, _ = distinct_spans(data, starts, ends)
            words, limits = gathered(data, starts[first], ends[first] - starts[first])
            bounds, symbols = np.searchsorted(starts, offsets), inverse + 1
        #: The words of the phrases; a word's symbol is its number in the table plus one.
        self.table, self.size = SpanTable(words, limits), len(limits) - 1
        for k, (item, _) in enumerate(items):
            row = symbols[bounds[k]: bounds[k + 1]]
            for at in range(max(1, len(row) - window + 1) if len(row) else 0):
                seen[tuple(row[at: at + window].tolist())].add(item)
        by_length = defaultdict(list)
        for phrase in seen:
            by_length[len(phrase)].append(phrase)
        self.groups = [(length, np.array(rows, np.int64), [seen[r] - {None} for r in rows]) for length, rows in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions in suffix order, by prefix doubling; beyond the end counts as smallest."""
    n, h = len(symbols), 1
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        place = np.concatenate([[1], 1 + np.cumsum(key[1:] != key[:-1])])
        rank[order] = place
        if place[-1] == n or h >= n:
            return order
        h *= 2


class FMIndex:
    """Backward search and location over a symbol sequence in which 0 parts the stretches."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE):
        self.n = len(symbols)
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        kept = (order % sample == 0) | (self.bwt == 0) | (order == 0)
        self.sampled, self.samples = kept, order[kept]
        self.sample_rank = np.concatenate([[0], np.cumsum(kept)])
        self.levels, current = [], self.bwt
        for bit in reversed(range(max(1, (alphabet - 1).bit_length()))):
            ones = (current >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]).astype(np.int32), self.n - int(ones.sum())))
            current = np.concatenate([current[ones == 0], current[ones == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end in the transform: one step down the wavelet matrix a bit."""
        low, high = np.zeros(len(ends), np.int64), ends.astype(np.int64)
        for bit, ones, zeros in self.levels:
            up = ((symbols >> bit) & 1).astype(bool)
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase numbers, first rows, end rows) of the phrases of one length that occur."""
        alive = np.flatnonzero((np.diff(self.below)[phrases] > 0).all(axis=1))
        last = phrases[alive, -1]
        first, end = self.below[last], self.below[last + 1]
        for at in range(phrases.shape[1] - 2, -1, -1):
            symbol = phrases[alive, at]
            first = self.below[symbol] + self.rank(symbol, first)
            end = self.below[symbol] + self.rank(symbol, end)
            keep = end > first
            alive, first, end = alive[keep], first[keep], end[keep]
        return alive, first, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows: walk left until a sampled position."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            symbol = self.bwt[rows]
            rows = self.below[symbol] + self.rank(symbol, rows)
            steps += 1
        return out


def shard_hits(data: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[set]]:
    """Of one shard's documents: word counts, merged hit spans (word numbers), and the items found."""
    data = _LOWER[data]
    starts, ends = word_bounds(_WORD[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    n = np.diff(bounds)
    spans, items = [(np.zeros(0, np.int64),) * 2] * len(n), [set() for _ in n]
    if not phrases.shortest or not len(starts):
        return n, spans, items
    at = phrases.table.find(data, starts, ends, word_hash(data, starts, ends))
    known = at >= 0
    run_starts, run_ends = word_bounds(known, bounds)
    long = run_ends - run_starts >= phrases.shortest
    run_starts, lengths = run_starts[long], (run_ends - run_starts)[long]
    if not len(run_starts):
        return n, spans, items
    # The stretches one after another, a 0 after each; `word` maps back to word numbers.
    word, ofs = gathered(np.arange(len(starts)), run_starts, lengths)
    symbols = np.zeros(len(word) + len(lengths), np.int64)
    place = np.arange(len(word)) + np.repeat(np.arange(len(lengths)), lengths)
    symbols[place] = at[word] + 1
    number = np.full(len(symbols), -1)
    number[place] = word
    index = FMIndex(symbols, phrases.size + 1)
    doc_of = np.repeat(np.arange(len(n)), n)
    opened = np.zeros(len(starts) + 1, np.int64)
    for length, rows, owners in phrases.groups:
        found, first, end = index.search(rows)
        counts = end - first
        hits = number[index.locate(gathered(np.arange(index.n), first, counts)[0])] if len(found) else np.zeros(0, np.int64)
        # Symbols stand for words whose bytes were compared, so an occurrence of the symbols is one of the words.
        for phrase, own in zip(found, np.split(hits, np.cumsum(counts)[:-1])):
            np.add.at(opened, own, 1)
            np.add.at(opened, own + length, -1)
            for d in np.unique(doc_of[own]):
                items[d] |= owners[phrase]
    hit = np.cumsum(opened)[:-1] > 0
    a, b = word_bounds(hit, bounds)
    cut = np.searchsorted(a, bounds)
    for d in np.flatnonzero(np.diff(cut)):
        spans[d] = (a[cut[d]:cut[d + 1]] - bounds[d], b[cut[d]:cut[d + 1]] - bounds[d])
    return n, spans, items


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple]]:
    """The query set in blocks; one block at a time stands in the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{item}`").cast("string"), F.col(f"`{text}`").cast("string"))
    for name, value in rows.toLocalIterator():
        words = len(value) // 2 + 1 if value else 0
        if block and size + words > block_words:
            yield block
            block, size = [], 0
        block.append((name, value))
        size += words
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document: ``row`` (a struct of the kept columns), n_words, n_hit, spans, items.

    ``spans`` are the merged removal spans as word numbers (start, end); ``items`` the ids of the benchmark items with
    an occurring window, in text order.
    """
    spark = docs.sparkSession
    state = "spans array<struct<start:bigint,end:bigint>>, items array<string>"
    df = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"),
                     F.lit(0).cast("bigint").alias("n_words"),
                     F.expr("array() :: array<struct<start:bigint,end:bigint>>").alias("spans"), F.expr("array() :: array<string>").alias("items"))
    kind = df.schema["row"].dataType.simpleString()
    blocks = _blocks(benchmark, item, item_text, block_words)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(Phrases(block, window))
        df = df.mapInArrow(_search(shared), f"row {kind}, text string, n_words bigint, {state}")
        if following is None:
            break
        df, block = materialized(df, "decontaminate"), following
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return df.select("row", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text"), CHUNK_BYTES):
                part = batch.slice(first, end - first)
                n, spans, items = shard_hits(data, offsets, phrases)
                old = zip(part.column("spans").to_pylist(), part.column("items").to_pylist())
                merged = [(_merged(was, a, b), sorted({*had, *new})) for (was, had), (a, b), new in zip(old, spans, items)]
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("text"), pa.array(n, pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s, _ in merged], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([i for _, i in merged], pa.list_(pa.string())),
                ], names=["row", "text", "n_words", "spans", "items"])
    return run


def _merged(was: list[dict], starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    spans = [(int(a), int(b)) for a, b in zip(starts, ends)]
    if not was:
        return spans
    out: list[tuple[int, int]] = []
    for a, b in sorted([(s["start"], s["end"]) for s in was] + spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def items_digest(items: list[str]) -> str:
    """SHA-256 of the ids, sorted as strings, joined by commas."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contaminated(min_part: int = 20) -> F.Column:
    """Whether at least one word in ``min_part`` is hit."""
    return (F.col("n_hit") > 0) & (min_part * F.col("n_hit") >= F.col("n_words"))
