"""SimHash near-duplicates through deletion-variant signatures.

Sixty-four bits that may differ in four places are cut into only three segments, so that one of them differs in at most
one place. Every distinct fingerprint is indexed under each segment, whole and with each of its bits in turn made a
wildcard, and with one part of the other bits that must agree as well (see :func:`signatures`). Two fingerprints within
four bits share a signature, so an equality grouping on signatures finds them and the whole fingerprints verify them.

Exact copies are one fingerprint before anything is shuffled by signature. Within a signature's group only a spanning
forest of the links is kept, never all pairs: a breadth-first search compares the members of its frontier to the members
not yet reached. Signatures with more than ``block`` members are split into pairs of blocks, so no task holds an unbounded group.

Defined results: NULL, empty and word-less texts have fingerprint zero, which links like any other; repeated rows stay
repeated and share a component; a NULL doc_id never names a component unless all its members' ids are NULL; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.llm.components import components
from fingerloom.llm.common import chunks
from fingerloom.session import materialized

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = (22, 21, 21)
BLOCK = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 majority bits of the XXH64 of all word shingles of a text, repeats included."""
    words = text.lower().split()  # of bytes: A-Z, and white space x20 x09-x0D
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
    ones, size = np.zeros(64, np.int64), 1 << 14
    for at in range(0, len(hashes), size):
        bits = np.unpackbits(hashes[at: at + size].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The kept columns as struct ``row``, and the fingerprint as a signed 64-bit number."""
    df = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                raw = data.tobytes()
                prints = [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(first, end - first), pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64()),
                ], names=["row", "fp"])

    return df.mapInArrow(run, f"row {df.schema['row'].dataType.simpleString()}, fp bigint")


def signatures(prints: np.ndarray) -> np.ndarray:
    """All signatures of the fingerprints, a row for each: which segment, bit and part it is, and the bits that must agree.

    If a segment agrees whole, the other bits differ in at most four places, and one of five parts of them agrees. If it
    differs in one bit, the others differ in at most three, and one of four parts agrees. A signature therefore holds the
    segment, whole or with one bit cleared, and one part: 30 bits and more, so that few unlike fingerprints share one.
    """
    out, low = [], 0
    for k, width in enumerate(SEGMENTS):
        low += width
        turned = prints if low == 64 else (prints >> np.uint64(low)) | (prints << np.uint64(64 - low))
        segment = turned >> np.uint64(64 - width)
        for wildcard in range(-1, width):
            own = segment if wildcard < 0 else segment & np.uint64(((1 << width) - 1) & ~(1 << wildcard))
            parts = MAX_BITS + 1 if wildcard < 0 else MAX_BITS
            bounds = [(64 - width) * j // parts for j in range(parts + 1)]
            for j, (a, b) in enumerate(zip(bounds, bounds[1:])):
                part = (turned >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
                tag = np.uint64(((k * 32 + wildcard + 1) * 8 + j) << 34)
                out.append(tag | (own << np.uint64(12)) | part)
    return np.stack(out, axis=1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            prints = batch.column("fp").to_numpy()[at: at + 2000]
            found = signatures(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays([
                pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(prints, found.shape[1]), pa.int64())], names=["sig", "fp"])


def forest(prints: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links (two member numbers) that span the groups of members which chains within ``max_bits`` connect."""
    links, unreached = [], np.arange(len(prints))
    while len(unreached):
        frontier, unreached = [int(unreached[0])], unreached[1:]
        root = frontier[0]
        while frontier and len(unreached):
            at = frontier.pop()
            near = np.bitwise_count(prints[unreached] ^ prints[at]) <= max_bits
            if near.any():
                reached = unreached[near]
                links += [(root, int(j)) for j in reached]
                frontier += reached.tolist()
                unreached = unreached[~near]
    return links


def _group_links(group: np.ndarray, prints: np.ndarray, max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within the runs of equal ``group``; all members of a run are here."""
    out = []
    bounds = np.flatnonzero(group[1:] != group[:-1]) + 1
    starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(group)]])
    sizes = ends - starts
    two = starts[sizes == 2]
    near = np.bitwise_count(prints[two] ^ prints[two + 1]) <= max_bits
    if near.any():
        out.append(np.stack([prints[two][near], prints[two + 1][near]], axis=1))
    for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
        own = np.unique(prints[s:e])
        links = forest(own, max_bits)
        if links:
            out.append(own[np.array(links)])
    if out:
        pairs = np.unique(np.concatenate(out).view(np.int64), axis=0)
        yield _rows(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])


def _rows(large: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(large.astype(bool)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["large", "a", "b"])


def _linked(max_bits: int, block: int | None):
    """Over rows sorted by ``sig``: links (a, b) of each group; members of a group of over ``block`` come out as (sig, fp)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sig, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        passing = None  # the group that is larger than a block and goes on
        for batch in batches:
            sig = np.concatenate([held_sig, batch.column("sig").to_numpy()])
            prints = np.concatenate([held, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(sig):
                continue
            if passing is not None:
                n = int(np.searchsorted(sig, passing, "right"))
                yield _rows(np.ones(n), sig[:n], prints[:n].view(np.int64))
                passing = passing if n == len(sig) else None
                sig, prints = sig[n:], prints[n:]
                held_sig, held = sig[:0], prints[:0]
                if not len(sig):
                    continue
            bounds = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1, [len(sig)]])
            large = np.repeat(np.diff(bounds) > block, np.diff(bounds)) if block else np.zeros(len(sig), bool)
            cut = int(bounds[-2])  # the last group may go on
            if large.any():
                yield _rows(np.ones(int(large.sum())), sig[large], prints[large].view(np.int64))
            if large[-1]:
                passing, held_sig, held = sig[-1], sig[:0], prints[:0]
            else:
                held_sig, held = sig[cut:], prints[cut:]
            done = ~large[:cut]
            if done.any():
                yield from _group_links(sig[:cut][done], prints[:cut][done], max_bits)
        if len(held):
            yield from _group_links(held_sig, held, max_bits)
    return run


def links(distinct: DataFrame, *, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) whose closure is that of all pairs within ``max_bits``."""
    if max_bits > MAX_BITS:
        raise ValueError(f"The signatures find differences of at most {MAX_BITS} bits.")
    schema = "large boolean, a bigint, b bigint"
    keyed = distinct.select("fp").mapInArrow(_signed, "sig bigint, fp bigint")
    found = materialized(keyed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_linked(max_bits, block), schema), "simhash-groups")
    # A group of more than a block is dealt into pairs of blocks: a member of block i goes to all pairs that hold i.
    members = found.where("large").select(F.col("a").alias("sig"), F.col("b").alias("fp"))
    sizes = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    dealt = members.join(sizes, "sig").select("fp", F.explode(pairs).alias("pair"), "sig").select("fp", F.xxhash64("sig", "pair").alias("sig"))
    split = dealt.repartition("sig").sortWithinPartitions("sig").mapInArrow(_linked(max_bits, None), schema)
    return found.where("not large").union(split).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, keep: list[str], id_column: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """For each document ``row`` (the kept columns), ``fp``, ``root`` (the component's least fingerprint) and
    ``component_id``, the smallest id reachable by links.
    """
    if id_column not in keep:
        keep = [*keep, id_column]
    prints = materialized(fingerprints(docs, keep=keep, text=text, shingle=shingle), "simhash")
    distinct = materialized(prints.groupBy("fp").agg(F.min(F.col("row").getField(id_column)).alias("least")), "simhash-distinct")
    found = materialized(links(distinct.select("fp"), max_bits=max_bits, block=block), "simhash-links")
    roots = components(found)  # node, root
    least = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.select("fp", "root").join(by_root, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("row", "fp", "root", "component_id")


def hex_digits(column: F.Column) -> F.Column:
    """Sixteen lowercase hexadecimal digits of a 64-bit number."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
