"""Words of equal hash: told apart by their bytes, whatever the hash."""

from __future__ import annotations

import base64
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fingerloom.llm import bpe, common, fmindex, lattice
from fingerloom.llm.common import SpanTable, buffers, crc_split
from fingerloom.llm.queries import byte_bpe
from llm_helpers import docs


def thue_morse(n: int, a: str = "a", b: str = "b") -> tuple[str, str]:
    """Two words of 2**n letters that collide in every polynomial hash modulo a power of two."""
    bits = [bin(k).count("1") & 1 for k in range(1 << n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.fixture
def weak(monkeypatch):
    """A hash that knows little more than the length."""
    poor = lambda data, starts, ends, own_lanes=None: ((ends - starts) & 1).astype(np.uint64)
    for module in (common, fmindex):
        monkeypatch.setattr(module, "word_hash", poor)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\x00é"), max_size=20) | st.sampled_from(["a" * 255, "a" * 256, "a" * 257, "a" * 256 + "b", "\x00" * 8, "\x00" * 9]), max_size=30), st.booleans())
def test_distinct_spans(texts, poor):
    whole = common.word_hash
    if poor:
        common.word_hash = lambda data, starts, ends, own_lanes=None: ((ends - starts) & 1).astype(np.uint64)
    try:
        data, ofs = buffers(pa.array(texts, pa.large_string()))
        first, inverse, hashes = common.distinct_spans(data, ofs[:-1], ofs[1:])
        assert [texts[i] for i in first[inverse]] == texts and len(first) == len(set(texts)) == len(hashes)
        table = SpanTable(*buffers(pa.array([texts[i] for i in first[::2]], pa.large_string())))
        found = table.find(data, ofs[:-1], ofs[1:], common.word_hash(data, ofs[:-1], ofs[1:]))
        known = [texts[i] for i in first[::2]]
        assert [known[i] if i >= 0 else None for i in found] == [t if t in known else None for t in texts]
    finally:
        common.word_hash = whole


def reference():
    with open(byte_bpe()[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=byte_bpe()[1], mergeable_ranks=ranks, special_tokens={})


TEXTS = ["one two three two one", "six ten new one", "", "ünï one 漢字 two", "tow two owt one"]


def test_bpe_with_a_weak_hash(weak):
    own, want = bpe.tokenizer(*byte_bpe()), reference()
    data, offsets = buffers(pa.array(TEXTS, pa.large_string()))
    words = [w.encode() for w in (" two", "one", " owt")]
    ids = [np.array(want.encode_ordinary(w.decode()), np.int64) for w in words]
    table = (SpanTable(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])), np.concatenate(ids), np.cumsum([0, *map(len, ids)]))
    out, ofs = bpe.encoded_block(data, offsets, own, table)
    assert [out[a:b].tolist() for a, b in zip(ofs[:-1], ofs[1:])] == [want.encode_ordinary(t) for t in TEXTS]


def test_phrases_with_a_weak_hash(weak):
    phrases = fmindex.Phrases([("x", "two"), ("y", "owt"), ("z", "six ten")])
    n, spans, items = fmindex.shard_hits(*buffers(pa.array(TEXTS, pa.large_string())), phrases)
    assert n.tolist() == [5, 4, 0, 4, 4] and items == [{"x"}, {"z"}, set(), {"x"}, {"x", "y"}]


def test_word_counts_with_a_weak_hash(weak):
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array([False, True, False, False, True])], names=["text", "held_out"])
    got = {w.decode(): c for b in lattice._word_rows(iter([batch])) for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist())}
    assert got == {"one": 3, "two": 3, "three": 1, "six": 0, "ten": 0, "new": 0, "ünï": 1, "漢字": 1, "tow": 0, "owt": 0}


@pytest.mark.parametrize("partitions", [1, 2])
def test_colliding_pair_through_the_operators(spark, partitions):
    """In one block and in two: the two words of a pair that a polynomial hash can't tell apart."""
    x, y = thue_morse(10)
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2]
    texts, ids = [x, y, f"{x} {y}", y], held[:2] + [k for k in range(200) if k not in held][:2]
    frame = docs(spark, texts, ids).repartition(partitions)
    want = reference()
    got = {r.row.doc_id: (list(r.ids), bytes(r.decoded).decode()) for r in bpe.decode(bpe.encode(frame, *byte_bpe(), keep=["doc_id"]), *byte_bpe()).collect()}
    assert got == {i: (want.encode_ordinary(t), t) for i, t in zip(ids, texts)}
    items = spark.createDataFrame([("x", x), ("y", y)], "item_id string, text string")
    found = {r.row.doc_id: sorted(r["items"]) for r in fmindex.contamination(frame, items, keep=["doc_id"]).collect()}
    assert found == {ids[0]: ["x"], ids[1]: ["y"], ids[2]: ["x", "y"], ids[3]: ["y"]}
    rows = {r.row.doc_id: r for r in lattice.score(frame, crc_split(F.col("doc_id"), 7) == 2, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], rounds=1).collect()}
    # Training: the third and fourth text hold x once, y twice, and two ends.
    n, v = 5, 3
    base = lambda *c: sum(math.log10((k + 1) / (n + v + 1)) for k in c)
    assert [rows[i].n_known for i in ids] == [2, 2, 3, 2]
    assert [rows[i].base_score for i in ids] == pytest.approx([base(1, 2), base(2, 2), base(1, 2, 2), base(2, 2)])
