from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fingerloom.llm import bpe
from fingerloom.llm.common import SpanTable, buffers
from fingerloom.llm.queries import QUERIES, byte_bpe
from llm_helpers import docs, words

PATTERN = regex.compile(public_tokenizers.PATTERN)
CHARS = st.sampled_from(list("abstrevmldDS'' \n\t\r1٣é漢 !\x1c\x85\xa0　_-🙂́"))


@pytest.fixture(scope="module")
def reference():
    with open(byte_bpe()[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=byte_bpe()[1], mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(CHARS, max_size=25) | st.text(max_size=12), max_size=6))
def test_pre_tokens(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    bounds, first = bpe.pre_tokens(data, offsets)
    got = [[data[bounds[i]:bounds[i + 1]].tobytes().decode() for i in range(a, b)] for a, b in zip(first[:-1], first[1:])]
    assert got == [PATTERN.findall(t) for t in texts]


def test_all_characters_alone(reference):
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c}1{c} {c}{c}b" for c in points)
    own = bpe.tokenizer(*byte_bpe())
    data, offsets = buffers(pa.array([text], pa.large_string()))
    ids, _ = bpe.encoded_block(data, offsets, own, (SpanTable(np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(0, np.int64), np.zeros(1, np.int64)))
    assert ids.tolist() == reference.encode_ordinary(text)


@pytest.mark.parametrize("size", [1 << 19, 20])
def test_round_trip(spark, reference, size):
    rng = random.Random(6)
    texts = [None, "", " ", "\n\n  x", "don't 've 'LL ''s", "<|endoftext|> ok", "x" * 100_000, words(rng, 20_000), "ünï 漢字 🙂 " * 50, "\x00\x7f"]
    texts += [words(rng, 50) for _ in range(20)] + texts[:5]
    frame = docs(spark, texts, [i or None for i in range(len(texts))]).repartition(3)
    encoded = bpe.encode(frame, *byte_bpe(), keep=["doc_id", "text", "row"], size=size)
    rows = bpe.decode(encoded, *byte_bpe()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == reference.encode_ordinary(r.row.text or "")
        assert bytes(r.decoded) == (r.row.text or "").encode()
    assert bpe.encode(frame.limit(0), *byte_bpe(), keep=["doc_id"]).collect() == []


def test_query(spark, sf, reference):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_byte_level_bpe"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = reference.encode_ordinary(r.text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id] == (len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest())
