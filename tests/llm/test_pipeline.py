from __future__ import annotations

import hashlib
from collections import Counter

import pytest

import corpus_pipeline as P
from test_decontamination import brute as contamination
from test_rules import brute as statistics
from test_simhash import brute_components, print_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows before the first and after every stage."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = [df.collect()]
    for _, stage in P.STAGES:
        df = P.materialized(stage(spark, df, sf), "test")
        out.append(df.collect())
    return out


def test_quality(stages):
    before, after = stages[0], stages[1]
    kept = {r.doc_id for r in after}
    passing = {r.doc_id for r in before if not statistics(r.text)[-1]}
    assert kept <= passing and list(after[0].asDict()) == COLUMNS
    assert len(kept) > 0.8 * len(passing)


def test_near_dedup(stages):
    before, after = stages[1], stages[2]
    ids = [r.doc_id for r in before]
    want = {d for d, c in zip(ids, brute_components([print_of(r.text) for r in before], ids)) if c == d}
    assert sorted(r.doc_id for r in after) == sorted(want) and list(after[0].asDict()) == COLUMNS


def test_passages(stages):
    before, after = stages[2], {r.doc_id: r for r in stages[3]}
    raw = {r.doc_id: r.text.encode() for r in before}
    seen = Counter(b[i:i + 200] for b in raw.values() for i in range(len(b) - 199))
    assert set(raw) == set(after)
    for d, b in raw.items():
        covered = bytearray(len(b) + 1)
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                covered[i:i + 200] = b"\1" * 200
        at, text = 0, b""
        while at < len(b):
            end = at
            while end < len(b) and covered[end] == covered[at]:
                end += 1
            a, z = at, end
            if covered[at]:
                while a < z and b[a] & 0xC0 == 0x80:
                    a += 1
                while z > a and z < len(b) and b[z] & 0xC0 == 0x80:
                    z -= 1
                text += b[at:a] + b[z:end]
            else:
                text += b[at:end]
            at = end
        assert after[d].text == text.decode() and after[d].n_chars == len(after[d].text)


def test_contamination(stages, spark, sf):
    before, after = stages[3], stages[4]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [r.doc_id for r, (n, hit, _) in zip(before, contamination([r.text for r in before], items)) if not (hit and 20 * hit >= n)]
    assert sorted(r.doc_id for r in after) == sorted(clean)


def test_tokens(stages):
    before, after = {r.doc_id: r for r in stages[4]}, stages[5]
    assert len(before) == len(after)
    for r in after:
        assert r.text == before[r.doc_id].text and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_is_all_stages(spark, sf, stages):
    got = {(r.doc_id, r.ids_sha256) for r in P.run(spark, sf).collect()}
    assert got == {(r.doc_id, r.ids_sha256) for r in stages[5]}


def test_awkward_tables(spark, sf):
    rows = [(None, None, None, None, None, "x", 1), (1, "", "en", "s", 0, "x", 1), (1, "a b " * 40, "en", "s", 160, "x", 1)] * 2
    rows += [(i, " ".join(f"w{i}x{k}" for k in range(80)), "en", "s", 9, "x", 2) for i in (5, 6, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, n_tokens int"
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = frame.count()
        for _, stage in P.STAGES:
            got = stage(spark, frame, sf)
            assert got.count() <= n
            if stage is not P.byte_level_bpe:
                assert got.columns == frame.columns
        kept = P.simhash_near_dedup(spark, frame, sf).count()
        assert kept == (5 if n else 0)
