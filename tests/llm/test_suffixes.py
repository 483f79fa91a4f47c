from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from fingerloom.llm import suffixes
from llm_helpers import docs, words


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(b), sum(covered), spans, bytes(x for x, c in zip(b, covered) if not c)))
    return out


def texts_of(seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (30, 60, 100, 150, 400)]
    texts = [None, "", "short", "x" * 5000, "ab" * 700, "From " * 400, "ünï " * 200, words(rng, 20_000, "abc")]
    for _ in range(40):
        parts = [words(rng, rng.randint(1, 60)) for _ in range(3)]
        p = rng.choice(passages)
        a = rng.randrange(len(p) // 2)
        texts.append(" ".join([parts[0], p[a:], parts[1], rng.choice(passages), parts[2]]))
    texts += [t.replace("a", "é", 1) for t in texts[10:20]] + texts[20:26] + texts[3:6] * 2
    return texts


@pytest.mark.parametrize(("batches", "group", "length", "seed"), [(2, 2000, 200, 32), (1, 2000, 200, 32), (5, 3, 60, 20)])
def test_equals_brute_force(spark, monkeypatch, batches, group, length, seed):
    texts = texts_of(batches)
    frame = docs(spark, texts, [i if i % 7 else None for i in range(len(texts))]).repartition(5)
    got = suffixes.without_repeats(frame, keep=["doc_id", "text", "fp"], batches=batches, group=group, length=length, seed=seed).collect()
    order = lambda x: str(x)
    have = sorted([(r.row.doc_id, r.row.text, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got], key=order)
    want = sorted([(i if i % 7 else None, t, *b) for i, (t, b) in enumerate(zip(texts, brute(texts, length)))], key=order)
    assert have == want


def test_many_copies_beside_pairs_of_one_seed(spark):
    """Pairs that share 200 bytes with each other, and the seed with a text of 10,000 copies as well."""
    rng = random.Random(11)
    passage = words(rng, 100)[:190]
    hot = words(rng, 15) + passage + words(rng, 15)
    texts = [hot] * 10_000
    for k in range(12):
        shared = passage + chr(ord("A") + k) + words(rng, 9)[:9]
        texts += [words(rng, 40) + "<" + shared + ">" + words(rng, 40), words(rng, 40) + "[" + shared + "]" + words(rng, 40)]
    rng.shuffle(texts)
    got = suffixes.without_repeats(docs(spark, texts), keep=["doc_id"]).collect()
    have = {r.row.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got}
    assert have == dict(enumerate(brute(texts, 200)))
    assert sum(spans for _, _, spans, _ in have.values()) == 10_024


def test_whole_characters(spark):
    rng = random.Random(4)
    passage = "ü" * 150
    texts = [words(rng, 20) + "é" + passage + "à" + words(rng, 20), words(rng, 20) + "è" + passage + "á" + words(rng, 9)]
    for r in suffixes.without_repeats(docs(spark, texts), keep=["doc_id"], whole_characters=True).collect():
        assert "ü" not in bytes(r.kept).decode() and bytes(r.kept).decode().count("é") + bytes(r.kept).decode().count("è") == 1


def test_empty_table(spark):
    assert suffixes.without_repeats(docs(spark, []), keep=["doc_id"]).collect() == []


def test_levels_grow_with_the_logarithm(spark):
    rng = random.Random(9)
    family, shared = suffixes.SuffixFamily(), words(rng, 80)
    hits = 0
    for k in range(6):
        frame = docs(spark, [words(rng, 90) + shared + words(rng, 90)]).selectExpr(f"{k}L AS key", "text")
        found = family.add(frame.mapInArrow(suffixes._sample_rows(200, 32), suffixes.SAMPLED))
        hits += found.where(f"key = {k}").count() > 0
    assert hits == 5 and [size for size, _ in family.levels] == [4, 2]


def test_query(spark, sf):
    from fingerloom.llm.queries import QUERIES

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_array_dedup"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for r, (n, removed, spans, kept) in zip(rows, brute([r.text for r in rows], 200)):
        assert got[r.doc_id] == (n, removed, spans, hashlib.sha256(kept).hexdigest())
