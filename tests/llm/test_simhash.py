from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from fingerloom.llm import simhash
from llm_helpers import docs, lower, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(prints))]


def check(spark, texts, ids, **options):
    df = simhash.near_duplicates(docs(spark, texts, ids), keep=["doc_id", "text", "fp"], **options)
    got = sorted([(r.row.doc_id, r.row.text, r.fp % (1 << 64), r.component_id) for r in df.collect()], key=str)
    prints = [print_of(t) for t in texts]
    assert got == sorted(zip(ids, texts, prints, brute_components(prints, ids)), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    base = [words(rng, n) for n in (60, 200, 700)]
    texts = [None, "", " \t\n", "One", "one", "a b c", "a b c d", "ünï a b", "x" * 200_000, words(rng, 20_000), *base, *base]
    for text in base:
        for _ in range(25):
            w = text.split()
            w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    ids = [i * 7 % 1000 for i in range(len(texts))]
    ids[3], ids[5] = None, ids[6]
    check(spark, texts, ids)
    check(spark, texts, ids, block=4)


def test_empty_table(spark):
    check(spark, [], [])


def test_chains_of_planted_fingerprints(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in prints[:20]:
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
            prints.append(p)
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp bigint")
    want = brute_components(prints, list(range(len(prints))))
    for block in (4096, 3):
        got = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(frame, block=block)).collect()}
        groups = {}
        for p, w in zip(prints, want):
            groups.setdefault(w, set()).add(got.get(p, p))
        assert all(len(g) == 1 for g in groups.values())
        assert len({min(g) for g in groups.values()}) == len(groups)


def test_query(spark, sf):
    from fingerloom.llm.queries import QUERIES

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash_near_dedup"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [print_of(r.text) for r in rows]
    want = brute_components(prints, [r.doc_id for r in rows])
    assert got == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, want)}
