from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from fingerloom.llm import fmindex
from llm_helpers import docs, lower, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts, items, window=13):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for length in {len(k) for k in windows}:
            for i in range(len(w) - length + 1):
                if (own := windows.get(tuple(w[i:i + length]))) is not None:
                    hit |= set(range(i, i + length))
                    found |= own - {None}
        out.append((len(w), len(hit), sorted(str(i) for i in found)))
    return out


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def result(spark, texts, items, **options):
    df = fmindex.contamination(docs(spark, texts), items_of(spark, items), keep=["doc_id", "row", "n_words"], **options)
    rows = sorted(df.collect(), key=lambda r: r.row.doc_id)
    assert all(r.row.n_words == "n" for r in rows)
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in rows)
    return [(r.n_words, r.n_hit, sorted(r["items"])) for r in rows]


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_equals_brute_force(spark, block_words):
    rng = random.Random(3)
    items = [(i, words(rng, n)) for i, n in enumerate([40, 13, 14, 3, 1, 5, 30])]
    items += [(7, None), (8, ""), (9, " .. "), (2, items[2][1]), (10, items[0][1]), (None, words(rng, 20)), (11, "Ünï cödé 漢字 " * 6)]
    texts = [None, "", " ,. ", words(rng, 200), "x" * 300_000, words(rng, 5000, "ab"), items[3][1].upper()]
    for _, text in items:
        if text:
            texts += [words(rng, 30) + " " + text + ". " + words(rng, 20), text, (text + " ") * 3, text.replace(" ", "-\n")]
    texts += texts[:6]
    assert result(spark, texts, items, block_words=block_words) == brute(texts, items)


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a b")]) == []
    assert result(spark, ["a b", None], []) == [(2, 0, []), (0, 0, [])]


def test_index_finds_and_locates_all():
    rng = np.random.default_rng(5)
    for alphabet in (2, 3, 9):
        symbols = np.append(rng.integers(0, alphabet, 400), 0)
        index = fmindex.FMIndex(symbols, alphabet)
        order = fmindex.suffix_array(symbols)
        assert [tuple(symbols[i:]) for i in order] == sorted(tuple(symbols[i:]) for i in range(len(symbols)))
        for length in (1, 2, 5):
            phrases = rng.integers(1, alphabet, (30, length))
            found, first, end = index.search(phrases)
            hits = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(found, first, end)}
            for k, phrase in enumerate(phrases):
                want = [i for i in range(len(symbols) - length + 1) if (symbols[i:i + length] == phrase).all()]
                assert hits.get(k, []) == want


def test_digest():
    assert fmindex.items_digest(["10", "9"]) == hashlib.sha256(b"10,9").hexdigest()


def test_query(spark, sf):
    from fingerloom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op10_benchmark_decontamination"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for row, (n, hit, found) in zip(rows, brute([r.text for r in rows], items)):
        r = got[row.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(found), fmindex.items_digest(found))
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
