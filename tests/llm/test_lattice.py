from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fingerloom.llm import lattice
from fingerloom.llm.common import crc_split
from llm_helpers import docs, lower, words

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, ids):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in ids]
    tokens = [[*WORD.findall(lower(t)), None] for t in texts]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    return [(h, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for t, h in zip(tokens, held)]


def marginal(word, own, weights):
    """Sum over all segmentations, one by one."""
    pieces = {}
    stack = [(0, b"")]
    while stack:
        node, text = stack.pop()
        if own.piece[node] >= 0:
            pieces[text] = float(np.exp(weights[own.piece[node]]))
        if len(text) < len(word):
            stack += [(int(own.step[node, b]), text + bytes([b])) for b in set(word) if own.step[node, b]]

    def rest(at):
        return 1.0 if at == len(word) else sum(p * rest(at + len(t)) for t, p in pieces.items() if word.startswith(t, at))
    return math.log(rest(0))


def test_marginals_and_expected_counts():
    own, rng = lattice.vocabulary(PATH), random.Random(2)
    weights = own.start_weights
    for word in ["the", "ünï", "aaa", "x1", "tion"]:
        raw = lattice.MARK + word.encode()
        rows = np.frombuffer(raw, np.uint8)[None, :]
        alpha, _ = lattice.forward(rows, own, weights)
        assert alpha[-1, 0] == pytest.approx(marginal(raw, own, weights), rel=1e-9)
        totals = np.zeros(len(weights))
        lattice.expected(rows, np.array([3.0]), own, weights, totals)
        # The derivative of the log marginal by a piece's log weight is its expected count.
        for piece in rng.sample(np.flatnonzero(totals).tolist(), 2):
            moved = weights.copy()
            moved[piece] += 1e-5
            slope = (lattice.forward(rows, own, moved)[0][-1, 0] - alpha[-1, 0]) / 1e-5
            assert totals[piece] == pytest.approx(3 * slope, rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("frequent", [1 << 19, 5])
def test_base_scores(spark, frequent):
    rng = random.Random(8)
    texts = [None, "", " \n", "One one ONE", "ünï 漢字", "x" * 20_000, words(rng, 20_000, "abcd")] + [words(rng, 40, "abc") for _ in range(30)] + ["One two"] * 3
    ids = [None, *range(1, len(texts) - 1), 3]
    frame = docs(spark, texts, ids).repartition(3)
    got = lattice.score(frame, crc_split(F.col("doc_id"), 7) == 2, PATH, keep=["doc_id", "text", "row"], frequent=frequent, rounds=1).collect()
    assert len(got) == len(texts)
    key = lambda x: (str(x[0]), str(x[1]), x[2:])
    have = sorted([(r.row.doc_id, r.row.text, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    for (i, t, *h), (j, u, *w) in zip(have, sorted([(i, t, *b) for i, t, b in zip(ids, texts, brute(texts, ids))], key=key)):
        assert (i, t, h[:-1]) == (j, u, w[:-1]) and h[-1] == pytest.approx(w[-1], rel=1e-9)
    assert all(r.score < 0 for r in got)


def test_without_training_rows_and_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lattice.score(docs(spark, ["a b", None, "c"], ids), crc_split(F.col("doc_id"), 7) == 2, PATH, keep=["doc_id"]).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    assert lattice.score(docs(spark, []), crc_split(F.col("doc_id"), 7) == 2, PATH, keep=["doc_id"]).collect() == []


def test_query_beats_the_base_on_held_out_texts(spark, sf):
    from fingerloom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op4_lm_scoring"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for r, (held, n, known, total, base) in zip(rows, brute([r.text for r in rows], [r.doc_id for r in rows])):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held, n, known, total) and g.base_score == pytest.approx(base, rel=1e-9)
    held = [g for g in got.values() if g.held_out]
    # The base takes any unseen word for one token; the model spells it, so its words with counts must carry it.
    assert sum(g.score for g in held) > 1.35 * sum(g.base_score for g in held)
    known = [g for g in held if g.n_known == g.n_tokens]
    assert sum(g.score for g in known) > 1.05 * sum(g.base_score for g in known)
