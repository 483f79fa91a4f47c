from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fingerloom.llm import languages
from llm_helpers import docs, words


def brute_grams(text):
    out = Counter()
    clean = "".join(chr(languages.folds()[ord(c)]) for c in text)
    joined = " " + " ".join(clean.split(" ")) + " "
    while "  " in joined:
        joined = joined.replace("  ", " ")
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            if joined[i:i + n] != " ":
                out[joined[i:i + n]] += 1
    return out


def unpack(key):
    chars = []
    while key:
        chars.append(chr(key & (1 << 21) - 1))
        key >>= 21
    return "".join(reversed(chars))


def brute(texts, langs):
    counts = {}
    for t, l in zip(texts, langs):
        if t is not None and l is not None:
            counts.setdefault(l, Counter()).update(brute_grams(t))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:languages.SIZE]]
    ranks = {l: {g: i for i, g in enumerate(order(c))} for l, c in counts.items()}
    out = []
    for t in texts:
        own = order(brute_grams(t or ""))
        if not any(c.isalpha() for c in t or "") or not ranks:
            out.append(("und", 0.0))
            continue
        sums = {l: sum(abs(r[g] - i) if g in r else languages.SIZE for i, g in enumerate(own)) for l, r in ranks.items()}
        best = min(sorted(sums), key=lambda l: sums[l])
        out.append((best, 1 - sums[best] / (languages.SIZE * len(own))))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "123 .,", "A", "ünï ÜNÏ", "漢字 🙂 ǅ ŉ İ", "x" * 100_000, words(rng, 20_000)]
    langs = [None, "aa", "bb", None, "cc", "cc", "aa", "bb"]
    for k, alphabet in enumerate(["abcdef", "defghi", "ghijkä"]):
        texts += [words(rng, 30, alphabet).title() + "! 12 " for _ in range(15)]
        langs += [["aa", "bb", "cc"][k]] * 15
    texts, langs = texts + texts[:9], langs + langs[:9]
    frame = docs(spark, texts, lang=langs).repartition(3)
    got = languages.predict(frame, frame, keep=["doc_id", "lang"]).collect()
    have = {r.row.doc_id: (r.lang_pred, round(r.score, 9)) for r in got}
    assert have == {i: (l, round(s, 9)) for i, (l, s) in enumerate(brute(texts, langs))}


def test_without_training_rows(spark):
    frame = docs(spark, ["abc", None])
    assert {(r.lang_pred, r.score) for r in languages.predict(frame, frame, keep=["doc_id"]).collect()} == {("und", 0.0)}
    assert languages.predict(frame.limit(0), frame, keep=["doc_id"]).collect() == []


def test_grams_unpack():
    text = np.array([32, 97, 98, 32])
    assert {unpack(int(k)) for k in languages.grams(text)} == {"a", "b", " a", "ab", "b ", " ab", "ab "}


def test_query_is_right_on_held_out_texts(spark, sf):
    from fingerloom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("lang").isNotNull()).collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_ties_go_to_the_first_language(spark):
    """Two languages of equal profiles, n-grams of equal count: the same answer each time, in any order of the rows."""
    texts, langs = ["ab cd ef gh"] * 4 + ["xy zw"] * 2, ["zz", "aa", "zz", "aa", "mm", "mm"]
    for order in (range(6), reversed(range(6))):
        own = [(i, texts[i], langs[i]) for i in order]
        frame = docs(spark, [t for _, t, _ in own], [i for i, _, _ in own], lang=[c for _, _, c in own]).repartition(3)
        got = {r.row.doc_id: (r.lang_pred, r.score) for r in languages.predict(frame, frame, keep=["doc_id"], size=3).collect()}
        assert [got[i][0] for i in range(6)] == ["aa"] * 4 + ["mm"] * 2 and len({got[i] for i in range(4)}) == 1
