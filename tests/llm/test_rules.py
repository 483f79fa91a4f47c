from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from fingerloom.llm import rules
from llm_helpers import docs, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, hit = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit |= {i + k for i in places for k in range(3)}
    lines, earlier, dups = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dups += line in earlier
            earlier.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(hit), failed


def texts_of():
    rng = random.Random(4)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a b c", "a b c a b c", "a a a a", "ünï 🙂 # *$%&|<>", "x\ny\nx\n\n \n x\nx", "\x1c a\x85b\xa0c", "x" * 200_000, "a b " * 30_000]
    texts += [words(rng, rng.randint(1, 300), rng.choice(["ab", "abcdefgh"])) for _ in range(60)]
    texts += ["\n".join(words(rng, 6, "abc") for _ in range(30)) + "\nsame line\n" * 3 for _ in range(5)]
    return texts + texts[:8]


def test_statistics(spark):
    texts = texts_of()
    frame = docs(spark, texts, [i or None for i in range(len(texts))])
    got = rules.statistics(frame, keep=["doc_id", "text", "n_words"]).withColumn("failed", rules.base_failed()).collect()
    have = sorted([(r.row.doc_id, r.row.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed) for r in got], key=str)
    assert have == sorted([(i or None, t, *brute(t)) for i, t in enumerate(texts)], key=str)


def test_learns_planted_faults_and_nothing_else(spark):
    rng = random.Random(7)
    texts, marks = [], []
    for i in range(500):
        bad = i % 5 == 0
        w = words(rng, rng.randint(60, 200)).split()
        if bad and i % 10:
            w = [x + "$$" if k % 3 == 0 else x for k, x in enumerate(w)]
        elif bad:
            w = [x.upper() for x in w]
        texts.append(" ".join(w))
        marks.append((i, 0 if bad else 1, "clash"))
    frame = docs(spark, texts + texts[:20] + [None], [*range(500), *range(20), None])
    labels = spark.createDataFrame([*marks, (3, None, ""), (None, 0, ""), (4, 7, "")], "doc_id bigint, quality int, row string")
    got = rules.quality(frame, labels, keep=["doc_id", "fp"]).collect()
    assert len(got) == 521
    wrong = [r for r in got if r.row.doc_id is not None and r.kept != (r.row.doc_id % 5 != 0)]
    assert len(wrong) <= 5
    assert all(not r.kept for r in got if r.base_failed)


def test_no_labels_keep_all_that_pass_the_base(spark):
    frame = docs(spark, texts_of())
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = rules.quality(frame, none, keep=["doc_id"]).collect()
    assert got and all(r.kept != r.base_failed for r in got)
    assert rules.quality(frame.limit(0), none, keep=["doc_id"]).collect() == []
    assert rules.DecisionList([]).sql() == "true"


def test_conditions_read_in_order(spark):
    c = rules.Condition("words", True, 2.0)
    found = rules.DecisionList([[c, rules.Condition("words", False, 5.0)]])
    df = spark.sql("select explode(array(1L, 3L, 6L, null)) as n_words")
    assert [r.k for r in df.select(found.kept().alias("k")).collect()] == [True, False, True, True]


def test_query(spark, sf):
    from fingerloom.llm.queries import QUERIES

    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_quality_rules"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert {r.doc_id: got[r.doc_id][:6] for r in rows} == {r.doc_id: brute(r.text) for r in rows}
    marks = spark.read.parquet(f"{sf}/labels.parquet").where(F.col("quality") == 1).collect()
    good = [got[m.doc_id] for m in marks if m.doc_id in got and not got[m.doc_id][5]]
    assert sum(g[6] for g in good) >= 0.97 * len(good)
