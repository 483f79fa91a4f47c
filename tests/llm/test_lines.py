from __future__ import annotations

import random

import pytest

from fingerloom.llm import lines
from llm_helpers import docs, lower

BLANK = " \t\n\x0b\x0c\r"


def brute(ids, texts, min_chars=10):
    key = lambda line: lower(line.strip(BLANK))
    order = lambda d: (d is None, d)
    first = {}
    for d, t in zip(ids, texts):
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= min_chars and (k not in first or order(d) < order(first[k])):
                first[k] = d
    out = []
    for d, t in zip(ids, texts):
        own = (t or "").split("\n")
        kept = [line for line in own if key(line) not in first or first[key(line)] == d]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def got(frame, ids_texts=None):
    found = lines.apply_bitmaps(frame, lines.keep_bitmaps(frame), keep=["doc_id", "fp"])
    return sorted([(r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect()], key=str)


def awkward(seed=5):
    rng = random.Random(seed)
    pool = ["A line that many share", "  a LINE that many share\t", "short", "exactly10!", "Ünïcödé ß line, é", "ééééééééé", "éééééééééé", "", " ", "\x0bvertical tab line\x0c", "ends with cr\r", "ends with cr"]
    texts = [None, "", "\n", "\n\n", "   ", "A line that many share", "no newline at the end, but long", "x" * 100_000 + "\n" + "x" * 100_000 + "\n" + "a line that many share"]
    for _ in range(80):
        own = [rng.choice(pool) if rng.random() < 0.7 else f"only here {rng.random()}" for _ in range(rng.randint(1, 12))]
        texts.append("\n".join(own))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    # Repeated rows, one id with several texts, NULL ids.
    texts += [texts[10], texts[10], texts[11], texts[12] + "\nmore of it here", texts[20], texts[21], texts[20]]
    ids += [ids[10], ids[10], ids[11], ids[12], None, None, None]
    return ids, texts


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_brute_force(spark, partitions):
    ids, texts = awkward()
    assert got(docs(spark, texts, ids).repartition(partitions)) == sorted(brute(ids, texts), key=str)


def test_runs_longer_than_a_partition(spark):
    """One line in a third of all rows, over many range partitions, whose runs go on from one to the next."""
    hot = "the line that everybody has"
    texts = [f"{hot}\nown line number {i}\n{hot}" if i % 3 == 0 else f"own line number {i % 50}" for i in range(6000)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ids = [7 * i % 6007 for i in range(6000)]
        assert got(docs(spark, texts, ids).repartition(5)) == sorted(brute(ids, texts), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_table_and_text_ids(spark):
    frame = docs(spark, ["one line that repeats", "one line that repeats"], [1, 2])
    assert got(frame.limit(0)) == []
    named = frame.selectExpr("concat('d', doc_id) AS doc_id", "text", "fp")
    assert got(named) == [("d1", 1, 0, "one line that repeats"), ("d2", 1, 1, "")]


def test_bitmap_is_small(spark):
    text = "\n".join(f"a line of some length {i}" for i in range(10_000))
    frame = docs(spark, [text, text], [1, 2])
    sizes = {r.doc: (r.n_dropped, len(r.bitmap)) for r in lines.keep_bitmaps(frame).collect()}
    assert sizes[1][0] == 0 and sizes[2][0] == 10_000 and max(s for _, s in sizes.values()) < 100
