from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from fingerloom.llm import toxicity
from fingerloom.llm.common import buffers
from llm_helpers import docs, words


def model_of(texts, marks, **options):
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    text, found = toxicity.text_features(data, offsets)
    features = np.unique(found)
    own = (text, np.searchsorted(features, found), len(texts))
    text, found = toxicity.text_features(data, offsets, swapped=True)
    hit, number = toxicity._known(found, features)
    w, b = toxicity.fit_weights(own, (text[hit], number, len(texts)), np.array(marks), len(features), **options)
    return toxicity.Model(features, w, b)


def score(model, *texts):
    return model.scores(*buffers(pa.array(texts, pa.large_string())))


def corpus():
    """Insults, and identity terms that stand more often in toxic texts."""
    rng = random.Random(5)
    texts, marks = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = words(rng, 30).split()
        if toxic:
            w.insert(rng.randrange(30), "idiotic" + rng.choice(["ly", "al", "s"]))
        if rng.random() < (0.6 if toxic else 0.1):
            w.insert(rng.randrange(30), rng.choice(["muslim", "gay", "black"]))
        elif rng.random() < 0.3:
            w.insert(rng.randrange(30), rng.choice(["christian", "straight", "white"]))
        texts.append(" ".join(w))
        marks.append(int(toxic))
    return texts, marks


def test_features_of_a_text():
    data, offsets = buffers(pa.array(["Abc abc, ABCDEF", "", "ünïcode"], pa.large_string()))
    text, _ = toxicity.text_features(data, offsets)
    assert np.bincount(text, minlength=3).tolist() == [4, 0, 4]  # abc, abcdef, abcd, abcde; and a word with three prefixes


def test_swapped_text_has_the_other_terms():
    one = toxicity.text_features(*buffers(pa.array(["a gay man"], pa.large_string())), swapped=True)[1]
    other = toxicity.text_features(*buffers(pa.array(["a straight boy"], pa.large_string())))[1]
    women = toxicity.text_features(*buffers(pa.array(["a straight girl"], pa.large_string())))[1]
    assert set(one.tolist()) == set(women.tolist()) and set(one.tolist()) != set(other.tolist())


def test_counterfactual_penalty_keeps_neutral_mentions_clean():
    texts, marks = corpus()
    plain, fair = model_of(texts, marks, penalty=0.0), model_of(texts, marks, penalty=20.0)
    neutral, swapped = ["we met a muslim neighbour", "a gay friend"], ["we met a christian neighbour", "a straight friend"]
    gap = lambda m: np.abs(np.log(score(m, *neutral) / (1 - score(m, *neutral))) - np.log(score(m, *swapped) / (1 - score(m, *swapped)))).sum()
    assert gap(fair) < 0.3 * gap(plain)
    assert (score(fair, *neutral) < 0.5).all() and score(fair, "what an idiotically bad idea")[0] > 0.7


def test_fit_and_score(spark):
    texts, marks = corpus()
    odd = [None, "", " .", "x" * 200_000, "idiotics " * 20_000]
    frame = docs(spark, texts + odd + texts[:5], [*range(len(texts)), None, *range(10_000, 10_004), *range(5)])
    labels = spark.createDataFrame([*enumerate(marks), (3, None), (None, 1), (4, 9)], "doc_id bigint, toxic int")
    model = toxicity.fit(toxicity.sample(frame, labels))
    got = toxicity.score(frame, model, keep=["doc_id", "row"]).collect()
    by = {r.row.doc_id: r.score for r in got}
    assert len(got) == len(texts) + 10 and all(0 <= r.score <= 1 for r in got)
    assert by[None] == by[10_000] == by[10_001] < 0.5 and by[10_003] > 0.7
    assert sum((by[i] >= 0.7) == bool(m) for i, m in enumerate(marks)) > 0.98 * len(marks)
    assert toxicity.sample(frame, labels, max_rows=7).count() <= 8
    assert toxicity.score(frame.limit(0), model, keep=["doc_id"]).collect() == []


def test_one_class_or_none(spark):
    frame = docs(spark, ["a", None])
    for labels, want in (([], 0.0), ([(0, 0), (1, 0)], 0.0), ([(0, 1), (1, 1)], 1.0)):
        model = toxicity.fit(toxicity.sample(frame, spark.createDataFrame(labels, "doc_id bigint, toxic int")))
        assert all(abs(r.score - want) < 1e-9 for r in toxicity.score(frame, model, keep=["doc_id"]).collect())


def test_query_finds_held_out_toxic_texts(spark):
    from fingerloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[d].predicted, t) for d, t in marks.items() if d in got and got[d].held_out]
    assert sum(p for p, t in held if t) >= 0.7 * sum(t for _, t in held)
    assert sum(p for p, t in held if not t) <= 0.02 * len(held)


def test_the_penalty_acts_in_the_query(spark):
    """On the query's own features: swaps move scores without the penalty and hardly with it, and neutral mentions stay clean."""
    from pyspark.sql import functions as F

    from fingerloom.llm.common import crc_split

    sf = "/root/testdata/sf0.01"
    frame, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    sampled = toxicity.sample(frame, labels.where(crc_split(F.col("doc_id"), 3) != 1))
    plain, fair = toxicity.fit(sampled, penalty=0.0), toxicity.fit(sampled)
    assert plain.features.tolist() == fair.features.tolist() and set(toxicity.identity_features()) <= set(fair.features)
    assert np.abs(plain.weights - fair.weights).max() > 0.1
    held = [r.text for r in frame.where(crc_split(F.col("doc_id"), 3) == 1).select("text").collect() if r.text]
    data, offsets = buffers(pa.array(held, pa.large_string()))

    def change(model):
        sums = []
        for swapped in (False, True):
            text, found = toxicity.text_features(data, offsets, swapped)
            hit, number = toxicity._known(found, model.features)
            sums.append(np.bincount(text[hit], model.weights[number], len(held)))
        return np.abs(sums[0] - sums[1]).mean()
    assert change(plain) > 0.1 and change(fair) < 0.05 * change(plain)
    terms = [t for row in toxicity.IDENTITY for t in row]
    neutral = [f"we met a {t} neighbour, and {t} friends" for t in terms]
    wrong = lambda m: int((score(m, *neutral) >= toxicity.THRESHOLD).sum())
    assert wrong(fair) <= wrong(plain) and wrong(fair) == 0


def test_ids_that_repeat_do_not_pass_the_bound(spark):
    frame = docs(spark, [f"text {i} of it" for i in range(500)], [1] * 500)
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "doc_id bigint, toxic int")
    assert toxicity.sample(frame, labels, max_rows=50).count() <= 50
    assert toxicity.sample(frame.limit(0), labels).count() == 0
    copies = docs(spark, ["the same text"] * 500, [1] * 500)
    assert sorted(r.toxic for r in toxicity.sample(copies, labels).collect()) == [0, 1]


def test_equal_texts_have_equal_scores(spark):
    """Repeated rows and rows that differ in case only tie, whatever their ids; the model does not depend on the order of the rows."""
    texts, marks = corpus()
    labels = spark.createDataFrame([*enumerate(marks)], "doc_id bigint, toxic int")
    found = []
    for order in (range(len(texts)), reversed(range(len(texts)))):
        order = list(order)
        frame = docs(spark, [texts[i] for i in order], order).repartition(3)
        found.append(toxicity.fit(toxicity.sample(frame, labels)))
    assert found[0].features.tolist() == found[1].features.tolist() and np.allclose(found[0].weights, found[1].weights, atol=1e-6)
    same = docs(spark, ["an idiotic idea", "AN IDIOTIC IDEA", "an idiotic idea"], [1, 2, None])
    assert len({r.score for r in toxicity.score(same, found[0], keep=["doc_id"]).collect()}) == 1
