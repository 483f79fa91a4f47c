from __future__ import annotations

from dataclasses import replace
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from builders import frame, training_rows
from fingerloom.operators import boosting as B
from fingerloom.operators import models as M
from fingerloom.operators import training as T
from fingerloom.operators import trees as Tr
from fingerloom.schema import FEATURES, TARGET
from fingerloom.session import shared_dir

NAMES = ["p", "q", "r", "s"]


@pytest.fixture
def few_rounds(monkeypatch):
    """The whole way with five rounds instead of a hundred."""
    whole = B.fit
    monkeypatch.setattr(B, "fit", lambda *a, settings, **k: whole(*a, settings=replace(settings, rounds=5, row_share=1.0, min_weight=0.1), **k))


def data(n, classes, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 20, (n, len(NAMES))) / 2  # so few values that each is a bin
    y = np.digitize(x[:, 0] + x[:, 1] * (x[:, 2] > 5) + rng.normal(scale=2, size=n), np.linspace(2, 14, classes - 1))
    return x, y


def table(spark, x, y, folds=0):
    rows = [(i, i % folds if folds else 0, *map(float, r), "abcdef"[k]) for i, (r, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key bigint, fold int, p double, q double, r double, s double, label string").repartition(3)


def brute(x, y, k, settings):
    """Margins of all rows after the rounds, one row, node, feature and cut at a time."""
    cuts = [np.unique(x[:, f])[:-1] for f in range(x.shape[1])]
    margins = np.zeros((len(x), 1 if k == 2 else k))
    keys = np.arange(len(x), dtype=np.int64)
    for number in range(settings.rounds):
        g, h = B.gradients(margins, y)
        for c in range(margins.shape[1]):
            seen = B.drawn(keys, number, c, settings)
            allowed = B.drawn_columns(x.shape[1], number, c, settings)
            nodes = [(np.ones(len(x), bool), 0)]
            for inside, depth in nodes:
                own = inside & seen
                total_g, total_h = g[own, c].sum(), h[own, c].sum()
                best = None
                for f in np.flatnonzero(allowed) if depth < settings.depth else []:
                    for cut in cuts[f]:
                        left = own & (x[:, f] <= cut)
                        lg, lh = g[left, c].sum(), h[left, c].sum()
                        rg, rh = total_g - lg, total_h - lh
                        if lh < settings.min_weight or rh < settings.min_weight:
                            continue
                        gain = lg**2 / (lh + settings.ridge) + rg**2 / (rh + settings.ridge) - total_g**2 / (total_h + settings.ridge)
                        if gain > settings.min_gain and (best is None or gain > best[0] + 1e-12):
                            best = (gain, f, cut)
                if best is None:
                    margins[inside, c] -= settings.rate * total_g / (total_h + settings.ridge)
                else:
                    left = x[:, best[1]] <= best[2]
                    nodes += [(inside & left, depth + 1), (inside & ~left, depth + 1)]
    return margins


@pytest.mark.parametrize(("classes", "shares"), [(3, 1.0), (3, 0.8), (2, 0.8)])
def test_trees_equal_brute_force(spark, classes, shares):
    x, y = data(300, classes, 1)
    settings = B.Settings(rounds=4, depth=3, rate=0.3, row_share=shares, column_share=shares)
    fitted = B.fit(table(spark, x, y), list("abcdef"[:classes]), label="label", features=NAMES, key="key", settings=settings)
    assert np.allclose(fitted.model.trees().sums(x), brute(x, y, classes, settings), atol=1e-9)


@pytest.mark.parametrize("write_every", [2, 100])
def test_folds_are_left_out(spark, monkeypatch, write_every):
    """A row's out-of-fold prediction is that of a fit which never saw its fold."""
    monkeypatch.setattr(B, "WRITE_EVERY", write_every)
    x, y = data(240, 4, 2)
    settings = B.Settings(rounds=5, depth=2)
    fitted = B.fit(table(spark, x, y, folds=3), list("abcd"), label="label", features=NAMES, key="key", fold="fold", folds=3, settings=settings)
    got = {r.key: r.prediction for r in fitted.out_of_fold.collect()}
    assert np.allclose(fitted.model.trees().sums(x), brute(x, y, 4, settings), atol=1e-9)
    for fold in range(3):
        inside = np.arange(240) % 3 != fold
        alone = B.fit(table(spark, x, y, folds=3).where(F.col("fold") != fold), list("abcd"), label="label", features=NAMES, key="key", settings=settings)
        want = alone.model.trees().sums(x).argmax(axis=1)
        assert all(got[i] == "abcd"[want[i]] for i in np.flatnonzero(~inside))


def test_rows_stand_in_blocks(spark, monkeypatch):
    """Every row is in one block of bounded size, blocks are dealt to the tasks asked for, and trees do not depend on either."""
    x, y = data(230, 3, 5)
    df = table(spark, x, y)
    staged = df.selectExpr("key", "fold", "int(ascii(label) - 97) AS label", "struct(p, q, r, s) AS x")
    cuts = [np.unique(x[:, f])[:-1] for f in range(4)]
    blocks = B._binned(staged, cuts, 3, 40)
    found = blocks.collect()
    keys = [np.frombuffer(r.key, np.int64) for r in found]
    assert max(map(len, keys)) <= 40 and sorted(np.concatenate(keys)) == list(range(230))
    for own, r in zip(keys, found):
        assert (np.frombuffer(r.label, np.int32) == y[own]).all() and len(r.margins) == 3 * 8 * len(own)
        assert (np.frombuffer(r.bins, np.uint8).reshape(4, -1).T == np.stack([np.searchsorted(c, x[own, f]) for f, c in enumerate(cuts)], axis=1)).all()
    assert B._dealt(blocks, 2).rdd.getNumPartitions() == 2 and B._dealt(blocks, 5).rdd.getNumPartitions() == 5
    settings = B.Settings(rounds=3, depth=3, rate=0.3)
    for name, value in (("BLOCK_ROWS", 7), ("BLOCKS", 2), ("TASK_ROWS", 20), ("MOST_TASK_ROWS", 10)):
        monkeypatch.setattr(B, name, value)
    fitted = B.fit(df, list("abc"), label="label", features=NAMES, key="key", settings=settings)
    assert np.allclose(fitted.model.trees().sums(x), brute(x, y, 3, settings), atol=1e-9)


def test_a_level_is_one_job(spark, monkeypatch):
    """A level of several tasks is one job, and what was kept on the way is deleted."""
    for name, value in (("BLOCK_ROWS", 20), ("BLOCKS", 2), ("TASK_ROWS", 60), ("WRITE_EVERY", 2)):
        monkeypatch.setattr(B, name, value)
    x, y = data(230, 3, 6)
    jobs, grow = [], B._grow

    def counted(*a):
        spark.sparkContext.setJobGroup(f"round {len(jobs)}", "boosting")
        grown = grow(*a)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"round {len(jobs)}")))
        spark.sparkContext.setJobGroup("other", "other")
        return grown

    monkeypatch.setattr(B, "_grow", counted)
    settings = B.Settings(rounds=5, depth=3, rate=0.3)
    before = set(Path(shared_dir(spark)).rglob("part-*"))
    fitted = B.fit(table(spark, x, y), list("abc"), label="label", features=NAMES, key="key", settings=settings)
    assert np.allclose(fitted.model.trees().sums(x), brute(x, y, 3, settings), atol=1e-9)
    assert jobs == [3, 3, 4, 3, 4]  # a checkpoint is a job more
    assert set(Path(shared_dir(spark)).rglob("part-*")) <= before


def test_more_values_than_bins(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3).astype(int) + (x[:, 1] > 0)).astype(int)
    fitted = B.fit(table(spark, x, y), list("abc"), label="label", features=NAMES, settings=B.Settings(rounds=10, depth=3))
    assert (fitted.model.trees().sums(x).argmax(axis=1) == y).mean() > 0.97
    importance = fitted.model.getOrDefault(fitted.model.importance)
    assert sum(importance) == pytest.approx(1) and importance[0] + importance[1] > 0.8


def test_pipeline_is_stored_and_scores_alike(spark, tmp_path, few_rounds):
    rows = training_rows()
    df = frame(spark, rows)
    classes = M.label_classes(df)
    model = M.fit_pipeline(M.BOOSTED, df, classes)
    scored = M.score(df, model, classes).collect()
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-9 for r in scored)
    model.write().save(f"{tmp_path}/model")
    again = M.score(df, PipelineModel.load(f"{tmp_path}/model"), classes).collect()
    assert sorted(map(str, scored)) == sorted(map(str, again))
    assert len(M.importances(model)) == len(FEATURES)
    assert M.score(df.limit(0), model, classes).collect() == []


def test_boosted_tournament(spark, few_rounds):
    result = T.run_tournament(frame(spark, training_rows()), [M.BOOSTED])
    assert result.winner == M.BOOSTED and result.predictions.count() == 12 and result.rows == 12
    assert {r[TARGET] for r in result.predictions.collect()} == {"left_pinky", "right_index"}


def test_packed_forest_equals_the_forest(spark):
    x, y = data(1500, 5, 4)
    df = table(spark, x, y)
    model = M.fit_pipeline(M.FOREST, df, list("abcde"), label="label", features=NAMES)
    from pyspark.ml.functions import vector_to_array

    want = {r.key: r.p for r in model.transform(df).select("key", vector_to_array("_probability").alias("p")).collect()}
    got = {r.key: r for r in M.score(df, model, list("abcde")).collect()}
    assert len(got) == 1500
    for key, p in want.items():
        assert [got[key].probabilities[c] for c in "abcde"] == pytest.approx(p, abs=1e-12)
        assert got[key].prediction == "abcde"[int(np.argmax(p))] or sorted(p)[-1] - sorted(p)[-2] < 1e-12


def test_values_at_the_thresholds():
    """A value equal to a threshold goes left; missing features and single leaves are fine."""
    one = Tr.from_nodes([{0: (1, 2.0, 1, 2, [0.0]), 1: (-1, 0, 0, 0, [1.0]), 2: (1, 5.0, 3, 4, [0.0]), 3: (-1, 0, 0, 0, [2.0]), 4: (-1, 0, 0, 0, [3.0])}, {0: (-1, 0, 0, 0, [10.0])}], "softmax", 1)
    x = np.array([[0, 2.0], [0, 2.0000001], [0, 5.0], [0, 6.0], [0, -np.inf]])
    assert one.sums(x)[:, 0].tolist() == [11, 12, 12, 13, 11]
    assert Tr.Ensemble.loads(one.dumps()).sums(x)[:, 0].tolist() == [11, 12, 12, 13, 11]


def test_forest_rows_remember_their_nodes(spark):
    """Levels do not walk the rows from the root again, and the forest is the one that walking gives."""
    x, y = data(200, 3, 7)
    df = spark.createDataFrame([(float(k), Vectors.dense(r)) for r, k in zip(x, y)], StructType([StructField("_label", DoubleType()), StructField("_features", VectorUDT())])).coalesce(1).cache()
    classifier = M._classifier(M.FOREST, 200, 3, 42).setNumTrees(5)
    walked = classifier.copy().setCacheNodeIds(False).fit(df)
    assert classifier.getCacheNodeIds()
    assert classifier.fit(df).toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


@pytest.mark.parametrize("classes", [2, 3])
def test_large_data_grows_the_same_trees(spark, monkeypatch, classes):
    """Sums of one child and of two features at a time, and margins in local files, give the trees and predictions of whole sums."""
    for name, value in (("BLOCK_ROWS", 20), ("BLOCKS", 2), ("TASK_ROWS", 60), ("PAIR_ROWS", 0)):
        monkeypatch.setattr(B, name, value)
    x, y = data(230, classes, 8)
    settings, names = B.Settings(rounds=4, depth=4, rate=0.3), list("abc"[:classes])
    fit = lambda: B.fit(table(spark, x, y, folds=3), names, label="label", features=NAMES, key="key", fold="fold", folds=3, settings=settings)
    whole, summed, sums = fit(), [], B._sums

    def counted(state, *a):
        assert state.differences == (state.level > 0) and len(state.files.rounds) == state.round
        yield from sums(state, *a)

    smaller = B._smaller
    monkeypatch.setattr(B, "LARGE_TASK_ROWS", 1)
    monkeypatch.setattr(B, "_sums", counted)
    monkeypatch.setattr(B, "_smaller", lambda *a: summed.append((len(a[3]), len(found := smaller(*a)))) or found)
    before = set(Path(shared_dir(spark)).rglob("part-*"))
    fitted = fit()
    assert all(one * 2 == both for both, one in summed) and any(one for _, one in summed)
    assert np.allclose(fitted.model.trees().sums(x), brute(x, y, classes, settings), atol=1e-9)
    assert sorted(fitted.out_of_fold.collect()) == sorted(whole.out_of_fold.collect())
    assert len([p for p in set(Path(shared_dir(spark)).rglob("part-*")) - before if "out-of-fold" not in str(p)]) == 0


def test_lost_margins_are_made_anew(tmp_path, monkeypatch):
    """Margins come from the file of the last round, from an older one, or from the trees alone; files of other rows are not taken."""
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    rng = np.random.default_rng(9)
    grown = []
    for _ in range(3):
        one = B.Round(3, 2)
        one.feature[:, 0], one.bin[:, 0], one.feature[:, 2], one.bin[:, 2] = 1, 3, 0, rng.integers(0, 8, 3)
        one.value[:, [1, 5, 6]] = rng.normal(size=(3, 3))
        grown.append(SimpleNamespace(value=one))

    def rows(n):
        bins = rng.integers(0, 10, (2, n)).astype(np.uint8)
        return B._Rows(np.arange(n), np.zeros(n, np.int32), rng.integers(0, 3, n).astype(np.int32), bins, np.zeros((0, n)), np.zeros((0, 2, n)))

    for own in (rows(40), rows(40)):
        for rounds in ((1, 2, 3), (3,), (2, 3)):
            for path in [p for p in tmp_path.rglob("*-*") if p.is_file()]:
                path.unlink()
            for n in rounds:
                got = B._Files("x", tuple(grown[:n]), 3, 3).loaded(own)
            want = np.zeros((3, 40))
            for g in grown:
                for t in range(3):
                    at = np.where(own.bins[1] <= 3, 1, np.where(own.bins[0] <= g.value.bin[t, 2], 5, 6))
                    want[t] += g.value.value[t][at]
            assert np.allclose(got.margins, want, atol=1e-12)
            p = np.exp(want) / np.exp(want).sum(axis=0)
            slopes = got.slopes(1, 3, np.arange(40))
            assert np.allclose(slopes.real, p[1] - (own.label == 1)) and np.allclose(slopes.imag, 2 * p[1] * (1 - p[1]))
            assert len([p for p in tmp_path.rglob("*-*") if p.is_file()]) == 1
