from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from builders import COLUMNS, SCHEMA, frame, training_rows
from fingerloom.functions import scalars as S
from fingerloom.operators import metrics as E
from fingerloom.operators import models as M
from fingerloom.operators import personal as P
from fingerloom.operators import scoring as L
from fingerloom.operators import training as T
from fingerloom.operators.extract import filter_user
from fingerloom.schema import FEATURES, TARGET
from fingerloom.sources import registry as R


def tournament(spark, rows, algorithms=(M.LOGISTIC,), **options):
    return T.run_tournament(frame(spark, rows), algorithms, **options)


def test_leaderboard_and_importances(spark):
    result = tournament(spark, training_rows(), (M.LOGISTIC, M.FOREST))
    board = {r["algorithm"]: r for r in result.leaderboard.collect()}
    assert set(board) == {M.LOGISTIC, M.FOREST}
    assert result.winner in board and result.rows == 12
    assert all(0 <= r["macro_f1"] <= 1 and r["execution_time_ms"] > 0 for r in board.values())
    assert result.predictions.count() == 12
    nested = T.explain(result).first()
    values = [f["importance"] for f in nested["feature_importances"]]
    assert len(values) <= 10 and values == sorted(values, reverse=True)
    assert sum(c["n_rows"] for c in nested["confusion_matrix"]) == 12


def test_duplicates_are_removed(spark):
    rows = training_rows()
    assert T.prepare(frame(spark, rows + [rows[0], rows[7]])).count() == 12


def test_outliers_are_removed(spark):
    rows = training_rows()
    bad = [rows[0] | {"dwell_left_pinky": -5.0}, rows[1] | {"flight_right_index": 5005.0}, rows[2] | {"dwell_right_pinky": 1200.0}]
    assert T.prepare(frame(spark, rows + bad)).count() == 12


def test_no_algorithms(spark):
    with pytest.raises(ValueError, match="No candidate algorithms"):
        tournament(spark, training_rows(), ())


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError, match="Unsupported"):
        tournament(spark, training_rows(), ("svm",))


def test_thin_classes(spark):
    rows = training_rows()
    with pytest.raises(ValueError, match="5 folds need 5 rows"):
        tournament(spark, rows[:4] + rows[6:10])


def test_user_filter(spark):
    result = tournament(spark, training_rows() + training_rows("user-b"), user_id=" USER-B ")
    assert result.rows == 12
    df = frame(spark, training_rows())
    with pytest.raises(ValueError, match="No rows found"):
        filter_user(df, "nobody")
    with pytest.raises(ValueError, match="non-empty"):
        filter_user(df, "  ")


def test_history_merge_and_threshold(spark, tmp_path):
    stored, inline = frame(spark, training_rows()), frame(spark, [r | {"wpm": r["wpm"] + 0.5} for r in training_rows()[2:10]])
    result, path = T.train_personal(stored, "user-a", str(tmp_path), inline=inline, algorithms=[M.LOGISTIC])
    assert result.rows == 20
    model, row = R.load_model(spark, str(tmp_path), " User-A ")
    assert row["model_path"] == path and row["algorithm"] == M.LOGISTIC
    assert M.score(stored, model, row["label_classes"]).where(F.col("prediction") == F.col(TARGET)).count() == 12
    with pytest.raises(ValueError, match="Insufficient data"):
        T.train_personal(stored.limit(8), "user-a", str(tmp_path))


def test_registry_without_model(spark, tmp_path):
    rows = training_rows()
    T.train_holdout(frame(spark, rows), M.LOGISTIC, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        R.load_model(spark, str(tmp_path), "stranger")
    report, confusion = T.evaluate_model(frame(spark, rows), str(tmp_path))
    assert {r["label"] for r in report.collect()} >= {"accuracy", "macro avg", "weighted avg"}
    assert sum(r["n_rows"] for r in confusion.collect()) == 4


def test_validation_errors(spark):
    rows = training_rows()
    for change, text in (({"wpm": None}, "null_or_non_numeric"), ({"wpm": float("inf")}, "non_finite"),
                         ({"accuracy": 1.5}, "above_max"), ({TARGET: "thumb"}, "unsupported_labels"),
                         ({TARGET: " "}, "blank_labels"), ({TARGET: None}, "null_labels")):
        with pytest.raises(ValueError, match=text):
            T.prepare(frame(spark, [rows[0] | change, *rows[1:]]))


def test_all_users_match_distributed_fit(spark):
    """A user's model does not depend on how many blocks its rows stand in, and is that of the distributed solver."""
    rng = np.random.default_rng(3)
    rows = []
    for user in ("a", "b"):
        for i in range(90):
            label = ("left_pinky", "left_ring", "right_index")[i % 3]
            # Errors are shares: the range rules hold for all users too.
            row = {c: float(rng.normal(100, 5)) / (1000 if c.startswith("error") else 1) for c in FEATURES} | {"user_id": user, TARGET: label}
            row |= {"accuracy": 0.9, "error_left_pinky": float(rng.uniform(0, 0.1) + 0.1 * (i % 3 == 0))}
            rows.append(row)
    rows += [r | {"user_id": "few"} for r in rows[:5]]
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)
    grouped = {r["model_key"]: r for r in P.train_all_users(df).collect()}
    split = {r["model_key"]: r for r in P.train_all_users(df, block_rows=17).collect()}
    assert grouped["few"]["status"] == "insufficient_data"
    for user in ("a", "b"):
        assert grouped[user]["status"] == split[user]["status"] == "trained"
        assert grouped[user]["training_rows"] == split[user]["training_rows"]
        w = np.array(grouped[user]["coefficients"]) * np.array(grouped[user]["scales"])
        v = np.array(split[user]["coefficients"]) * np.array(split[user]["scales"])
        assert np.allclose(w, v, atol=1e-8) and np.allclose(grouped[user]["intercepts"], split[user]["intercepts"], atol=1e-6)
        own = df.where(F.col("user_id") == user)
        model = M.fit_pipeline(M.LOGISTIC, T.prepare(own), grouped[user]["classes"])
        assert np.allclose(w, model.stages[-1].coefficientMatrix.toArray(), atol=1e-3)
        # Brute force: the gradient of the summed loss plus half the squared weights vanishes at the model.
        pdf = T.prepare(own).toPandas()
        x = (pdf[FEATURES] - pdf[FEATURES].mean()) / pdf[FEATURES].std(ddof=0)
        b = np.array(grouped[user]["intercepts"]) + np.array(grouped[user]["coefficients"]) @ pdf[FEATURES].mean().to_numpy()
        z = x.to_numpy() @ w.T + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) - np.eye(3)[np.searchsorted(grouped[user]["classes"], pdf[TARGET])]
        assert np.abs(p.T @ x.to_numpy() + w).max() < 1e-6 * len(x) and np.abs(p.sum(axis=0)).max() < 1e-6 * len(x)


def test_two_class_fit_matches_distributed_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + rng.normal(scale=0.5, size=60) > 0).astype(int)
    w = P.softmax_fit((x - x.mean(0)) / x.std(0), y, 2)
    df = spark.createDataFrame([(*map(float, r), "ab"[k]) for r, k in zip(x, y)], "p double, q double, r double, label string")
    model = M.fit_pipeline(M.LOGISTIC, df, ["a", "b"], label="label", features=["p", "q", "r"])
    assert np.allclose(w[1, :-1], model.stages[-1].coefficientMatrix.toArray()[0], atol=1e-3)
    assert np.allclose(w[0], 0)


def test_linear_table_scores_like_the_pipeline(spark):
    df = frame(spark, training_rows())
    classes = M.label_classes(df)
    model = M.fit_pipeline(M.LOGISTIC, df, classes)
    row = M.linear_model_row(model, L.fit_scaler(df), classes, R.GLOBAL_KEY)
    columns = ["scope", "model_key", "classes", "coefficients", "intercepts"]
    table = spark.createDataFrame([tuple(row[c] for c in columns)],
                                  "scope string, model_key string, classes array<string>, coefficients array<array<double>>, intercepts array<double>")
    want = {r["wpm"]: r for r in M.score(df, model, classes).collect()}
    for scored in (L.score_linear(df, table), L.score_with_model(df, row)):
        for r in scored.collect():
            assert r["prediction"] == want[r["wpm"]]["prediction"]
            assert abs(r["confidence"] - want[r["wpm"]]["confidence"]) < 1e-6
            assert abs(sum(r["probabilities"].values()) - 1) < 1e-9


def test_fallback_flags(spark):
    schema = "scope string, model_key string, classes array<string>, coefficients array<array<double>>, intercepts array<double>"
    models = spark.createDataFrame([
        ("global", "global", ["a", "b"], [[0.0], [0.0]], [1.0, 0.0]), ("personal", "global", ["z", "y"], [[0.0], [0.0]], [1.0, 0.0]),
        ("personal", "user@@one", ["a", "b", "c"], [[0.0], [0.0], [0.0]], [0.0, 0.0, 2.0])], schema)
    rows = spark.createDataFrame([(" User@@One", 1.0), ("other", 1.0), ("  ", 1.0), (None, 1.0)], "user_id string, x double")
    named = spark.createDataFrame([("Global", 1.0), ("user__one", 1.0)], "user_id string, x double")
    own = {r["user_id"]: (r["is_fallback_used"], r["prediction"]) for r in L.score_linear(named, models, features=["x"]).collect()}
    assert own == {"Global": (0, "z"), "user__one": (1, "a")}
    for wrong in (models.where("scope = 'personal'"), models.union(models)):
        with pytest.raises(ValueError, match="exactly one global"):
            L.score_linear(rows, wrong, features=["x"])
    got = {r["user_id"]: (r["is_fallback_used"], r["prediction"]) for r in L.score_linear(rows, models, features=["x"]).collect()}
    assert got == {" User@@One": (0, "c"), "other": (1, "a"), "  ": (1, "a"), None: (1, "a")}


def test_probabilities_are_listed_without_scoring_twice(spark):
    schema = "scope string, model_key string, classes array<string>, coefficients array<array<double>>, intercepts array<double>"
    models = spark.createDataFrame([("global", "global", ["a", "b"], [[0.0], [0.0]], [0.0, 0.0]), ("personal", "one", ["c"], [[1.0]], [0.0])], schema)
    rows = spark.createDataFrame([("one", 1.0), ("two", 1.0), ("none", None)], "user_id string, x double")
    listed = L.probability_rows(L.score_linear(rows, models, features=["x"]), "user_id")
    assert sorted(map(tuple, listed.collect())) == [("one", "c", 1.0), ("two", "a", 0.5), ("two", "b", 0.5)]
    assert "size(" not in listed._jdf.queryExecution().optimizedPlan().toString()  # a test of the map would score every row again


def test_comparison_keeps_failures(spark, tmp_path, monkeypatch):
    fit = M.fit_pipeline

    def failing(algorithm, *args, **kwargs):
        if algorithm == M.FOREST:
            raise RuntimeError("no trees today")
        return fit(algorithm, *args, **kwargs)

    monkeypatch.setattr(M, "fit_pipeline", failing)
    rows = T.compare_algorithms(frame(spark, training_rows()), str(tmp_path), [M.LOGISTIC, M.FOREST], latency_runs=1).collect()
    by = {r["algorithm"]: r for r in rows}
    assert by[M.LOGISTIC]["status"] == "ok" and by[M.LOGISTIC]["is_best_by_efficiency"] == 1 and by[M.LOGISTIC]["model_bytes"] > 0
    assert by[M.FOREST]["status"] == "failed" and "no trees" in by[M.FOREST]["error"]


@pytest.mark.parametrize(("rows", "most"), [(30, 2), (1, 1)])
def test_folds_of_large_data_are_fitted_one_after_another(spark, monkeypatch, rows, most):
    """The rows that are fitted on side by side are bounded; every row is predicted once all the same."""
    fit, active, seen = M.fit_pipeline, [], []

    def counted(*args, **kwargs):
        active.append(1)
        seen.append(len(active))
        try:
            return fit(*args, **kwargs)
        finally:
            active.pop()

    monkeypatch.setattr(M, "fit_pipeline", counted)
    monkeypatch.setattr(M, "SIDE_BY_SIDE_ROWS", rows)
    folded = frame(spark, training_rows()).withColumn("key", F.monotonically_increasing_id()).withColumn("fold", (F.col("wpm") % 3).cast("int")).localCheckpoint()
    out, _ = M.cross_val_predict(M.LOGISTIC, folded, ["left_pinky", "right_index"], folds=3, key="key")
    assert len(seen) == 3 and max(seen) <= most and out.select("key").distinct().count() == out.count() == 12


def test_users_stay_apart_and_sessions_stay_whole(spark):
    """Ids in other scripts, a user called Global, and sessions with equal features."""
    rows = []
    for user, n in (("Иван", 24), ("Олег", 30), ("a@b", 24), ("a_b", 24), ("Global", 24)):
        rows += [(f"{user}-{i}", *[training_rows(user)[i % 12][c] for c in COLUMNS]) for i in range(n)]
    df = spark.createDataFrame(rows + rows[:3], f"session_id string, {SCHEMA}")
    got = {r["model_key"]: r for r in P.train_all_users(df).collect()}
    assert set(got) == {"иван", "олег", "a@b", "a_b", "global"} and {r["scope"] for r in got.values()} == {R.PERSONAL}
    assert got["иван"]["n_rows"] == 27 and got["иван"]["training_rows"] == 24 and got["олег"]["n_rows"] == 30
    keys = spark.createDataFrame([("Иван",), ("Олег",), ("a@b",), ("a_b",)], "u string").select(S.path_key(F.col("u")).alias("k")).distinct()
    assert keys.count() == 4


def test_own_or_global_pipeline_of_any_algorithm(spark, tmp_path):
    root = f"file:{tmp_path}"
    df = frame(spark, training_rows())
    T.train_holdout(df, M.LOGISTIC, root)
    T.train_holdout(df, M.FOREST, root, user="user-a")
    T.train_holdout(df, M.LOGISTIC, root, user="Global")
    assert [R.resolve_model(spark, root, u)[1:][0]["algorithm"] for u in (" User-A", "stranger", None, "global")] == [M.FOREST, *[M.LOGISTIC] * 3]
    assert [R.resolve_model(spark, root, u)[2] for u in ("user-a", "stranger", " ", "global")] == [False, True, True, False]
    assert R.active_models(R.read_registry(spark, root), R.stored_artifacts(spark, root)).count() == 3


def test_null_labels_are_labels(spark):
    pairs = spark.createDataFrame([("a", None), (None, "b"), (None, None), ("a", "a")], "y string, p string")
    cells = {(r["true_label"], r["predicted_label"]): r["n_rows"] for r in E.confusion_matrix(pairs, "y", "p").collect()}
    assert sum(cells.values()) == 4 and cells["a", None] == cells[None, "b"] == cells[None, None] == 1
    assert E.macro_metrics(pairs, "y", "p").first()["accuracy"] == 0.5
    assert E.primary_misclassification(pairs, "y", "p").first()["n_rows"] == 1


def test_metrics_of_known_pairs(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    m = E.macro_metrics(pairs, "y", "p").first()
    assert m["accuracy"] == 0.5 and m["support"] == 4
    assert abs(m["macro_precision"] - (1 + 1 / 3 + 0) / 3) < 1e-12
    assert abs(m["macro_recall"] - (0.5 + 1 + 0) / 3) < 1e-12
    cells = {(r["true_label"], r["predicted_label"]): r["n_rows"] for r in E.confusion_matrix(pairs, "y", "p").collect()}
    assert len(cells) == 9 and cells["a", "b"] == 1 and cells["c", "c"] == 0
    assert E.primary_misclassification(pairs, "y", "p").first()["summary"] == "True class a was frequently misclassified as b"
    same = pairs.where("y = p")
    assert E.primary_misclassification(same, "y", "p").first()["summary"] == E.NO_MISCLASSIFICATION


def test_a_model_of_all_rows_cannot_be_judged(spark, tmp_path):
    df = frame(spark, training_rows())
    T.train_global(df, str(tmp_path), [M.LOGISTIC])
    with pytest.raises(ValueError, match="fitted to all rows"):
        T.evaluate_model(df, str(tmp_path))


def test_users_scored_by_models_of_other_classes(spark):
    """A row's probabilities name the classes of its own model only; the first class wins a tie."""
    schema = "scope string, model_key string, classes array<string>, coefficients array<array<double>>, intercepts array<double>"
    models = spark.createDataFrame([
        ("global", "global", ["a", "c"], [[0.5, 0.0], [0.0, 0.5]], [0.0, 0.0]), ("personal", "u", ["b", "c", "d'"], [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]], [0.0, 0.0, 0.5])], schema)
    rows = spark.createDataFrame([("u", 1.0, 2), ("u", 0.0, 0), ("v", 1.0, 1), ("v", 3.0, 1), ("u", None, 1)], "user_id string, x double, y int")
    got = {(r.user_id, r.x): r for r in L.score_linear(rows, models, features=["x", "y"]).collect()}
    for (user, x, y), (names, z) in {("u", 1.0, 2): (["b", "c", "d'"], [1.0, 2.0, 0.5]), ("u", 0.0, 0): (["b", "c", "d'"], [0.0, 0.0, 0.5]), ("v", 1.0, 1): (["a", "c"], [0.5, 0.5]),
                                     ("v", 3.0, 1): (["a", "c"], [1.5, 0.5])}.items():
        p = np.exp(z) / np.exp(z).sum()
        assert got[user, x].probabilities == pytest.approx(dict(zip(names, p)))
        assert got[user, x].prediction == names[int(np.argmax(p))] and got[user, x].confidence == pytest.approx(100 * p.max())
    assert got["u", None].prediction is None and got["u", None].probabilities in (None, {})


def test_range_rules_hold_for_all_users(spark):
    """What a tournament rejects, the job for all users rejects as well."""
    rows = [r | {"user_id": u} for u in ("good", "bad") for r in training_rows() * 2]
    rows = [r | {"wpm": r["wpm"] + i / 100} for i, r in enumerate(rows)]
    rows[-1] = rows[-1] | {"accuracy": 1.5}
    got = {r["model_key"]: r["status"] for r in P.train_all_users(frame(spark, rows)).collect()}
    large = {r["model_key"]: r["status"] for r in P.train_all_users(frame(spark, rows), block_rows=10).collect()}
    assert got == large == {"good": "trained", "bad": "invalid_features"}


def test_products_are_written_once_for_all_classes(spark):
    """Written out for each class they make a method too large for Java to compile; a column named like a helper does no harm."""
    schema = "scope string, model_key string, classes array<string>, coefficients array<array<double>>, intercepts array<double>"
    names = [f"c{i}" for i in range(6)]
    weights = [[float(i + j) / 10 for j in range(5)] for i in range(6)]
    models = spark.createDataFrame([("global", "global", names, weights, [0.0] * 6), ("personal", "u", names[1:3], weights[1:3], [0.5, 0.0])], schema)
    rows = spark.createDataFrame([("u", *map(float, range(5))), ("v", *map(float, range(5))), ("v", 0.0, None, 0.0, 0.0, 0.0)], "user_id string, " + ", ".join(f"{c} double" for c in ("w", "i", "x", "y", "z")))
    scored = L.score_linear(rows, models, features=["w", "i", "x", "y", "z"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("* x#") == plan.count("* w#") == 1
    got = {(r.user_id, r.i): (r.used_model_key, r.prediction, r.confidence) for r in scored.collect()}
    for key, own, bias in (("u", range(1, 3), [0.5, 0.0]), ("v", range(6), [0.0] * 6)):
        z = np.array([sum(weights[k][j] * j for j in range(5)) for k in own]) + bias
        want = names[list(own)[int(z.argmax())]], 100 / np.exp(z - z.max()).sum()
        assert got[key, 1.0][1:] == (want[0], pytest.approx(want[1])) and got[key, 1.0][0] == ("u" if key == "u" else "global")
    assert got["v", None][1] is None
