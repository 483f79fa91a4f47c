"""Scoring with linear softmax models held in a table, one row per model key.

A model row: ``scope`` (``global`` or ``personal``), ``model_key`` (the user's key), ``classes`` (sorted labels), ``coefficients`` (one array of feature
weights per class, on raw features) and ``intercepts``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerloom.functions import scalars as S
from fingerloom.schema import FEATURES
from fingerloom.sources.registry import GLOBAL, GLOBAL_KEY, PERSONAL

MODEL_COLUMNS = ("classes", "coefficients", "intercepts")
MAX_CLASSES = 1000


def label_list(df: DataFrame, label: str) -> list[str]:
    """Sorted distinct labels; an error instead of a driver full of labels."""
    rows = df.select(label).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"Column {label} has more than {MAX_CLASSES} values; it is not a class label.")
    return sorted(r[0] for r in rows if r[0] is not None)


def fit_scaler(df: DataFrame, columns: Sequence[str] = FEATURES) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column (a zero deviation becomes 1), in one pass."""
    row = df.agg(*[F.expr(f"{f}(`{c}`) AS `{n}_{c}`") for c in columns for n, f in (("m", "avg"), ("s", "stddev_pop"))]).first()
    return {c: (float(row[f"m_{c}"]), float(row[f"s_{c}"]) or 1.0) for c in columns}


def standardize(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Replace the scaled columns by z-scores; plain expressions, no vector, no shuffle."""
    return df.withColumns({c: F.expr(f"(`{c}` - {S.number(m)}) / {S.number(s)}") for c, (m, s) in scaler.items()})


def model_fallback(sessions: DataFrame, models: DataFrame, *, user: str = "user_id",
                   columns: Sequence[str] = MODEL_COLUMNS) -> DataFrame:
    """Sessions with the columns of their user's model, or of the global one, and ``is_fallback_used``.

    The model side has one row per key: it is broadcast only if the planner finds it small; beyond
    that the left side is shuffled by user, where AQE splits a user with very many sessions. The one
    global row is a literal. Blank users have no model of their own.
    """
    fallback = _global_model(models, columns)
    personal = models.where(F.col("scope") == PERSONAL).select(
        F.col("model_key").alias("_key"), F.struct(*columns).alias("_own"))
    struct_type = personal.schema["_own"].dataType
    rest = F.struct(*[_literal(fallback[f.name], f) for f in struct_type])
    keyed = sessions.withColumn("_lookup", _lookup(user))
    joined = keyed.join(personal, F.col("_lookup") == F.col("_key"), "left")
    chosen = F.when(F.col("_key").isNull(), rest).otherwise(F.col("_own"))
    return joined.withColumns({
        "_model": chosen, "is_fallback_used": F.col("_key").isNull().cast("int"),
        "used_model_key": F.coalesce("_key", F.lit(GLOBAL_KEY)),
    }).select(*sessions.columns, "used_model_key", "is_fallback_used",
              *[F.col("_model")[c].alias(c) for c in columns])


def _global_model(models: DataFrame, columns: Sequence[str]) -> dict:
    """The one global row; an error if there is none or more."""
    found = models.where(F.col("scope") == GLOBAL).select(*columns).take(2)
    if len(found) != 1:
        raise ValueError(f"The model table needs exactly one global model and has {'none' if not found else 'more'}.")
    return found[0].asDict()


def _lookup(user: str) -> Column:
    """The key of a row's user; NULL for blank users, who have no model of their own."""
    blank = S.strip(F.coalesce(F.col(user).cast("string"), F.lit(""))) == ""
    return F.when(~blank, S.user_key(F.col(user)))


def _literal(value, field) -> Column:
    return F.lit(value).cast(field.dataType).alias(field.name) if not isinstance(value, list) else (
        _array(value).cast(field.dataType).alias(field.name))


def _array(value) -> Column:
    return F.expr(_array_sql(value))


def _array_sql(value) -> str:
    if isinstance(value, list):
        return "array(" + ", ".join(map(_array_sql, value)) + ")"
    return S.number(value) if isinstance(value, (int, float)) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def flat_models(models: DataFrame, names: Sequence[str]) -> DataFrame:
    """The personal models with two columns for each class: ``_key``, ``_b<i>`` and the weights ``_w<i>``, NULL if the model lacks class i.

    An array for each class keeps rows below the number of fields up to which stages are compiled whole.
    """
    own = models.where(F.col("scope") == PERSONAL)
    placed = own.selectExpr("*", *[f"int(array_position(classes, {_array_sql(c)})) - 1 AS _p{i}" for i, c in enumerate(names)])
    cells = [f"IF(_p{i} >= 0, get({column}, _p{i}), NULL) AS {alias}{i}" for i in range(len(names)) for column, alias in (("intercepts", "_b"), ("coefficients", "_w"))]
    return placed.selectExpr("model_key AS _key", *cells)


def score_linear(sessions: DataFrame, models: DataFrame, *, user: str = "user_id",
                 features: Sequence[str] = FEATURES) -> DataFrame:
    """Add ``used_model_key``, ``is_fallback_used``, ``prediction``, ``confidence``, ``probabilities`` by each row's personal or global model.

    A model meets its rows as a row with an array of weights for each class; a row without a model of its own takes the global one's
    weights, which are literals. The products are written once, as a function of a class's weights: written out for every class they
    make a method that Java no longer compiles. The join is sized by the planner, and AQE splits a user with very many sessions.
    """
    fallback = _global_model(models, MODEL_COLUMNS)
    names = label_list(models.select(F.explode("classes").alias("c")), "c")
    own_class = [fallback["classes"].index(c) if c in fallback["classes"] else -1 for c in names]
    index, width = range(len(names)), range(len(features))
    kept = [f"`{c}`" for c in sessions.columns]
    keyed = sessions.withColumn("_lookup", _lookup(user))
    joined = keyed.join(flat_models(models, names), F.col("_lookup") == F.col("_key"), "left")
    # One test a row says whose weights count; a class that the model lacks has no logit.
    def whose(own: str, column: str) -> str:
        rest = ["NULL" if k < 0 else _array_sql(fallback[column][k]) for k in own_class]
        return f"IF(_key IS NULL, array({', '.join(rest)}), array({', '.join(f'{own}{i}' for i in index)}))"
    logit = " + ".join(["get(_bs, _at)", *[f"get(_own, {j}) * double(`{features[j]}`)" for j in width]])
    staged = joined.selectExpr(*kept, f"coalesce(_key, '{GLOBAL_KEY}') AS used_model_key", "int(_key IS NULL) AS is_fallback_used",
                               f"{whose('_w', 'coefficients')} AS _ws", f"{whose('_b', 'intercepts')} AS _bs")
    kept += ["used_model_key", "is_fallback_used"]
    staged = staged.selectExpr(*kept, f"transform(_ws, (_own, _at) -> {logit}) AS _z").selectExpr(*kept, *[f"get(_z, {i}) AS _z{i}" for i in index])
    top = f"greatest({', '.join(f'_z{i}' for i in index)})" if len(names) > 1 else "_z0"
    staged = staged.selectExpr("*", f"{top} AS _top").selectExpr(*kept, *[f"exp(_z{i} - _top) AS _e{i}" for i in index])
    # The largest class has exp(0) = 1, so the sum is 0 only where a feature is missing: such a row has no prediction.
    staged = staged.selectExpr("*", f"nullif({' + '.join(f'coalesce(_e{i}, 0.0D)' for i in index)}, 0.0D) AS _total")
    literals = [_array_sql(c) for c in names]
    winner = "CASE " + " ".join(f"WHEN _e{i} = 1.0D THEN {c}" for i, c in enumerate(literals)) + " END"
    cells = "map(" + ", ".join(f"{c}, _e{i} / _total" for i, c in enumerate(literals)) + ")"
    return staged.selectExpr(*kept, f"{winner} AS prediction", "100.0D / _total AS confidence", f"map_filter({cells}, (k, v) -> v IS NOT NULL) AS probabilities")


def probability_rows(scored: DataFrame, *keep: str) -> DataFrame:
    """``label`` and ``probability`` of every class of a scored row; a row without probabilities has none.

    A plain ``explode`` lets the planner ask first whether the map is empty, and push that test below the scoring, where it repeats all of
    a row's products for every use of a sum. The outer form has no such test.
    """
    return scored.select(*keep, F.explode_outer("probabilities").alias("label", "probability")).where(F.col("label").isNotNull())


def score_with_model(sessions: DataFrame, model: Mapping, *, features: Sequence[str] = FEATURES) -> DataFrame:
    """The same for one model given on the driver: weights are literals, and every step is a plain
    column of generated code."""
    names = [_array_sql(str(c)) for c in model["classes"]]
    index = range(len(names))
    kept = [f"`{c}`" for c in sessions.columns]
    logits = [
        " + ".join([S.number(b), *[f"{S.number(w)} * `{c}`" for w, c in zip(weights, features)]])
        for weights, b in zip(model["coefficients"], model["intercepts"])]
    staged = sessions.selectExpr(*kept, *[f"{z} AS _z{i}" for i, z in enumerate(logits)])
    staged = staged.selectExpr("*", f"greatest({', '.join(f'_z{i}' for i in index)}) AS _top")
    staged = staged.selectExpr(*kept, *[f"exp(_z{i} - _top) AS _e{i}" for i in index])
    staged = staged.selectExpr("*", f"{' + '.join(f'_e{i}' for i in index)} AS _total")
    # The largest class has exp(0) = 1, so the first of those is the prediction.
    winner = "CASE " + " ".join(f"WHEN _e{i} = 1.0D THEN {name}" for i, name in enumerate(names)) + " END"
    pairs = ", ".join(f"{name}, _e{i} / _total" for i, name in enumerate(names))
    return staged.selectExpr(*kept, f"{winner} AS prediction", "100.0D / _total AS confidence", f"map({pairs}) AS probabilities")


def coefficient_importance(models: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean absolute standardised coefficient per model and feature.

    ``coefficients`` are on raw features and are scaled back by ``scales`` (the feature deviations).
    A two-class model stores its one coefficient row as the second class beside a zero row; only that
    row counts.
    """
    cells = models.select("model_key", F.size("classes").alias("_k"), "scales", F.posexplode("coefficients").alias("_c", "_w"))
    cells = cells.where((F.col("_k") > 2) | (F.col("_c") == 1))
    names = F.array(*[F.lit(f) for f in features])
    weights = cells.select("model_key", "_c", "scales", F.posexplode("_w").alias("position", "_v"))
    scaled = F.abs(F.col("_v") * F.get("scales", F.col("position")))
    return weights.groupBy("model_key", "position").agg(F.avg(scaled).alias("importance")).select(
        "model_key", F.get(names, F.col("position")).alias("feature"), "importance", "position")
