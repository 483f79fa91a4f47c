"""Registered queries: evaluation tables, leaderboards, rankings, splits and linear scoring.

The predictions come from rules over the given data: the finger with the largest dwell time (or
flight time, or error) predicts the resolved label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.functions import scalars as S
from fingerloom.functions.draws import draw_int
from fingerloom.operators import metrics as E
from fingerloom.operators import scoring as L
from fingerloom.operators import split as Sp
from fingerloom.plans import oracle as O
from fingerloom.plans.catalog import query, rounded
from fingerloom.schema import DWELL_COLUMNS, ERROR_COLUMNS, FEATURES, FINGERS, FLIGHT_COLUMNS, TARGET
from fingerloom.sources import registry as R
from fingerloom.sources.bridge import session_rows

_RULES = {"dwell_rule": DWELL_COLUMNS, "error_rule": ERROR_COLUMNS, "flight_rule": FLIGHT_COLUMNS}


def predictions(spark, sf) -> DataFrame:
    """One row per session: user, cohort, label, and the prediction of every rule."""
    rows = session_rows(spark, sf)
    return rows.select(
        "session_id", "user_id", "cohort", TARGET,
        *[S.argmax_name(dict(zip(FINGERS, cs))).alias(n) for n, cs in _RULES.items()])


_PRED = "pred as (select session_id, user_id, cohort, weakest_finger, " + ", ".join(
    f"{O.argmax(cs, FINGERS)} as {n}" for n, cs in _RULES.items()) + " from sessions)"

_LABELS = "labels as (select weakest_finger as l from pred union select dwell_rule from pred)"
_CLASSES = """classes as (select l as label, count(*) filter (weakest_finger=l and dwell_rule=l) as hits,
  count(*) filter (dwell_rule=l) as predicted, count(*) filter (weakest_finger=l) as support from labels, pred group by 1)"""
_RATIOS = """ratios as (select label, case when predicted=0 then 0 else hits/predicted end::double as precision, case when support=0 then 0 else hits/support end::double as recall,
  case when predicted+support=0 then 0 else 2*hits/(predicted+support) end::double as f1_score, support, hits from classes)"""
_EVAL = (_PRED, _LABELS, _CLASSES, _RATIOS)


@query("confusion_matrix", O.sessions(
    "select a.l as true_label, b.l as predicted_label, count(p.session_id) as n_rows from labels a cross join labels b "
    "left join pred p on p.weakest_finger = a.l and p.dwell_rule = b.l group by 1, 2", _PRED, _LABELS))
def confusion_matrix(spark, sf):
    return E.confusion_matrix(predictions(spark, sf), TARGET, "dwell_rule")


@query("confusion_matrix_nulls", O.sessions("""select a.l as true_label, b.l as predicted_label, count(s.session_id) as n_rows
  from (select distinct stated_finger as l from sessions union select distinct weakest_finger from sessions) a
  cross join (select distinct stated_finger as l from sessions union select distinct weakest_finger from sessions) b
  left join sessions s on s.stated_finger is not distinct from a.l and s.weakest_finger is not distinct from b.l group by 1, 2"""))
def confusion_matrix_nulls(spark, sf):
    """Stated labels, NULL and blank ones as well, against the resolved ones."""
    return E.confusion_matrix(session_rows(spark, sf), "stated_finger", TARGET)


_BINARY = {"true": "case when weakest_finger like 'left%' then 'Fatigued' else 'normal' end",
           "pred": "case when dwell_rule like 'left%' then '1' else ' FALSE' end"}


@query("state_confusion_matrix", O.sessions(
    f"""select t as true_label, q as predicted_label, count(session_id) as n_rows from (values ('0'),('1')) a(t) cross join (values ('0'),('1')) b(q)
    left join (select session_id, case when weakest_finger like 'left%' then '1' else '0' end as y, case when dwell_rule like 'left%' then '1' else '0' end as p from pred) on y=t and p=q group by 1,2""", _PRED))
def state_confusion_matrix(spark, sf):
    rows = predictions(spark, sf).select(
        F.when(F.col(TARGET).startswith("left"), "Fatigued").otherwise("normal").alias("y"),
        F.when(F.col("dwell_rule").startswith("left"), "1").otherwise(" FALSE").alias("p"))
    return E.state_confusion_matrix(rows, "y", "p")


@query("classification_report", O.sessions("""
  select label, round(precision,6) as precision, round(recall,6) as recall, round(f1_score,6) as f1_score, support from ratios
  union all select 'accuracy', null, null, round(sum(hits)/sum(support),6), sum(support)::bigint from ratios
  union all select 'macro avg', round(avg(precision),6), round(avg(recall),6), round(avg(f1_score),6), sum(support)::bigint from ratios
  union all select 'weighted avg', round(sum(precision*support)/sum(support),6), round(sum(recall*support)/sum(support),6), round(sum(f1_score*support)/sum(support),6), sum(support)::bigint from ratios""", *_EVAL))
def classification_report(spark, sf):
    return rounded(E.classification_report(predictions(spark, sf), TARGET, "dwell_rule"))


@query("macro_metrics", O.sessions("""select round(sum(hits)/sum(support),6) as accuracy, round(avg(precision),6) as macro_precision, round(avg(recall),6) as macro_recall,
  round(avg(f1_score),6) as macro_f1, round(sum(f1_score*support)/sum(support),6) as weighted_f1, sum(support)::bigint as support from ratios""", *_EVAL))
def macro_metrics(spark, sf):
    return rounded(E.macro_metrics(predictions(spark, sf), TARGET, "dwell_rule"))


_SENTENCE = "'True class ' || weakest_finger || ' was frequently misclassified as ' || dwell_rule"


@query("primary_misclassification", O.sessions(f"""
  select cohort, coalesce(n, 0) as n_rows, coalesce(s, 'No primary misclassification detected on evaluation data') as summary
  from (select distinct cohort from pred) left join (
  select cohort as c, n, {_SENTENCE} as s, row_number() over (partition by cohort order by n desc, weakest_finger, dwell_rule) as k from (
  select cohort, weakest_finger, dwell_rule, count(*) as n from pred where weakest_finger <> dwell_rule group by 1,2,3)) on c = cohort and k = 1""", _PRED))
def primary_misclassification(spark, sf):
    return E.primary_misclassification(predictions(spark, sf), TARGET, "dwell_rule", by=["cohort"])


def leaderboard(spark, sf) -> DataFrame:
    """Metrics of the three rules per user, in input order; flight predictions also serve as a copy
    under another name, so that exact quality ties occur for every user."""
    pairs = predictions(spark, sf).select(
        "user_id", F.col(TARGET).alias("y"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("algorithm"), F.col(c).alias("p"))
                           for i, (n, c) in enumerate(_CANDIDATES)])))
    board = E.macro_metrics(pairs, "y", "p", by=["user_id", "position", "algorithm"])
    key = F.concat_ws("-", "user_id", "algorithm")
    return board.withColumns({
        "predict_ms": F.when(F.col("algorithm") != "error_rule", draw_int(key, "ms", 100) / 10.0),
        "model_bytes": draw_int(key, "bytes", 5000),
    })


_CANDIDATES = [("flight_copy", "flight_rule"), ("flight_rule", "flight_rule"), ("dwell_rule", "dwell_rule"), ("error_rule", "error_rule")]
_BKEY = "concat_ws('-', user_id, algorithm)"
_BOARD = ("bpairs as (" + " union all ".join(
    f"select user_id, {i} as position, '{n}' as algorithm, weakest_finger as y, {c} as p from pred" for i, (n, c) in enumerate(_CANDIDATES)) + ")",
    "blabels as (select user_id, position, algorithm, y as l from bpairs union select user_id, position, algorithm, p from bpairs)",
    """bclasses as (select b.user_id, b.position, b.algorithm, l, count(*) filter (y=l and p=l) as hits, count(*) filter (p=l) as predicted, count(*) filter (y=l) as support
    from blabels b join bpairs q on b.user_id=q.user_id and b.position=q.position group by 1,2,3,4)""",
    f"""board as (select user_id, position, algorithm, sum(hits)/sum(support) as accuracy, avg(case when predicted=0 then 0 else hits/predicted end) as macro_precision,
    avg(case when support=0 then 0 else hits/support end) as macro_recall, avg(2*hits/(predicted+support)) as macro_f1,
    sum(2*hits/(predicted+support)*support)/sum(support) as weighted_f1, sum(support)::bigint as support,
    case when algorithm <> 'error_rule' then {O.h('ms', 100, _BKEY)}/10.0::double end as predict_ms, {O.h('bytes', 5000, _BKEY)} as model_bytes
    from bclasses group by 1,2,3)""")
# Exact ties are decided on rounded metrics in both engines, so float noise cannot split them.
_QUALITY = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]
_BOARD9 = "board9 as (select user_id, position, algorithm, " + ", ".join(f"round({c},9) as {c}" for c in _QUALITY) + ", support, predict_ms, model_bytes from board)"
_BOARDS = (_PRED, *_BOARD, _BOARD9)
_BOARD_COLUMNS = "user_id, position, algorithm, " + O.r6(*_QUALITY) + ", support, round(predict_ms,6) as predict_ms, model_bytes"


def _board9(spark, sf):
    return rounded(leaderboard(spark, sf), 9)


@query("choose_winner", O.sessions(
    f"select {_BOARD_COLUMNS} from (select *, row_number() over (partition by user_id order by macro_f1 desc, accuracy desc, algorithm) as k from board9) where k=1", *_BOARDS))
def choose_winner(spark, sf):
    return rounded(E.choose_winner(_board9(spark, sf), by=["user_id"]))


@query("rank_algorithms", O.sessions(
    f"""select {_BOARD_COLUMNS}, quality_rank, quality_ties from (
    select *, row_number() over (partition by user_id order by accuracy desc, macro_f1 desc, weighted_f1 desc, support desc, position) as quality_rank,
    count(*) filter (k=1) over (partition by user_id) as quality_ties from (
    select *, rank() over (partition by user_id order by accuracy desc, macro_f1 desc, weighted_f1 desc, support desc) as k from board9))""", *_BOARDS))
def rank_algorithms(spark, sf):
    return rounded(E.quality_rank(_board9(spark, sf), by=["user_id"]))


@query("best_by_efficiency", O.sessions(
    f"""select {_BOARD_COLUMNS} from (select *, row_number() over (partition by user_id order by predict_ms is null, predict_ms, model_bytes, position) as e from (
    select *, rank() over (partition by user_id order by accuracy desc, macro_f1 desc, weighted_f1 desc, support desc) as k from board9) where k=1) where e=1""", *_BOARDS))
def best_by_efficiency(spark, sf):
    return rounded(E.best_by_efficiency(_board9(spark, sf), by=["user_id"]))


# Feature scores from the data: the absolute correlation with "the label is a left-hand finger".
_SCORES = "scores as (" + " union all ".join(
    f"select '{f}' as feature, {i} as position, round(abs(corr({f}, case when weakest_finger like 'left%' then 1.0::double else 0.0::double end)),9) as importance from sessions"
    for i, f in enumerate(FEATURES)) + ")"


def feature_scores(spark, sf) -> DataFrame:
    side = F.when(F.col(TARGET).startswith("left"), 1.0).otherwise(0.0)
    row = session_rows(spark, sf).agg(*[F.round(F.abs(F.corr(F.col(f), side)), 9).alias(f) for f in FEATURES])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(i).alias("position"), F.col(f).alias("importance"))
        for i, f in enumerate(FEATURES)])))


@query("top_features", O.sessions("select feature, round(importance,6) as importance from scores order by scores.importance desc, position limit 10", _SCORES))
def top_features(spark, sf):
    return rounded(E.top_features(feature_scores(spark, sf)))


@query("top_predictive_feature", O.sessions("select feature, round(importance,6) as importance from scores order by scores.importance desc, position limit 1", _SCORES))
def top_predictive_feature(spark, sf):
    return rounded(E.top_predictive_feature(feature_scores(spark, sf)))


_HASH = "md5(concat(session_id, ':seed42'))"


@query("stratified_folds", O.sessions(
    f"select session_id, weakest_finger, cast((row_number() over (partition by weakest_finger order by {_HASH}, session_id) - 1) % 5 as int) as fold from sessions"))
def stratified_folds(spark, sf):
    rows = session_rows(spark, sf).select("session_id", TARGET)
    return Sp.stratified_folds(rows, TARGET, "session_id")


@query("stratified_split", O.sessions(
    f"""select session_id, weakest_finger, case when row_number() over (partition by weakest_finger order by {_HASH}, session_id)
    <= ceil(0.2::double * count(*) over (partition by weakest_finger)) then 1 else 0 end as is_test from sessions"""))
def stratified_split(spark, sf):
    rows = session_rows(spark, sf).select("session_id", TARGET)
    return Sp.stratified_split(rows, TARGET, "session_id")


@query("standardize", O.sessions("select session_id, " + ", ".join(
    f"round(({c}-(select avg({c}) from sessions))/(select case when stddev_pop({c})=0 then 1 else stddev_pop({c}) end from sessions),6) as {c}" for c in FEATURES) + " from sessions"))
def standardize(spark, sf):
    rows = session_rows(spark, sf).select("session_id", *FEATURES)
    return rounded(L.standardize(rows, L.fit_scaler(rows)))


# A linear model from the data, per key: class centroids of all features as weights on raw features, scaled so that
# rates and milliseconds weigh alike. A user gets a personal model from at least 63 sessions with six classes or more.
_DIM = FEATURES
_WEIGHT = {c: 20.0 if c in ERROR_COLUMNS else 1.0 if c == "accuracy" else 0.001 if c == "wpm" else 0.00001 for c in _DIM}
_LIVE = "live as (select * from sessions)"
_CENTROIDS = ("cents as (select user_id as k, weakest_finger as l, " + ", ".join(f"avg({c}) as m_{c}" for c in _DIM) + ", count(*) as n from live group by 1,2 "
              "union all select 'global', weakest_finger, " + ", ".join(f"avg({c})" for c in _DIM) + ", count(*) from live group by 2)")
_OWN = "own as (select k from cents where k <> 'global' group by 1 having count(*) >= 6 and sum(n) >= 63)"
_ZED = "+".join(f"({_WEIGHT[c]}::double*m_{c})*s.{c}" for c in _DIM) + " + (" + "+".join(f"({-_WEIGHT[c] / 2}::double*m_{c}*m_{c})" for c in _DIM) + ")"
_SCORED = (_LIVE, _CENTROIDS, _OWN,
           "keyed as (select sessions.*, coalesce(own.k, 'global') as used from sessions left join own on own.k = user_id)",
           f"logits as (select s.session_id, used, l, {_ZED} as z from keyed s join cents on cents.k = used)",
           "probs as (select session_id, used, l, exp(z - max(z) over w) / sum(exp(z - zm)) over w as p from (select *, max(z) over (partition by session_id) as zm from logits) window w as (partition by session_id))")


def centroid_models(spark, sf) -> DataFrame:
    rows = session_rows(spark, sf)
    keyed = rows.select(F.inline(F.array(
        F.struct(F.lit(R.PERSONAL).alias("scope"), S.user_key(F.col("user_id")).alias("model_key"), F.col(TARGET), *_DIM),
        F.struct(F.lit(R.GLOBAL).alias("scope"), F.lit(R.GLOBAL_KEY).alias("model_key"), F.col(TARGET), *_DIM))))
    means = keyed.groupBy("scope", "model_key", TARGET).agg(*[F.avg(c).alias(c) for c in _DIM], F.count(F.lit(1)).alias("n"))
    weights = F.array(*[F.col(c) * _WEIGHT[c] for c in _DIM])
    norm = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) * (-_WEIGHT[c] / 2) for c in _DIM])
    entry = F.struct(F.col(TARGET).alias("label"), weights.alias("w"), norm.alias("b"), "n")
    models = means.groupBy("scope", "model_key").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    total = F.aggregate("e", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    keep = (F.col("scope") == R.GLOBAL) | ((F.size("e") >= 6) & (total >= 63))
    return models.where(keep).select(
        "scope", "model_key", F.transform("e", lambda x: x["label"]).alias("classes"),
        F.transform("e", lambda x: x["w"]).alias("coefficients"), F.transform("e", lambda x: x["b"]).alias("intercepts"),
        F.array(*[F.lit(1.0 + i) for i in range(len(_DIM))]).alias("scales"))


@query("model_fallback_join", O.sessions("select session_id, used as used_model_key, case when used='global' then 1 else 0 end as is_fallback_used from keyed", *_SCORED[:4]))
def model_fallback_join(spark, sf):
    sessions = session_rows(spark, sf).select("session_id", "user_id")
    return L.model_fallback(sessions, centroid_models(spark, sf)).select("session_id", "used_model_key", "is_fallback_used")


_SCORE_SQL = """select session_id, used as used_model_key, case when used='global' then 1 else 0 end as is_fallback_used,
  arg_max(l, p) as prediction, round(max(p)*100,6) as confidence from probs group by 1,2"""


@query("score_linear_sql", O.sessions(_SCORE_SQL, *_SCORED))
def score_linear_sql(spark, sf):
    rows = session_rows(spark, sf).select("session_id", "user_id", *_DIM)
    scored = L.score_linear(rows, centroid_models(spark, sf), features=_DIM)
    return rounded(scored.select("session_id", "used_model_key", "is_fallback_used", "prediction", "confidence"))


@query("prediction_struct", O.sessions("select session_id, l as label, round(p,6) as probability from probs", *_SCORED))
def prediction_struct(spark, sf):
    """The probability map of every session, by its own or the global model, one row per label."""
    rows = session_rows(spark, sf).select("session_id", "user_id", *_DIM)
    scored = L.score_linear(rows, centroid_models(spark, sf), features=_DIM)
    return rounded(L.probability_rows(scored, "session_id"))


@query("logistic_importance", O.sessions(
    "select k as model_key, feature, position::int as position, round(avg(abs(v)),9) as importance from (" + " union all ".join(
        f"select k, '{c}' as feature, {i} as position, {_WEIGHT[c]}::double*m_{c}*{1.0 + i}::double as v from cents where k='global' or k in (select k from own)" for i, c in enumerate(_DIM))
    + ") group by 1,2,3", *_SCORED[:3]))
def logistic_importance(spark, sf):
    return rounded(L.coefficient_importance(centroid_models(spark, sf), _DIM), 9)


# Registry from the events: every event promotes a model of its user; models of 'error' events are
# missing from the store; a user whose latest model is missing has none.
@query("active_model_pointer", """select user_key as model_key, model_path, algorithm from (
  select cast(user_id as varchar) as user_key, '/models/' || event_id as model_path, event_type as algorithm, event_type as t,
  row_number() over (partition by user_id order by ts desc, '/models/' || event_id desc) as k from events) where k=1 and t <> 'error'""")
def active_model_pointer(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    path = F.concat(F.lit("/models/"), F.col("event_id").cast("string")).alias("model_path")
    registry = events.select(F.lit(R.PERSONAL).alias("scope"), S.user_key(F.col("user_id")).alias("model_key"), path, F.col("event_type").alias("algorithm"),
                             F.col("ts").alias("promoted_at"))
    artifacts = events.where(F.col("event_type") != "error").select(path)
    return R.active_models(registry, artifacts).select("model_key", "model_path", "algorithm")
