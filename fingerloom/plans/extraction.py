"""Registered queries: scans, scalar expressions, filters and joins over the typing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fingerloom.functions import scalars as S
from fingerloom.operators import extract as X
from fingerloom.plans import oracle as O
from fingerloom.plans.catalog import query, rounded
from fingerloom.schema import (
    DWELL_COLUMNS, ERROR_COLUMNS, FEATURES, FINGERS, FLIGHT_COLUMNS, SESSION_SCHEMA, TARGET, finger_columns, rename_fingers,
)
from fingerloom.session import scratch_path
from fingerloom.sources import layout as Ly
from fingerloom.sources import tables as Tb
from fingerloom.sources.bridge import feature_table, session_rows, typing_table

_DATASET = [f.name for f in SESSION_SCHEMA if f.name != "timestamp"]
_ROW_SQL = f"select user_id, session_id, {O.r6(*FEATURES)}, weakest_finger from sessions"


def dataset(spark, sf):
    """The session dataset in file layout."""
    return session_rows(spark, sf).select(
        "user_id", "session_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), *FEATURES, TARGET)


@query("scan_sessions_csv", O.sessions(_ROW_SQL))
def scan_sessions_csv(spark, sf):
    path = scratch_path(spark, "sessions-csv")
    Tb.write_sessions(dataset(spark, sf), path, format="csv")
    return rounded(Tb.read_sessions(spark, path).select(*_DATASET))


@query("sink_sessions", O.sessions(_ROW_SQL))
def sink_sessions(spark, sf):
    path = scratch_path(spark, "sessions")
    helper = dataset(spark, sf).withColumn("weakest_inferred", F.col(TARGET))
    Tb.write_sessions(helper, path)
    stored = Tb.read_sessions(spark, path, format="parquet")
    return rounded(stored.select(*_DATASET))


@query("scan_feature_tables", O.tables("select Id, DwellLeftPinky, FlightRightPinky, IsOutlier from feature where DwellLeftPinky > 90"))
def scan_feature_tables(spark, sf):
    path = scratch_path(spark, "features")
    feature_table(spark, sf).write.parquet(path)
    columns = ["Id", "DwellLeftPinky", "FlightRightPinky", "IsOutlier"]
    return Tb.read_table(spark, path, columns=columns).where(F.col("DwellLeftPinky") > 90)


_TRAINING_SQL = f"""select cast(Wpm as double) as wpm, round(case when Accuracy>1 then Accuracy/100.0::double else Accuracy end,6) as accuracy,
  {O.RENAMED}, lower(trim(coalesce(typing.WeakestFinger, {O.TOP1}))) as weakest_finger
  from feature join typing on typing.Id = feature.TypingSessionId where coalesce(IsOutlier,0)=0"""


@query("training_rows", O.tables(_TRAINING_SQL))
def training_rows(spark, sf):
    return rounded(X.training_rows(feature_table(spark, sf), typing_table(spark, sf)))


@query("label_distribution", O.tables(f"select weakest_finger, count(*) as n_rows from ({_TRAINING_SQL}) group by 1"))
def label_distribution(spark, sf):
    from fingerloom.operators.profile import label_distribution as distribution

    return distribution(X.training_rows(feature_table(spark, sf), typing_table(spark, sf)))


@query("accuracy_to_unit", O.tables("select Id, round(case when Accuracy>1 then Accuracy/100 else Accuracy end,6) as accuracy from typing"))
def accuracy_to_unit(spark, sf):
    return rounded(typing_table(spark, sf).select("Id", S.accuracy_to_unit(F.col("Accuracy")).alias("accuracy")))


# Accuracy x 1.05 puts some percent values over 100, which must stay as they are.
@query("accuracy_to_unit_bounded", O.tables(
    "select Id, round(case when a>1 and a<=100 then a/100 else a end,6) as accuracy from (select Id, Accuracy*1.05::double as a from typing)"))
def accuracy_to_unit_bounded(spark, sf):
    a = F.col("Accuracy") * F.lit(1.05)
    return rounded(typing_table(spark, sf).select("Id", S.accuracy_to_unit_bounded(a).alias("accuracy")))


@query("accuracy_to_percent", O.tables("select Id, round(case when Accuracy<=1 then Accuracy*100 else Accuracy end,6) as accuracy from typing"))
def accuracy_to_percent(spark, sf):
    return rounded(typing_table(spark, sf).select("Id", S.accuracy_to_percent(F.col("Accuracy")).alias("accuracy")))


@query("weakest_by_max_error", O.tables(f"select Id, {O.TOP1} as weakest_finger from feature"))
def weakest_by_max_error(spark, sf):
    return feature_table(spark, sf).select("Id", S.weakest_by_max_error(X.pascal_errors()).alias(TARGET))


# Errors cut to one decimal tie often, so the tie rule decides many rows.
@query("weakest_by_column_order", O.sessions(
    f"select session_id, {O.argmax(O.ERRORS, FINGERS)} as weakest_finger from (select session_id, "
    + ", ".join(f"round({c},1) as {c}" for c in O.ERRORS) + " from sessions)"))
def weakest_by_column_order(spark, sf):
    errors = {f: F.round(c, 1) for f, c in zip(FINGERS, ERROR_COLUMNS)}
    return session_rows(spark, sf).select("session_id", S.weakest_by_column_order(errors).alias(TARGET))


@query("label_coalesce", O.tables(
    f"select feature.Id, lower(trim(coalesce(typing.WeakestFinger, {O.TOP1}))) as weakest_finger "
    "from feature join typing on typing.Id = feature.TypingSessionId"))
def label_coalesce(spark, sf):
    joined = X.join_feature_session(feature_table(spark, sf), typing_table(spark, sf))
    return joined.select("Id", S.label_coalesce(F.col("WeakestFinger"), S.weakest_by_max_error(X.pascal_errors())).alias(TARGET))


_VALID_SQL = O.tables(
    f"""select feature.Id, case when lower(trim(typing.WeakestFinger)) in ({O.ALLOWED}) then lower(trim(typing.WeakestFinger))
    else l.n end as weakest_finger from feature join typing on typing.Id = feature.TypingSessionId,
    lateral (select v.n from (values """ + ", ".join(f"('{f}', feature.{c})" for f, c in zip(FINGERS, O.PASCAL[:8]))
    + ") as v(n, e) order by v.e desc nulls last, v.n limit 1) l")


@query("label_valid_or_inferred", _VALID_SQL)
def label_valid_or_inferred(spark, sf):
    joined = X.join_feature_session(feature_table(spark, sf), typing_table(spark, sf))
    label = S.label_valid_or_inferred(F.col("WeakestFinger"), S.weakest_by_max_error(X.pascal_errors()))
    return joined.select("Id", label.alias(TARGET))


@query("lateral_top1", O.tables(
    "select feature.Id, l.n as finger, l.e as error_rate from feature, lateral (select v.n, v.e from (values "
    + ", ".join(f"('{f}', feature.{c})" for f, c in zip(FINGERS, O.PASCAL[:8]))
    + ") as v(n, e) order by v.e desc nulls last, v.n limit 1) l"))
def lateral_top1(spark, sf):
    """The correlated top-1 as row expressions: neither a join nor a shuffle."""
    errors = X.pascal_errors()
    return feature_table(spark, sf).select(
        "Id", S.weakest_by_max_error(errors).alias("finger"), F.greatest(*errors.values()).alias("error_rate"))


_MEANS = {m: "(" + "+".join(cs) + ")/8.0::double" for m, cs in (("dwell", O.PASCAL[8:16]), ("flight", O.PASCAL[16:]))}


@query("timing_averages", O.tables(
    f"select cast(Id as varchar) as session_feature_id, round({_MEANS['dwell']},6) as dwell_time_avg, "
    f"round({_MEANS['flight']},6) as flight_time_avg, coalesce(IsOutlier,0) as is_outlier from feature"))
def timing_averages(spark, sf):
    return rounded(X.timing_averages(feature_table(spark, sf)))


# Text forms of the metrics: plain, padded, exponent, words and 'nan', by row.
_TEXT_SQL = {c: f"case mod(cast(session_id as bigint) + {i}, 7) when 0 then 'n/a' when 1 then concat(' ', cast({c} as varchar), ' ') "
             f"when 2 then '1e3' when 3 then 'nan' else cast({c} as varchar) end" for i, c in enumerate(FEATURES)}


def text_features():
    def text(i, c):
        k = F.pmod(F.col("session_id").cast("bigint") + i, F.lit(7))
        plain = F.col(c).cast("string")
        return (F.when(k == 0, "n/a").when(k == 1, F.concat(F.lit(" "), plain, F.lit(" ")))
                .when(k == 2, "1e3").when(k == 3, "nan").otherwise(plain).alias(c))
    return [text(i, c) for i, c in enumerate(FEATURES)]


@query("coerce_numeric", O.sessions("select session_id, " + ", ".join(
    f"case when not isnan({c}) then {c} end as {c}" for c in FEATURES) + " from (select session_id, " + ", ".join(
    f"try_cast(trim({s}) as double) as {c}" for c, s in _TEXT_SQL.items()) + " from sessions)"))
def coerce_numeric(spark, sf):
    rows = session_rows(spark, sf).select("session_id", *text_features())
    return rows.select("session_id", *[S.to_number(F.col(c)).alias(c) for c in FEATURES])


@query("normalize_label", O.tables(
    r"""select Id, regexp_replace(concat(chr(9), WeakestFinger, ' '), '^\s+|\s+$', '', 'g') as label,
    lower(regexp_replace(concat(chr(9), WeakestFinger, ' '), '^\s+|\s+$', '', 'g')) as lower_label
    from typing where WeakestFinger is not null"""))
def normalize_label(spark, sf):
    raw = F.concat(F.lit("\t"), F.col("WeakestFinger"), F.lit(" "))
    return typing_table(spark, sf).where(F.col("WeakestFinger").isNotNull()).select(
        "Id", S.normalize_label(raw).alias("label"), S.normalize_label(raw, lower=True).alias("lower_label"))


# Customer names as user ids: mixed case, '#', and blanks around them.
@query("normalize_user_key", "select c_custkey, lower(trim(concat('  ', c_name, ' '))) as user_key from customer")
def normalize_user_key(spark, sf):
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", S.user_key(raw).alias("user_key"))


@query("model_key", r"""select c_custkey,
  coalesce(nullif(regexp_replace(regexp_replace(lower(trim(concat(' ', c_name, '@@', c_mktsegment, '. '))), '[^a-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'anonymous') as model_key,
  coalesce(nullif(regexp_replace(replace(trim(concat(' ', c_name, '@@', c_mktsegment, '. ')), ' ', '_'), '[^A-Za-z0-9@._-]+', '_', 'g'), ''), 'unknown') as file_segment
  from customer""")
def model_key(spark, sf):
    raw = F.concat(F.lit(" "), F.col("c_name"), F.lit("@@"), F.col("c_mktsegment"), F.lit(". "))
    return spark.read.parquet(f"{sf}/customer.parquet").select(
        "c_custkey", S.model_key(raw).alias("model_key"), S.filename_segment(raw).alias("file_segment"))


# State names derived from the hash of a row: every known form, and one unknown.
_STATE_SQL = f"""case {O.h('state', 8)} when 0 then '0' when 1 then ' Normal ' when 2 then 'FALSE' when 3 then '1'
  when 4 then 'fatigued' when 5 then 'Fatigue' when 6 then 'true' else 'tired' end"""


@query("binary_state_label", f"""select event_type, event_id, case when s in ('0','normal','false') then 0 when s in ('1','fatigued','fatigue','true') then 1 end as state,
  cast(bool_and(s <> 'tired') over (partition by event_type) as int) as all_known
  from (select event_id, event_type, lower(trim({_STATE_SQL})) as s from events)""")
def binary_state_label(spark, sf):
    from fingerloom.functions.draws import draw_int

    d = draw_int(F.col("event_id"), "state", 8)
    forms = ["0", " Normal ", "FALSE", "1", "fatigued", "Fatigue", "true", "tired"]
    raw = F.get(F.array(*[F.lit(f) for f in forms]), d.cast("int"))
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", S.binary_state(raw).alias("state"))
    # All-or-nothing per data set: aggregated first, so a large set is not sent to one task.
    known = rows.groupBy("event_type").agg(F.bool_and(F.col("state").isNotNull()).cast("int").alias("all_known"))
    return rows.join(known, "event_type")


_CODED = ("cast(label_index as int) as label_index from sessions join (select weakest_finger as f, "
    "row_number() over (order by weakest_finger) - 1 as label_index from (select distinct weakest_finger from sessions)) on f = weakest_finger")


def _coded(spark, sf):
    from fingerloom.operators.models import label_classes

    rows = session_rows(spark, sf)
    classes = label_classes(rows)
    return rows.select("session_id", TARGET, S.encode_label(F.col(TARGET), classes).alias("label_index")), classes


@query("encode_label", O.sessions(f"select session_id, weakest_finger, {_CODED}"))
def encode_label(spark, sf):
    return _coded(spark, sf)[0]


@query("decode_label", O.sessions(
    f"select session_id, weakest_finger as decoded, cast(label_index + 100 as varchar) as decoded_out_of_range from (select session_id, weakest_finger, {_CODED})"))
def decode_label(spark, sf):
    coded, classes = _coded(spark, sf)
    return coded.select(
        "session_id", S.decode_label(F.col("label_index"), classes, strict=True).alias("decoded"),
        S.decode_label(F.col("label_index") + 100, classes).alias("decoded_out_of_range"))


@query("finger_columns", O.sessions(f"select session_id, {', '.join(f'{s} as {p}' for s, p in zip(O.SNAKE, O.PASCAL))} from sessions"))
def finger_column_names(spark, sf):
    rows = session_rows(spark, sf).select("session_id", *ERROR_COLUMNS, *DWELL_COLUMNS, *FLIGHT_COLUMNS)
    return rename_fingers(rows, to="pascal")


@query("unpivot_fingers", O.sessions(" union all ".join(
    f"select session_id, '{f}' as finger, error_{f} as error_rate, dwell_{f} as dwell_ms, flight_{f} as flight_ms from sessions"
    for f in FINGERS)))
def unpivot_fingers(spark, sf):
    return X.unpivot_fingers(session_rows(spark, sf))


@query("inline_row_normalize", O.tables(
    r"""select coalesce(nullif(case when Id % 3 = 0 then '' when Id % 3 = 1 then null else cast(UserId as varchar) end, ''), 'u-requested') as user_id,
    Id, lower(trim(WeakestFinger)) as weakest_finger,
    round(case when Accuracy>1 and Accuracy<=100 then Accuracy/100 else Accuracy end,6) as accuracy from typing"""))
def inline_row_normalize(spark, sf):
    k = F.col("Id") % 3
    rows = typing_table(spark, sf).select(
        F.when(k == 0, "").when(k == 1, F.lit(None)).otherwise(F.col("UserId").cast("string")).alias("user_id"),
        "Id", F.col("WeakestFinger").alias(TARGET), F.col("Accuracy").alias("accuracy"))
    return rounded(X.normalize_inline_rows(rows, "u-requested"))


@query("lineage_route", """select case when event_type in ('view','click') then 'experiments' else 'production' end as lineage, count(*) as n_rows
  from events group by 1""")
def lineage_route(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "click"), " Synthetic ").otherwise("REAL")
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", S.lineage_folder(kind).alias("lineage"))
    path = scratch_path(spark, "lineage")
    Tb.write_sessions(rows, path, partition_by=("lineage",))
    stored = spark.read.schema("event_id bigint, lineage string").parquet(path)
    return stored.groupBy("lineage").agg(F.count(F.lit(1)).alias("n_rows"))


@query("clip_round", "select event_id, cast(greatest(least(round_even(value,0),60),2) as int) as clipped, "
       "cast(greatest(round_even(value,0),2) as int) as clipped_low from events")
def clip_round(spark, sf):
    v = F.col("value")
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", S.clip_round(v, 2, 60).alias("clipped"), S.clip_round(v, 2).alias("clipped_low"))


@query("filter_user", O.sessions("select session_id, user_id, wpm, weakest_finger from sessions where lower(trim(user_id)) = '7'"))
def filter_user(spark, sf):
    return X.filter_user(session_rows(spark, sf), " 7 ").select("session_id", "user_id", "wpm", TARGET)


@query("filter_user_bucketed", O.sessions("select session_id, user_id, wpm, weakest_finger from sessions where lower(trim(user_id)) = '7'"))
def filter_user_bucketed(spark, sf):
    """The same of a table bucketed by user: one bucket is read."""
    rows = session_rows(spark, sf).select("session_id", "user_id", "wpm", TARGET)
    stored = Ly.save_sessions_by_user(rows, f"sessions_{uuid.uuid4().hex}", scratch_path(spark, "by-user"))
    return X.filter_user(stored, " 7 ").select("session_id", "user_id", "wpm", TARGET)


@query("filter_not_outlier", O.tables("select Id, IsOutlier from feature where coalesce(IsOutlier,0)=0"))
def filter_not_outlier(spark, sf):
    return X.not_outlier(feature_table(spark, sf)).select("Id", "IsOutlier")


_PENDING_SQL = f"""pending as (select TypingSessionId, SessionFeatureId, FeatureCapturedAt, weakest_finger, FlightTime, DwellTime,
  row_number() over (order by FeatureCapturedAt, SessionFeatureId) as Sesi from (
  select feature.TypingSessionId, feature.Id as SessionFeatureId, feature.CreatedAt as FeatureCapturedAt,
  {O.VALID.replace("inferred", O.TOP1)} as weakest_finger, {_MEANS['flight']} as FlightTime, {_MEANS['dwell']} as DwellTime
  from feature join typing on typing.Id = feature.TypingSessionId where IsUsedForTraining=0) where weakest_finger is not null)"""
_PENDING_COLUMNS = "TypingSessionId, SessionFeatureId, weakest_finger, round(FlightTime,6) as FlightTime, round(DwellTime,6) as DwellTime"


@query("filter_pending_training", O.tables(f"select {_PENDING_COLUMNS} from pending", _PENDING_SQL))
def filter_pending_training(spark, sf):
    rows = X.pending_training(feature_table(spark, sf), typing_table(spark, sf))
    return rounded(rows.select("TypingSessionId", "SessionFeatureId", TARGET, "FlightTime", "DwellTime"))


@query("session_sequence", O.tables(f"select Sesi, {_PENDING_COLUMNS} from pending", _PENDING_SQL))
def session_sequence(spark, sf):
    rows = X.pending_sequence(feature_table(spark, sf), typing_table(spark, sf))
    return rounded(rows.select("Sesi", "TypingSessionId", "SessionFeatureId", TARGET, "FlightTime", "DwellTime"))


@query("pending_preview", O.tables(f"select Sesi, {_PENDING_COLUMNS} from pending where Sesi <= 25", _PENDING_SQL))
def pending_preview(spark, sf):
    rows = X.pending_preview(feature_table(spark, sf), typing_table(spark, sf))
    return rounded(rows.select("Sesi", "TypingSessionId", "SessionFeatureId", TARGET, "FlightTime", "DwellTime"))


@query("join_feature_session", O.tables(
    "select feature.Id, UserId, Wpm, DwellLeftPinky, IsOutlier from feature join typing on typing.Id = feature.TypingSessionId"))
def join_feature_session(spark, sf):
    return X.join_feature_session(feature_table(spark, sf), typing_table(spark, sf)).select(
        "Id", "UserId", "Wpm", "DwellLeftPinky", "IsOutlier")


@query("join_feature_session_bucketed", O.tables(
    "select feature.Id, UserId, Wpm, DwellLeftPinky, IsOutlier from feature join typing on typing.Id = feature.TypingSessionId"))
def join_feature_session_bucketed(spark, sf):
    """The same of two tables bucketed by session: neither is shuffled."""
    name = uuid.uuid4().hex
    features = Ly.save_bucketed(feature_table(spark, sf), f"features_{name}", scratch_path(spark, "features"), "TypingSessionId", buckets=16)
    typing = Ly.save_bucketed(typing_table(spark, sf), f"typing_{name}", scratch_path(spark, "typing"), "Id", buckets=16)
    return X.join_feature_session(features, typing).select("Id", "UserId", "Wpm", "DwellLeftPinky", "IsOutlier")


# New outlier ids: sessions with a blank or unknown label.
@query("merge_outlier_flags", O.tables(
    """select feature.Id, case when l.Id is not null then 1 else 0 end as IsOutlier, 2 as n_versions
    from feature left join (select Id from typing where WeakestFinger in ('', 'thumb')) l on l.Id = feature.Id"""))
def merge_outlier_flags(spark, sf):
    """Flags written back to a versioned table and read from it; a second merge of the same ids makes no version."""
    root = scratch_path(spark, "versioned")
    Ly.create_versioned(feature_table(spark, sf), root, "Id", parts=16)
    ids = typing_table(spark, sf).where(F.col("WeakestFinger").isin("", "thumb")).select("Id")
    Ly.merge_outlier_flags(spark, root, ids)
    last = Ly.merge_outlier_flags(spark, root, ids)
    return Ly.read_versioned(spark, root).select("Id", "IsOutlier", F.lit(last.number + 1).alias("n_versions"))


@query("apply_outlier_flags", O.tables(
    """select feature.Id, case when l.Id is not null then 1 else 0 end as cleared, case when l.Id is not null then 1 else IsOutlier end as kept
    from feature left join (select Id from typing where WeakestFinger in ('', 'thumb')) l on l.Id = feature.Id"""))
def apply_outlier_flags(spark, sf):
    features = feature_table(spark, sf).select("Id", "IsOutlier")
    ids = typing_table(spark, sf).where(F.col("WeakestFinger").isin("", "thumb")).select("Id")
    both = X.apply_outlier_flags(features.withColumn("kept", F.col("IsOutlier")), ids, clear_existing=False, flag="kept")
    return X.apply_outlier_flags(both, ids).select("Id", F.col("IsOutlier").alias("cleared"), "kept")


# Inline rows: the same sessions sent again without ids and with percent accuracy.
@query("merge_history", O.sessions(
    """select user_id, session_id, round(wpm,6) as wpm, round(accuracy,6) as accuracy, weakest_finger from sessions
    union all select user_id, null, round(wpm,6), round(accuracy*100,6), weakest_finger from sessions"""))
def merge_history(spark, sf):
    stored = session_rows(spark, sf).select("user_id", "session_id", "wpm", "accuracy", TARGET)
    inline = stored.drop("session_id").withColumn("accuracy", F.col("accuracy") * 100)
    return rounded(X.merge_history(stored, inline))


@query("dedupe_exact", O.sessions(
    f"""select distinct user_id, session_id, {O.r6(*FEATURES)}, weakest_finger from (select * from sessions union all select * from sessions)"""))
def dedupe_exact(spark, sf):
    stored = session_rows(spark, sf).select(*_DATASET)
    return rounded(X.merge_history(stored, stored).dropDuplicates())
