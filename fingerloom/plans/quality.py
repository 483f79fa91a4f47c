"""Registered queries: cleaning, data-quality rules and profiling over the session dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from fingerloom.operators import cleaning as C
from fingerloom.operators import extract as X
from fingerloom.operators import profile as P
from fingerloom.operators import quality as Q
from fingerloom.plans import oracle as O
from fingerloom.plans.catalog import query, rounded
from fingerloom.plans.extraction import _MEANS, text_features, _TEXT_SQL
from fingerloom.schema import ERROR_COLUMNS, FEATURES, FINGERS, RANGE_RULES, TARGET, TIMING_COLUMNS
from fingerloom.sources.bridge import feature_table, session_rows

_KEY = "session_id, weakest_finger"


@query("drop_negative_timing", O.sessions(f"select {_KEY} from sessions where not {O.negative()}"))
def drop_negative_timing(spark, sf):
    return C.drop_negative(session_rows(spark, sf)).select("session_id", TARGET)


@query("drop_hard_cap", O.sessions(f"select {_KEY} from sessions where not {O.capped()}"))
def drop_hard_cap(spark, sf):
    return C.drop_over_cap(session_rows(spark, sf)).select("session_id", TARGET)


# The rule alone: bounds over all rows, extreme timings included.
@query("drop_iqr_upper", O.sessions(
    f"select {_KEY} from sessions, quartiles where not {O.OVER}", O.QUARTILES.replace("from kept", "from sessions")))
def drop_iqr_upper(spark, sf):
    return C.drop_over_iqr(session_rows(spark, sf)).select("session_id", TARGET)


@query("clean_timing_outliers", O.sessions(
    f"select session_id, {O.r6(*FEATURES)}, weakest_finger from cleaned", *O.CLEANING))
def clean_timing_outliers(spark, sf):
    rows = session_rows(spark, sf).select("session_id", *FEATURES, TARGET)
    return rounded(C.clean_timing(rows))


_STAGED = f"""(select weakest_finger, case when {O.negative()} then 'negative' when {O.capped()} then 'hard_cap' when {O.OVER} then 'iqr' else 'kept' end as stage
  from sessions, quartiles)"""


@query("cleaning_audit", O.sessions(
    f"""select weakest_finger, count(*) as rows_before, count(*) filter (stage='negative') as negative_rows,
    count(*) filter (stage='hard_cap') as hard_cap_rows, count(*) filter (stage='iqr') as iqr_rows, count(*) filter (stage='kept') as rows_after
    from {_STAGED} group by rollup (weakest_finger)""", O.KEPT, O.QUARTILES))
def cleaning_audit(spark, sf):
    rows = session_rows(spark, sf)
    per_label = C.cleaning_audit(rows, label=TARGET)
    names = per_label.columns[1:]
    total = per_label.agg(*[F.sum(c).alias(c) for c in names]).select(F.lit(None).cast("string").alias(TARGET), *names)
    return per_label.union(total)


_AVERAGES = f"averages as (select cast(Id as varchar) as session_feature_id, {_MEANS['dwell']} as dwell_time_avg, {_MEANS['flight']} as flight_time_avg from feature)"


def _two_sided(columns, source):
    good = " and ".join(f"not coalesce({c} < 0, false)" for c in columns)
    quartiles = ", ".join(f"quantile_cont({c},0.25) as q1_{c}, quantile_cont({c},0.75) as q3_{c}" for c in columns)
    out = " or ".join(f"coalesce({c} < q1_{c}-1.5::double*(q3_{c}-q1_{c}) or {c} > q3_{c}+1.5::double*(q3_{c}-q1_{c}), false)" for c in columns)
    return (f"two_q as (select {quartiles} from {source} where {good})",
            f"two_sided as (select {source}.*, case when not ({good}) then 'rejected' when {out} then 'outlier' else 'clean' end as status from {source}, two_q)")


_AVG_COLUMNS = ("dwell_time_avg", "flight_time_avg")
_TWO = (_AVERAGES, *_two_sided(_AVG_COLUMNS, "averages"))


@query("iqr_outliers_two_sided", O.tables("select session_feature_id, status from two_sided", *_TWO))
def iqr_outliers_two_sided(spark, sf):
    rows, _ = C.flag_two_sided(X.timing_averages(feature_table(spark, sf)), _AVG_COLUMNS)
    return rows.select("session_feature_id", "status")


@query("preprocessing_summary", O.tables(
    "select count(*) as rows_scanned, count(*) filter (status='clean') as rows_clean, count(*) filter (status='outlier') as outliers, "
    "count(*) filter (status='rejected') as rejected, "
    + ", ".join(f"round(any_value(q1_{c}),6) as q1_{c}, round(any_value(q3_{c}),6) as q3_{c}, round(any_value(q3_{c}-q1_{c}),6) as iqr_{c}, "
                f"round(any_value(q1_{c}-1.5::double*(q3_{c}-q1_{c})),6) as lower_{c}, round(any_value(q3_{c}+1.5::double*(q3_{c}-q1_{c})),6) as upper_{c}"
                for c in _AVG_COLUMNS)
    + ", (select string_agg(session_feature_id, ',') from (select session_feature_id from two_sided where status='outlier' order by session_feature_id limit 10)) as samples"
    " from two_sided, two_q", *_TWO))
def preprocessing_summary(spark, sf):
    from fingerloom.operators.summary import preprocessing_summary as summary

    flat = summary(X.timing_averages(feature_table(spark, sf)))
    bounds = [F.col(c)[b].alias(f"{b}_{c}") for c in _AVG_COLUMNS for b in ("q1", "q3", "iqr", "lower", "upper")]
    return rounded(flat.select(
        "rows_scanned", "rows_clean", "outliers", "rejected", *bounds,
        F.array_join(F.transform("samples", lambda s: s["session_feature_id"]), ",").alias("samples")))


@query("outlier_samples", O.tables(
    "select session_feature_id, round(dwell_time_avg,6) as dwell_time_avg, round(flight_time_avg,6) as flight_time_avg "
    "from two_sided where status='outlier' order by session_feature_id limit 10", *_TWO))
def outlier_samples(spark, sf):
    from fingerloom.operators.summary import outlier_samples as samples

    rows, _ = C.flag_two_sided(X.timing_averages(feature_table(spark, sf)), _AVG_COLUMNS)
    return rounded(samples(rows))


@query("iqr_filter_single", O.tables(
    "select session_feature_id, round(dwell_time_avg,6) as dwell_time_avg from averages, (select quantile_cont(dwell_time_avg,0.25) as a, "
    "quantile_cont(dwell_time_avg,0.75) as b from averages) where dwell_time_avg between a-1.5::double*(b-a) and b+1.5::double*(b-a)", _AVERAGES))
def iqr_filter_single(spark, sf):
    rows = X.timing_averages(feature_table(spark, sf)).select("session_feature_id", "dwell_time_avg")
    return rounded(C.keep_inside_iqr(rows, "dwell_time_avg"))


# Speed and accuracy are stretched so that both rules drop rows.
@query("filter_domain_range", O.sessions(
    "select session_id, round(wpm,6) as wpm, round(accuracy,6) as accuracy from (select session_id, wpm*4 as wpm, accuracy*1.1::double as accuracy from sessions) "
    "where wpm between 0 and 250 and accuracy between 0 and 1"))
def filter_domain_range(spark, sf):
    rows = session_rows(spark, sf).select("session_id", (F.col("wpm") * 4).alias("wpm"), (F.col("accuracy") * 1.1).alias("accuracy"))
    return rounded(C.keep_domain_range(rows))


_REQUIRED = [*FEATURES, TARGET, "keyboard_layout"]


@query("dq_required_columns", O.sessions(" union all ".join(
    f"select '{c}' as column_name, {int(c == 'keyboard_layout')} as is_missing, {'count(null)' if c == 'keyboard_layout' else f'count({c})'} as n_values from sessions"
    for c in _REQUIRED)))
def dq_required_columns(spark, sf):
    """Missing columns by schema, beside the number of values of the present ones."""
    rows = session_rows(spark, sf)
    missing = Q.missing_columns(rows, _REQUIRED)
    counts = rows.agg(*[(F.lit(0) if c in missing else F.count(c)).cast("bigint").alias(c) for c in _REQUIRED])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(int(c in missing)).alias("is_missing"), F.col(c).alias("n_values"))
        for c in _REQUIRED])))


def _rule_sql():
    parts = []
    for c, (low, high) in RANGE_RULES.items():
        x = f"(case when not isnan({c}) then {c} end)"
        tests = [("null_or_non_numeric", f"{x} is null"), ("non_finite", f"isinf({x})"), ("below_min", f"{x} < {low}")]
        if high is not None:
            tests.append(("above_max", f"{x} > {high}"))
        parts += [f"select '{c}' as column_name, '{r}' as rule, count(*) filter ({t}) as n_rows from coerced" for r, t in tests]
    return " union all ".join(parts)


_COERCED = "coerced as materialized (select " + ", ".join(f"try_cast(trim({s}) as double) as {c}" for c, s in _TEXT_SQL.items()) + " from sessions)"


@query("dq_feature_rules", O.sessions(_rule_sql(), _COERCED))
def dq_feature_rules(spark, sf):
    return Q.feature_violations(session_rows(spark, sf).select(*text_features()))


@query("invalid_error_rows", O.sessions(
    "select count(*) filter (" + " or ".join(f"{c} > 1" for c in ERROR_COLUMNS) + ") as invalid_rows from (select "
    + ", ".join(f"{c}*11 as {c}" for c in ERROR_COLUMNS) + " from sessions)"))
def invalid_error_rows(spark, sf):
    """Error rates are stretched, so that some leave the 0..1 range."""
    return Q.invalid_error_rows(session_rows(spark, sf).select(*[(F.col(c) * 11).alias(c) for c in ERROR_COLUMNS]))


@query("dq_label_rules", O.sessions(f"""
  select 'null_labels' as rule, coalesce(sum(n) filter (l is null),0) as n_found from counts
  union all select 'blank_labels', coalesce(sum(n) filter (l = ''),0) from counts
  union all select 'unsupported_labels', coalesce(sum(n) filter (l <> '' and l not in ({O.ALLOWED})),0) from counts
  union all select 'missing_classes', greatest(2 - count(*) filter (l is not null), 0) from counts
  union all select 'sparse_classes', count(*) filter (l is not null and n < 2) from counts""",
    "counts as (select trim(stated_finger) as l, count(*) as n from sessions group by 1)"))
def dq_label_rules(spark, sf):
    return Q.label_violations(session_rows(spark, sf), "stated_finger")


@query("dq_min_rows", O.sessions("""select user_id, n_rows, n_classes, smallest_class,
  case when n_rows < 60 then 'insufficient_data' when smallest_class < 5 then 'thin_class' else 'ready' end as status from (
  select user_id, sum(n)::bigint as n_rows, count(*) as n_classes, min(n) as smallest_class from (
  select user_id, weakest_finger, count(*) as n from sessions group by 1,2) group by 1)"""))
def dq_min_rows(spark, sf):
    """The row threshold is set to the size of a typical user, so that both outcomes occur."""
    return Q.user_readiness(session_rows(spark, sf), min_rows=60)


_INFERRED = f"inferred_labels as (select *, {O.argmax(O.ERRORS, FINGERS)} as weakest_inferred from sessions)"


@query("label_mismatch", O.sessions(
    "select count(*) as n_rows, count(*) filter (weakest_inferred is distinct from weakest_finger) as n_mismatch, "
    "round(avg(case when weakest_inferred is distinct from weakest_finger then 1.0::double else 0.0::double end),4) as mismatch_rate from inferred_labels", _INFERRED))
def label_mismatch(spark, sf):
    return Q.label_mismatch(session_rows(spark, sf))


@query("label_mismatch_samples", O.sessions(
    f"select session_id, stated_finger, weakest_inferred, {', '.join(ERROR_COLUMNS)} from inferred_labels "
    "where weakest_inferred is distinct from stated_finger order by session_id limit 10", _INFERRED))
def label_mismatch_samples(spark, sf):
    return Q.label_mismatch_samples(session_rows(spark, sf), "session_id", "stated_finger")


_TABLE_COLUMNS = ["Id", "TypingSessionId", "CreatedAt", "IsOutlier", "IsUsedForTraining", *O.PASCAL]


@query("profile_missing", O.tables("select * from (" + " union all ".join(
    f"select '{c}' as column_name, count(*) filter ({c} is null) as n_missing from feature" for c in _TABLE_COLUMNS) + ") where n_missing > 0"))
def profile_missing(spark, sf):
    return P.profile_missing(feature_table(spark, sf).select(*_TABLE_COLUMNS))


# Whole session rows; those of every fifth session stand twice, and those of every seventh once more under another user.
_TWICE = """twice as (select * from sessions union all select * from sessions where cast(session_id as bigint) % 5 = 0
  union all select * replace ('other' as user_id) from sessions where cast(session_id as bigint) % 7 = 0)"""


@query("profile_duplicates", O.sessions("""select 'rows' as scope, (select count(*) from twice) - (select count(*) from (select distinct * from twice)) as n_duplicates
  union all select 'session_id', (select count(*) from twice) - (select count(distinct session_id) from twice)""", _TWICE))
def profile_duplicates(spark, sf):
    rows = session_rows(spark, sf)
    number = F.col("session_id").cast("bigint")
    twice = rows.union(rows.where(number % 5 == 0)).union(rows.where(number % 7 == 0).withColumn("user_id", F.lit("other")).select(*rows.columns))
    return P.profile_duplicates(twice, key="session_id")


@query("profile_describe", O.sessions(" union all ".join(
    f"select '{c}' as column_name, count({c}) as n_values, round(avg({c}),6) as mean, round(stddev_samp({c}),6) as std, round(min({c}),6) as min, "
    f"round(quantile_cont({c},0.25),6) as q25, round(quantile_cont({c},0.5),6) as q50, round(quantile_cont({c},0.75),6) as q75, round(max({c}),6) as max from sessions"
    for c in FEATURES)))
def profile_describe(spark, sf):
    return rounded(P.describe_numeric(session_rows(spark, sf), FEATURES))


_TEXT_COLUMNS = ["user_id", "session_id", "cohort", "stated_finger", TARGET]


@query("profile_describe_text", O.sessions(" union all ".join(
    f"select '{c}' as column_name, (select count({c}) from sessions) as n_values, (select count(distinct {c}) from sessions) as n_unique, v as top, n as freq from "
    f"(select {c} as v, count(*) as n from sessions where {c} is not null group by 1 order by n desc, v limit 1)" for c in _TEXT_COLUMNS)))
def profile_describe_text(spark, sf):
    return P.describe_text(session_rows(spark, sf), _TEXT_COLUMNS)


@query("iqr_bounds", O.sessions(" union all ".join(
    f"select '{c}' as column_name, round(q1_{c},6) as q1, round(q3_{c},6) as q3, round(q3_{c}-q1_{c},6) as iqr, "
    f"round(q1_{c}-1.5::double*(q3_{c}-q1_{c}),6) as lower_bound, round(q3_{c}+1.5::double*(q3_{c}-q1_{c}),6) as upper_bound from quartiles"
    for c in TIMING_COLUMNS), O.KEPT, O.QUARTILES))
def iqr_bounds(spark, sf):
    rows = C.drop_over_cap(C.drop_negative(session_rows(spark, sf)))
    bounds = C.iqr_bounds(rows, TIMING_COLUMNS)
    table = [(c, b.q1, b.q3, b.iqr, b.lower, b.upper) for c, b in bounds.items()]
    return rounded(spark.createDataFrame(
        table, "column_name string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double"))


_PAIRS = "pairs as materialized (select * from sessions)"


@query("correlation_matrix", O.sessions("select column_x, column_y, round(c,6) as correlation from (" + " union all ".join(
    "select unnest([" + ",".join(f"'{a}'" for b in FEATURES) + "]) as column_x, unnest([" + ",".join(f"'{b}'" for b in FEATURES)
    + "]) as column_y, unnest([" + ",".join(f"corr({a},{b})" for b in FEATURES) + "]) as c from pairs" for a in FEATURES) + ")", _PAIRS))
def correlation_matrix(spark, sf):
    return rounded(P.correlation_matrix(session_rows(spark, sf), FEATURES))


@query("histogram_bins", O.sessions(" union all ".join(
    f"""select '{c}' as column_name, b.i::int as bin, round(lo + b.i*(hi-lo)/20,6) as bin_low, round(lo + (b.i+1)*(hi-lo)/20,6) as bin_high, coalesce(n,0) as n_rows
    from (select unnest(range(20)) as i) b cross join (select min({c}) as lo, max({c}) as hi from sessions)
    left join (select least(floor(({c}-lo)/((hi-lo)/20))::int, 19) as k, count(*) as n from sessions, (select min({c}) as lo, max({c}) as hi from sessions) where {c} is not null group by 1) on k = b.i"""
    for c in ("wpm", "accuracy"))))
def histogram_bins(spark, sf):
    rows = session_rows(spark, sf)
    parts = [P.histogram_bins(rows, c).withColumn("column_name", F.lit(c)) for c in ("wpm", "accuracy")]
    return rounded(parts[0].unionByName(parts[1]))


def _box(stage, source):
    return (f"select '{stage}' as stage, count(x) as n_rows, round(min(x) filter (x between q1-1.5::double*(q3-q1) and q3+1.5::double*(q3-q1)),6) as whisker_low, "
            f"round(any_value(q1),6) as q1, round(any_value(q2),6) as median, round(any_value(q3),6) as q3, "
            f"round(max(x) filter (x between q1-1.5::double*(q3-q1) and q3+1.5::double*(q3-q1)),6) as whisker_high, "
            f"count(*) filter (not (x between q1-1.5::double*(q3-q1) and q3+1.5::double*(q3-q1))) as n_fliers "
            f"from {source}, (select quantile_cont(x,0.25) as q1, quantile_cont(x,0.5) as q2, quantile_cont(x,0.75) as q3 from {source})")


@query("boxplot_stats", O.tables(
    _box("before", "box") + " union all " + _box("after", "boxed"), _AVERAGES, "box as (select dwell_time_avg as x from averages)",
    "boxed as (select x from box, (select quantile_cont(x,0.25) as a, quantile_cont(x,0.75) as b from box) where x between a-1.5::double*(b-a) and b+1.5::double*(b-a))"))
def boxplot_stats(spark, sf):
    return rounded(P.boxplot_stats(X.timing_averages(feature_table(spark, sf)), "dwell_time_avg"))
