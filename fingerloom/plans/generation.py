"""Registered queries: synthetic telemetry for the users, suppliers and tasks of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fingerloom.operators import generate as G
from fingerloom.plans import oracle as O
from fingerloom.plans.catalog import query, rounded
from fingerloom.schema import FEATURES, FINGERS, TARGET

_ARRAY = "[" + ",".join(f"'{f}'" for f in FINGERS) + "]"
_K = "k"
_DRIFT = (
    "u as (select format('u{:04d}', s_suppkey) as user_id from supplier)",
    "raw as (select user_id, s as session_index, user_id || '/' || s as k from u, (select unnest(range(20)) as s))",
    f"""drawn as (select *, case when session_index = 0 or {O.unit(_K, 'drift')} < 0.18 then {_ARRAY}[1 + {O.h('finger', 8, _K)}] end as d from raw)""",
    "drift as (select user_id, session_index, k, last_value(d ignore nulls) over (partition by user_id order by session_index) as weakest_finger from drawn)",
)


def users(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.format_string("u%04d", "s_suppkey").alias("user_id"))


@query("weak_finger_drift", "with " + ", ".join(_DRIFT) + " select user_id, session_index, weakest_finger from drift")
def weak_finger_drift(spark, sf):
    """Blocks of seven sessions, so that the carry from block to block is exercised."""
    return G.weak_finger_drift(users(spark, sf), 20, block=7)


def _session_sql():
    cols = []
    for f in FINGERS:
        def lift(tag, low, high):
            return f"case when weakest_finger='{f}' then {O.uniform(_K, tag + f, low, high)} else 0 end"
        cols.append(f"round(greatest(least(greatest(0,1-acc)*{O.uniform(_K, 'er' + f, '0.65', '1.05')}+{O.normal(_K, 'en' + f, '0', '0.002')}+{lift('el', '0.05', '0.115')},0.30::double),0),3) as error_{f}")
        cols.append(f"round(greatest(least({O.uniform('user_id', 'base_dwell', '72', '105')}+{O.normal(_K, 'dn' + f, '0', '5.5')}+{lift('dl', '28', '58')},300),40),1) as dwell_{f}")
        cols.append(f"round(greatest(least({O.uniform('user_id', 'base_flight', '165', '260')}-w*0.45::double+{O.normal(_K, 'fn' + f, '0', '11')}+{lift('fl', '65', '120')},500),50),1) as flight_{f}")
    base = (f"base as (select *, greatest(least({O.uniform('user_id', 'base_wpm', '28', '78')}+0.55::double*session_index+{O.normal(_K, 'wpm', '0', '3.2')},145),15) as w, "
            f"greatest(least({O.uniform('user_id', 'base_acc', '0.86', '0.97')}+0.0012::double*session_index+{O.normal(_K, 'acc', '0', '0.009')},0.997::double),0.68::double) as acc from drift)")
    stamp = f"strftime(timestamp '2025-12-01 09:00:00' + to_days(session_index::int) + to_minutes({O.h('minute', 240, _K)}), '%Y-%m-%dT%H:%M:%S')"
    return ("with " + ", ".join([*_DRIFT, base]) + f" select user_id, md5(k || ':session') as session_id, {stamp} as \"timestamp\", round(w,1) as wpm, round(acc,3) as accuracy, "
            + ", ".join(cols) + ", weakest_finger from base")


@query("generate_sessions", _session_sql())
def generate_sessions(spark, sf):
    return rounded(G.generate_sessions(users(spark, sf), 20))


def _rint(x, low, high=None):
    x = f"round_even({x},0)"
    return f"cast(greatest({f'least({x},{high})' if high else x},{low}) as int)"


def _seed_sql():
    def timing(m, i, c, mean, std):
        return (f"case when Sesi%10=0 and {O.h(m + 'pick1', 8, _K)}={i} then 2500+{O.h(m + 'slow1', 2501, _K)} "
                f"when Sesi%10=0 and ({O.h(m + 'pick1', 8, _K)}+1+{O.h(m + 'pick2', 7, _K)})%8={i} then 2500+{O.h(m + 'slow2', 2501, _K)} "
                f"else {_rint(O.normal(_K, c, mean, std), 1)} end as {c}")
    cols = [f"round({O.uniform(_K, c, '0', '0.05')},4) as {c}" for c in O.PASCAL[:8]]
    cols += [timing("dwell", i, c, "100", "15") for i, c in enumerate(O.PASCAL[8:16])]
    cols += [timing("flight", i, c, "200", "30") for i, c in enumerate(O.PASCAL[16:])]
    return (f"select user_id as UserId, Sesi, {_rint(O.normal(_K, 'WPM', '45', '5'), 1)} as WPM, round({O.uniform(_K, 'Accuracy', '0.85', '0.99')},4) as Accuracy, "
            + ", ".join(cols) + " from (select *, user_id || '/' || Sesi as k from (select format('u{:04d}', s_suppkey) as user_id from supplier), (select unnest(range(1,51)) as Sesi))")


@query("generate_seed_telemetry", _seed_sql())
def generate_seed_telemetry(spark, sf):
    return rounded(G.generate_seed_telemetry(users(spark, sf), 50))


def tasks(spark, sf):
    """One generation task per supplier, of 1 to 300 sessions."""
    from fingerloom.functions.draws import draw_int

    key = F.col("s_suppkey")
    return spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.concat(F.lit("task-"), key.cast("string")).alias("task_id"),
        (1 + draw_int(key, "sessions", 300)).alias("sessions"), (draw_int(key, "inject", 2) == 1).alias("inject_outliers"))


_TASKS = (f"tasks as (select 'task-' || s_suppkey as task_id, 1+{O.h('sessions', 300, 's_suppkey')} as sessions, {O.h('inject', 2, 's_suppkey')}=1 as inject from supplier)",
          "trows as (select task_id, sessions, inject, unnest(range(1, sessions+1)) as row_no from tasks)")


def chunk_columns(slow: str) -> str:
    """All 26 measured fields of a chunk row in SQL, drawn by ``k``; ``slow`` says of which rows every tenth is."""
    def timing(c, mean, std, low, high):
        return f"case when {slow} and row_no%10=0 then 5000 else {_rint(O.normal(_K, c, mean, std), low, high)} end as {c}"
    cols = [f"{_rint(O.normal(_K, 'WPM', '48', '9'), 12, 180)} as WPM", f"round({O.uniform(_K, 'Accuracy', '0.86', '0.995')},4) as Accuracy"]
    cols += [f"round({O.uniform(_K, c, '0', '0.06')},4) as {c}" for c in O.PASCAL[:8]]
    cols += [timing(c, "105", "18", 25, 900) for c in O.PASCAL[8:16]] + [timing(c, "185", "28", 30, 1200) for c in O.PASCAL[16:]]
    return ", ".join(cols)


def _chunk_sql():
    return ("with " + ", ".join(_TASKS) + f""" select task_id, (row_no-1)//100 as chunk_no, case when ((row_no-1)//100+1)*100 >= sessions then 1 else 0 end as is_last_chunk, row_no,
      {chunk_columns("inject")} from (select *, task_id || '/' || row_no as k from trows)""")


@query("generate_task_chunks", _chunk_sql())
def generate_task_chunks(spark, sf):
    rows = G.chunk_rows(G.task_chunks(tasks(spark, sf), 100))
    return rounded(rows.withColumn("is_last_chunk", F.col("is_last_chunk").cast("int")))


@query("task_progress", "with " + ", ".join(_TASKS) + """ select task_id, chunk_no, processed, case when processed >= sessions then 90
  else least(89, cast(10 + floor(processed::double/sessions*80) as int)) end as progress
  from (select task_id, sessions, chunk_no, least((chunk_no+1)*100, sessions) as processed from (select distinct task_id, sessions, (row_no-1)//100 as chunk_no from trows))""")
def task_progress(spark, sf):
    return G.task_chunks(tasks(spark, sf), 100).select("task_id", "chunk_no", "processed", "progress")
