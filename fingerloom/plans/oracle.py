"""SQL text of the derived typing tables, for checking queries against a second engine."""

from __future__ import annotations

from fingerloom.schema import FINGERS, pascal

SNAKE = [f"{m}_{f}" for m in ("error", "dwell", "flight") for f in FINGERS]
PASCAL = [f"{m}{pascal(f)}" for m in ("Error", "Dwell", "Flight") for f in FINGERS]
ERRORS, DWELLS, FLIGHTS = SNAKE[:8], SNAKE[8:16], SNAKE[16:]
TIMINGS = DWELLS + FLIGHTS
FEATURES = ["wpm", "accuracy", *SNAKE]


def h(tag: str, n: int, key: str = "event_id") -> str:
    return f"(cast('0x'||substr(md5(concat(cast({key} as varchar),':{tag}')),1,7) as bigint) % {n})"


def unit(key: str, tag: str) -> str:
    return f"(cast('0x'||substr(md5(concat(cast({key} as varchar),':{tag}')),1,13) as bigint) / 4503599627370496.0::double)"


def uniform(key: str, tag: str, low: str, high: str) -> str:
    return f"({low}::double + {unit(key, tag)} * ({high}::double - {low}::double))"


def normal(key: str, tag: str, mean: str, std: str) -> str:
    digest = f"md5(concat(cast({key} as varchar),':{tag}'))"
    u = f"((cast('0x'||substr({digest},1,13) as bigint) + 1) / 4503599627370497.0::double)"
    v = f"(cast('0x'||substr({digest},14,13) as bigint) / 4503599627370496.0::double)"
    return f"({mean}::double + {std}::double * sqrt(-2.0::double * ln({u})) * cos(2.0::double * pi() * {v}))"


def _metrics() -> str:
    out = []
    for i, f in enumerate(FINGERS):
        w = f"(case when weak={i} then 1 else 0 end)"
        out.append(f"round(({h('e' + f, 300)} + {w}*(500+{h('x' + f, 650)}))/10000.0::double,4) as Error{pascal(f)}")
        out.append(f"cast(case when event_id%20=0 then 5000 when event_id%97=0 then -5 else 72+{h('d' + f, 34)}+{w}*(28+{h('y' + f, 31)}) end as int) as Dwell{pascal(f)}")
        out.append(f"cast(case when event_id%20=0 then 5000 else 165+{h('f' + f, 96)}+{w}*(65+{h('z' + f, 56)}) end as int) as Flight{pascal(f)}")
    return ",\n".join(out)


_NAME = "(case weak " + " ".join(f"when {i} then '{f}'" for i, f in enumerate(FINGERS)) + " end)"

BASE = f"base as (select *, {h('w', 8)} as weak, {h('n', 100)} as r from events)"
FEATURE = f"""feature as (select event_id as Id, event_id as TypingSessionId, ts as CreatedAt,
  case when r<50 then null when r<95 then 0 else 1 end as IsOutlier,
  case when r%3=0 then 1 else 0 end as IsUsedForTraining,
  {_metrics()} from base)"""
TYPING = f"""typing as (select event_id as Id, user_id as UserId, ts as CreatedAt, event_type as Cohort, 28+{h('wpm', 51)} as Wpm,
  case when r<15 then cast(86+{h('a', 13)} as double) else round((86.0::double+{h('a', 13)})/100.0::double,4) end as Accuracy,
  case when r<20 then null when r<25 then '' when r<30 then 'thumb' when r<40 then upper(concat(' ',{_NAME},' ')) else {_NAME} end as WeakestFinger
  from base)"""

# Largest error as a correlated top-1 over (name, value) rows.
TOP1 = ("(select v.n from (values " + ", ".join(f"('{f}', feature.Error{pascal(f)})" for f in FINGERS)
        + ") as v(n, e) order by v.e desc nulls last, v.n limit 1)")
ALLOWED = ", ".join(f"'{f}'" for f in FINGERS)
VALID = (f"case when lower(trim(typing.WeakestFinger)) in ({ALLOWED}) then lower(trim(typing.WeakestFinger)) "
         "else inferred end")
INFERRED = "case " + " ".join(
    f"when Error{pascal(f)} = greatest({', '.join('Error' + pascal(g) for g in FINGERS)}) then '{f}'" for f in sorted(FINGERS)) + " end"
RENAMED = ", ".join(f"cast({p} as double) as {s}" for p, s in zip(PASCAL, SNAKE))
SESSIONS = f"""sessions as (select cast(UserId as varchar) as user_id, cast(TypingSessionId as varchar) as session_id,
  typing.CreatedAt as "timestamp", Cohort as cohort, WeakestFinger as stated_finger, cast(Wpm as double) as wpm,
  case when Accuracy>1 then Accuracy/100.0::double else Accuracy end as accuracy, {RENAMED},
  {VALID} as weakest_finger
  from (select *, {INFERRED} as inferred from feature) feature join typing on typing.Id = feature.TypingSessionId)"""


def tables(body: str, *more: str) -> str:
    """``body`` after the CTEs of the feature and session tables and of ``more``."""
    return "with " + ",\n".join([BASE, FEATURE, TYPING, *more]) + "\n" + body


def sessions(body: str, *more: str) -> str:
    return tables(body, SESSIONS, *more)


def r6(*columns: str) -> str:
    return ", ".join(f"round({c},6) as {c}" for c in columns)


def negative(columns=TIMINGS) -> str:
    return "(" + " or ".join(f"coalesce({c} < 0, false)" for c in columns) + ")"


def capped() -> str:
    tests = [f"coalesce({c} > 2000, false)" for c in DWELLS] + [f"coalesce({c} > 3000, false)" for c in FLIGHTS]
    return "(" + " or ".join(tests) + ")"


# Cleaning: rows left after negatives and caps, their quartiles, rows left after the upper bounds.
KEPT = f"kept as (select * from sessions where not {negative()} and not {capped()})"
QUARTILES = "quartiles as (select " + ", ".join(
    f"quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}" for c in TIMINGS) + " from kept)"
OVER = "(" + " or ".join(f"coalesce({c} > q3_{c} + 1.5::double*(q3_{c}-q1_{c}), false)" for c in TIMINGS) + ")"
CLEANED = f"cleaned as (select kept.* from kept, quartiles where not {OVER})"
CLEANING = (KEPT, QUARTILES, CLEANED)


def argmax(columns, names) -> str:
    """First name in the given order with the largest value."""
    return "case " + " ".join(f"when {c} = greatest({', '.join(columns)}) then '{n}'" for c, n in zip(columns, names)) + " end"
