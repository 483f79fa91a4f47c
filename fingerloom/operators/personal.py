"""Linear models for all users in one job.

Every user's rows stand in blocks of about ``BLOCK_ROWS`` rows, and one Newton iteration serves all: it is given the loss, gradient and
curvature of a trial, summed over the user's blocks. A user with a single block has that sum at hand, so the iteration runs to its end
where the block stands. The blocks of larger users are summed by user in one job for each trial, all those users together. So
size decides where sums are added up, and neither the rules, nor the solver, nor the model.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerloom.functions import scalars as S
from fingerloom.operators.cleaning import default_caps, not_negative, under_cap
from fingerloom.schema import FEATURES, FINGERS, IQR_MULTIPLIER, MIN_PERSONAL_ROWS, RANGE_RULES, TARGET, TIMING_COLUMNS
from fingerloom.session import discard, materialized
from fingerloom.sources import registry as R

MODEL_SCHEMA = T.StructType([
    T.StructField("model_key", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("training_rows", T.LongType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("coefficients", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("intercepts", T.ArrayType(T.DoubleType())),
    T.StructField("scales", T.ArrayType(T.DoubleType())),
])
#: Rows of a block; 27 doubles each make about a megabyte.
BLOCK_ROWS = 5000
MAX_STEPS = 100


class Newton:
    """Damped Newton steps on the summed log loss plus 1/2 |w|^2, given sums at each trial.

    Weights have a row per class, bias last; two classes have one free row, as the binomial model has.
    """

    def __init__(self, k: int, d: int):
        self.k, self.d, self.free = k, d, [1] if k == 2 else list(range(k))
        self.w = self.trial = np.zeros((len(self.free), d + 1))
        self.value = self.step = None
        self.rate, self.left, self.done = 1.0, MAX_STEPS, False

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and curvature of the trial over standardised rows; sums of blocks add up."""
        m, d = len(self.free), self.d
        loss, gradient, out = 0.0, np.zeros((m, d + 1)), np.zeros((m, d + 1, m, d + 1))
        for start in range(0, len(x), 10_000):
            rows = np.hstack([x[start:start + 10_000], np.ones((len(x[start:start + 10_000]), 1))])
            own = y[start:start + 10_000]
            z = np.zeros((len(rows), self.k))
            z[:, self.free] = rows @ self.trial.T
            z -= z.max(axis=1, keepdims=True)
            log_total = np.log(np.exp(z).sum(axis=1))
            loss += float((log_total - z[np.arange(len(rows)), own]).sum())
            p = np.exp(z - log_total[:, None])[:, self.free]
            gradient += (p - np.eye(self.k)[own][:, self.free]).T @ rows
            # One block per class, less the outer products of p and x.
            for a in range(m):
                out[a, :, a, :] += (rows * p[:, a, None]).T @ rows
            joint = (p[:, :, None] * rows[:, None, :]).reshape(len(rows), -1)
            out -= (joint.T @ joint).reshape(out.shape)
        return loss, gradient, out.reshape(m * (d + 1), -1)

    def advance(self, loss: float, gradient: np.ndarray, curvature: np.ndarray, n: int, tol: float = 1e-9) -> None:
        """Take the sums of the trial: go there, or halve the step; ``trial`` is what to look at next unless ``done``."""
        value = loss + 0.5 * (self.trial[:, :self.d] ** 2).sum()
        if self.value is not None and value > self.value:
            self.rate /= 2
            self.done = self.rate < 1e-8
            self.trial = self.w - self.rate * self.step
            return
        gain = np.inf if self.value is None else self.value - value
        self.w, self.value = self.trial, value
        ridge = np.tile(np.append(np.ones(self.d), 0.0), len(self.free))
        whole = gradient.ravel() + ridge * self.w.ravel()
        if np.abs(whole).max() <= tol * n or gain < 1e-13 * max(1.0, abs(value)) or not self.left:
            self.done = True
            return
        # The small constant fixes the shift of the biases, which the loss does not determine.
        self.step = np.linalg.solve(curvature + np.diag(ridge + 1e-8), whole).reshape(self.w.shape)
        self.rate, self.left, self.trial = 1.0, self.left - 1, self.w - self.step

    def weights(self) -> np.ndarray:
        full = np.zeros((self.k, self.d + 1))
        full[self.free] = self.w
        return full


def softmax_fit(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Weights (k, d + 1), bias last, of rows that are all at hand."""
    newton = Newton(k, x.shape[1])
    while not newton.done:
        newton.advance(*newton.sums(x, y), len(x))
    return newton.weights()


class Summary:
    """What the rules and the scaling need of a user's rows: counts, means, squared deviations, ranges, labels. Summaries add up."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, features: Sequence[str]):
        self.n, self.mean = len(x), x.mean(axis=0)
        self.squares = ((x - self.mean) ** 2).sum(axis=0)
        rules = [RANGE_RULES.get(c, (None, None)) for c in features]
        low, high = (np.array([end if r[side] is None else r[side] for r in rules], float) for side, end in ((0, -np.inf), (1, np.inf)))
        self.valid = bool(np.isfinite(x).all() and (x >= low).all() and (x <= high).all())
        names, counts = np.unique(labels, return_counts=True)
        self.labels = dict(zip(names.tolist(), counts.tolist()))

    def add(self, other: "Summary") -> None:
        n = self.n + other.n
        apart = other.mean - self.mean
        self.squares = self.squares + other.squares + apart**2 * (self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n, self.valid = n, self.valid and other.valid
        for name, count in other.labels.items():
            self.labels[name] = self.labels.get(name, 0) + count

    def status(self, min_class_rows: int) -> str | None:
        """Why there can be no model; None if there can."""
        if not self.valid:
            return "invalid_features"
        if not set(self.labels) <= set(FINGERS):
            return "unsupported_label"
        if len(self.labels) < 2:
            return "single_class"
        return "thin_class" if min(self.labels.values()) < min_class_rows else None

    @property
    def scale(self) -> np.ndarray:
        """Population deviations; 1 for a feature that is constant but for rounding."""
        variance, eps = self.squares / self.n, np.finfo(float).eps
        constant = variance <= self.n * eps * variance + (self.n * self.mean * eps) ** 2
        return np.where(constant, 1.0, np.sqrt(variance))

    def row(self, key: str, status: str, newton: Newton | None = None) -> dict:
        """The user's row of the model table; weights are moved to raw features."""
        out = {"model_key": key, "status": status, "training_rows": self.n, "classes": None, "coefficients": None, "intercepts": None, "scales": None}
        if newton is not None:
            w = newton.weights()
            raw = w[:, :-1] / self.scale
            out |= {"classes": sorted(self.labels), "coefficients": raw.tolist(), "intercepts": (w[:, -1] - raw @ self.mean).tolist(), "scales": self.scale.tolist()}
        return out


_NAMES = [f.name for f in MODEL_SCHEMA]
#: A block: a finished row of the model table, or a part of a larger user: its summary, and its rows.
_BLOCK_SCHEMA = T.StructType([*MODEL_SCHEMA, T.StructField("summary", T.BinaryType()), T.StructField("x", T.BinaryType()), T.StructField("labels", T.ArrayType(T.StringType()))])
_STATE_SCHEMA = T.StructType([*MODEL_SCHEMA, T.StructField("state", T.BinaryType())])


def _block(pdf: pd.DataFrame, label: str, features: Sequence[str], min_class_rows: int) -> pd.DataFrame:
    """One block of cleaned rows. A user's only block gives the model, or the reason for none."""
    key, blocks = pdf["model_key"].iloc[0], int(pdf["blocks"].iloc[0])
    x, labels = pdf[list(features)].to_numpy(dtype=float), pdf[label].to_numpy(dtype=str)
    whole = Summary(x, labels, features)
    if blocks > 1:
        row = dict.fromkeys(_NAMES) | {"model_key": key, "summary": pickle.dumps(whole), "x": x.tobytes(), "labels": labels.tolist()}
    elif (status := whole.status(min_class_rows)) is not None:
        row = whole.row(key, status)
    else:
        y = np.searchsorted(sorted(whole.labels), labels)
        newton = Newton(len(whole.labels), x.shape[1])
        while not newton.done:
            newton.advance(*newton.sums((x - whole.mean) / whole.scale, y), whole.n)
        row = whole.row(key, "trained", newton)
    return pd.DataFrame([{"summary": None, "x": None, "labels": None} | row])[_BLOCK_SCHEMA.names]


def _started(pdf: pd.DataFrame, min_class_rows: int) -> pd.DataFrame:
    """The blocks' summaries of one larger user: the start of its iteration, or the reason for no model."""
    whole, *rest = map(pickle.loads, pdf.sort_values("block")["summary"])
    for part in rest:
        whole.add(part)
    key, status = pdf["model_key"].iloc[0], whole.status(min_class_rows)
    if status is not None:
        return pd.DataFrame([whole.row(key, status) | {"state": None}])[_STATE_SCHEMA.names]
    state = pickle.dumps((whole, Newton(len(whole.labels), len(whole.mean))))
    return pd.DataFrame([dict.fromkeys(_NAMES) | {"model_key": key, "state": state}])[_STATE_SCHEMA.names]


def _block_sums(batches):
    """Sums of the trial over each block that meets its user's state."""
    for pdf in batches:
        out = []
        for key, block, x, labels, state in zip(pdf["model_key"], pdf["block"], pdf["x"], pdf["labels"], pdf["state"]):
            whole, newton = pickle.loads(state)
            rows = (np.frombuffer(x, float).reshape(-1, newton.d) - whole.mean) / whole.scale
            y = np.searchsorted(sorted(whole.labels), np.array(list(labels), dtype=str))
            out.append((key, block, pickle.dumps(newton.sums(rows, y))))
        yield pd.DataFrame(out, columns=["model_key", "block", "sums"])


def _advanced(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One user's state and its blocks' sums, added in the order of the blocks: the next state, or the model."""
    whole, newton = pickle.loads(left["state"].iloc[0])
    total = None
    for sums in right.sort_values("block")["sums"]:
        part = pickle.loads(sums)
        total = part if total is None else tuple(a + b for a, b in zip(total, part))
    newton.advance(*total, whole.n)
    if newton.done:
        return pd.DataFrame([whole.row(key[0], "trained", newton) | {"state": None}])[_STATE_SCHEMA.names]
    return pd.DataFrame([dict.fromkeys(_NAMES) | {"model_key": key[0], "state": pickle.dumps((whole, newton))}])[_STATE_SCHEMA.names]


def train_all_users(df: DataFrame, *, user: str = "user_id", label: str = TARGET, features: Sequence[str] = FEATURES,
                    min_rows: int = MIN_PERSONAL_ROWS, min_class_rows: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per user, by the user's key: a linear model, or the reason for none.

    Rows are deduplicated and cleaned with the user's own IQR bounds; the range rules of a tournament hold here as well, and rows that break
    one make the user's features invalid.
    """
    # Copies are equal in all columns; two sessions with equal features are two sessions.
    rows = df.withColumn("_user", S.user_key(F.col(user))).where(F.col("_user") != "")
    unique_row = F.xxhash64(*[c for c in rows.columns if c != "_user"]).alias("_row")
    keyed = materialized(rows.select(F.col("_user").alias("model_key"), S.normalize_label(F.col(label)).alias(label),
                                     *[S.to_number(F.col(c)).alias(c) for c in features], unique_row), "users")
    counts = materialized(keyed.groupBy("model_key").agg(F.count(F.lit(1)).alias("n_rows")), "user-counts")
    ready = counts.where(F.col("n_rows") >= min_rows).select("model_key", F.ceil(F.col("n_rows") / block_rows).cast("int").alias("blocks"))
    cleaned = _clean_per_user(keyed.join(ready, "model_key").dropDuplicates())
    dealt = cleaned.withColumn("block", F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("int"))
    fitted = materialized(dealt.groupBy("model_key", "block").applyInPandas(
        lambda key, pdf: _block(pdf, label, features, min_class_rows).assign(block=key[1]), T.StructType([*_BLOCK_SCHEMA, T.StructField("block", T.IntegerType())])), "user-blocks")
    discard(keyed)
    found = fitted.where("status is not null").select(*_NAMES).union(_larger(fitted.where("status is null"), min_class_rows))
    status = (F.when(F.col("n_rows") < min_rows, "insufficient_data")
              .otherwise(F.coalesce("status", F.lit("no_rows_after_cleaning"))))
    rest = [n for n in _NAMES if n not in ("model_key", "status")]
    return counts.join(found, "model_key", "left").select(F.lit(R.PERSONAL).alias("scope"), "model_key", "n_rows", status.alias("status"), *rest)


def _larger(blocks: DataFrame, min_class_rows: int) -> DataFrame:
    """The model rows of users with several blocks: a job for each trial, until the last of them is done."""
    state = materialized(blocks.select("model_key", "block", "summary").groupBy("model_key").applyInPandas(lambda pdf: _started(pdf, min_class_rows), _STATE_SCHEMA), "user-states")
    done = state.where("state is null").select(*_NAMES)
    data = blocks.select("model_key", "block", "x", "labels")
    while not state.where("state is not null").isEmpty():
        open_ = state.where("state is not null").select("model_key", "state")
        sums = data.join(open_, "model_key").mapInPandas(_block_sums, "model_key string, block int, sums binary")
        state = materialized(open_.groupBy("model_key").cogroup(sums.groupBy("model_key")).applyInPandas(_advanced, _STATE_SCHEMA), "user-states")
        done = done.union(state.where("state is null").select(*_NAMES))
    return done


def _clean_per_user(rows: DataFrame) -> DataFrame:
    """Negatives, caps, then every user's own upper bounds. Quartiles combine before the shuffle; their memory grows with a user's
    distinct timings, which the caps bound for whole milliseconds."""
    columns = [c for c in TIMING_COLUMNS if c in rows.columns]
    capped = rows.where(not_negative(columns) & under_cap(default_caps(rows)))
    quartiles = [F.expr(f"percentile(nanvl(`{c}`, NULL), array(0.25D, 0.75D)) AS `_q_{c}`") for c in columns]
    bounds = capped.groupBy("model_key").agg(*quartiles)
    upper = "`_q_{0}`[1] + {1}D * (`_q_{0}`[1] - `_q_{0}`[0])"
    kept = " AND ".join(
        f"(`{c}` <= {upper.format(c, IQR_MULTIPLIER)} OR `{c}` IS NULL OR isnan(`{c}`))" for c in columns)
    return capped.join(bounds, "model_key").where(kept).drop(*[f"_q_{c}" for c in columns])
