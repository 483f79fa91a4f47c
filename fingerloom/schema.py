"""Column vocabulary and table schemas of typing-session telemetry."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Finger order, measures, allowed labels and range rules.
FINGERS = (
    "left_pinky", "left_ring", "left_middle", "left_index",
    "right_index", "right_middle", "right_ring", "right_pinky",
)
MEASURES = ("error", "dwell", "flight")
TARGET = "weakest_finger"
DWELL_CAP_MS = 2000.0
FLIGHT_CAP_MS = 3000.0
IQR_MULTIPLIER = 1.5
MIN_PERSONAL_ROWS = 20
CV_FOLDS = 5
CHUNK_ROWS = 5000
OUTLIER_TIME_MS = 5000


def pascal(name: str) -> str:
    """``left_pinky`` -> ``LeftPinky``."""
    return "".join(part.capitalize() for part in name.split("_"))


def finger_columns(measure: str, *, case: str = "snake") -> list[str]:
    """The eight wide column names of one measure, in finger order."""
    if case == "snake":
        return [f"{measure}_{finger}" for finger in FINGERS]
    return [f"{measure.capitalize()}{pascal(finger)}" for finger in FINGERS]


ERROR_COLUMNS = finger_columns("error")
DWELL_COLUMNS = finger_columns("dwell")
FLIGHT_COLUMNS = finger_columns("flight")
TIMING_COLUMNS = DWELL_COLUMNS + FLIGHT_COLUMNS
FEATURES = ["wpm", "accuracy", *ERROR_COLUMNS, *TIMING_COLUMNS]

# Inclusive (min, max) per feature; None = unbounded.
RANGE_RULES: dict[str, tuple[float, float | None]] = {
    "wpm": (0.0, None),
    "accuracy": (0.0, 1.0),
    **{c: (0.0, 1.0) for c in ERROR_COLUMNS},
    **{c: (0.0, None) for c in TIMING_COLUMNS},
}

PASCAL_TO_SNAKE = {
    **{p: s for m in MEASURES for p, s in zip(finger_columns(m, case="pascal"), finger_columns(m))},
}


def rename_fingers(df: DataFrame, *, to: str) -> DataFrame:
    """Rename the per-finger columns of ``df`` between Pascal and snake case."""
    mapping = PASCAL_TO_SNAKE if to == "snake" else {s: p for p, s in PASCAL_TO_SNAKE.items()}
    return df.withColumnsRenamed(mapping)


def _fields(names: Iterable[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


SESSION_SCHEMA = T.StructType(
    _fields(["user_id", "session_id", "timestamp"], T.StringType())
    + _fields(FEATURES, T.DoubleType())
    + _fields([TARGET], T.StringType())
)

WIRE_ROW_SCHEMA = T.StructType(
    _fields(["WPM"], T.IntegerType())
    + _fields(["Accuracy"], T.DoubleType())
    + _fields(finger_columns("error", case="pascal"), T.DoubleType())
    + _fields(finger_columns("dwell", case="pascal"), T.IntegerType())
    + _fields(finger_columns("flight", case="pascal"), T.IntegerType())
)

CHUNK_SCHEMA = T.StructType([
    T.StructField("taskId", T.StringType()),
    T.StructField("isLastChunk", T.BooleanType()),
    T.StructField("data", T.ArrayType(WIRE_ROW_SCHEMA)),
])

GENERATION_REQUEST_SCHEMA = T.StructType([
    T.StructField("taskId", T.StringType()),
    T.StructField("sessions", T.LongType()),
    T.StructField("injectOutliers", T.BooleanType()),
])
PREPROCESSING_REQUEST_SCHEMA = T.StructType([T.StructField("taskId", T.StringType())])
TRAINING_REQUEST_SCHEMA = T.StructType([
    T.StructField("taskId", T.StringType()),
    T.StructField("dataType", T.StringType()),
    T.StructField("userEmail", T.StringType()),
])
