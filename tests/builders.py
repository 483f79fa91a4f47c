"""Small training frames: two classes of six rows each, one user."""

from __future__ import annotations

from fingerloom.schema import FEATURES, FINGERS, TARGET

COLUMNS = ["user_id", *FEATURES, TARGET]
SCHEMA = "user_id string, " + ", ".join(f"{c} double" for c in FEATURES) + f", {TARGET} string"


def base_row(s: int) -> dict:
    row = {"user_id": "user-a", "wpm": 45.0 + s, "accuracy": 0.90 + 0.002 * s}
    for i, f in enumerate(FINGERS):
        row[f"error_{f}"] = 0.01 + 0.001 * i + 0.0005 * s
        row[f"dwell_{f}"] = 90.0 + i + 2 * s
        row[f"flight_{f}"] = 180.0 + i + 3 * s
    return row


def training_rows(user: str = "user-a") -> list[dict]:
    rows = []
    for s in range(12):
        row = base_row(s) | {"user_id": user}
        if s < 6:
            row |= {TARGET: "left_pinky", "error_left_pinky": 0.25 + 0.01 * s, "error_right_index": 0.02}
        else:
            row |= {TARGET: "right_index", "error_left_pinky": 0.02, "error_right_index": 0.25 + 0.01 * (s - 6)}
        rows.append(row)
    return rows


def frame(spark, rows: list[dict]):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)
