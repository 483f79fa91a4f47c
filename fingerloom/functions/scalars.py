"""Row-level expressions over telemetry columns (all JVM-side)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fingerloom.schema import FINGERS

# Text forms of a binary state label.
BINARY_STATES = {
    "0": 0, "0.0": 0, "normal": 0, "false": 0,
    "1": 1, "1.0": 1, "fatigued": 1, "fatigue": 1, "true": 1,
}
# Target folder of each data type.
LINEAGE_FOLDERS = {"real": "production", "synthetic": "experiments"}


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def to_number(x: Column) -> Column:
    """Double, with anything that is not a number as NULL (NaN included)."""
    return F.nullif(x.try_cast("double"), F.lit(float("nan")))  # reads a text once; a test beside the value reads it twice


def number(x: float) -> str:
    """SQL text of a double."""
    return f"{float(x)!r}D" if math.isfinite(x) else f"double('{float(x)}')"


def number_sql(column: str) -> str:
    """SQL text of :func:`to_number` over a column."""
    return f"nullif(try_cast(`{column}` AS double), double('nan'))"


def strip(x: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def accuracy_to_unit(accuracy: Column) -> Column:
    return F.when(accuracy > 1, accuracy / 100.0).otherwise(accuracy)


def accuracy_to_unit_bounded(accuracy: Column) -> Column:
    """Percent to unit for (1, 100]; larger values stay and fail the range rules later."""
    return F.when((accuracy > 1) & (accuracy <= 100), accuracy / 100.0).otherwise(accuracy)


def accuracy_to_percent(accuracy: Column) -> Column:
    return F.when(accuracy <= 1, accuracy * 100.0).otherwise(accuracy)


def argmax_name(columns: Mapping[str, Column | str]) -> Column:
    """Name of the largest value; the first name in mapping order wins a tie. NULL if all are NULL.

    Values may be given as column names, which keeps the expression one piece of SQL text.
    """
    if all(isinstance(c, str) for c in columns.values()):
        top = "greatest(" + ", ".join(f"`{c}`" for c in columns.values()) + ")"
        return F.expr("CASE " + " ".join(f"WHEN `{c}` = {top} THEN '{name}'" for name, c in columns.items()) + " END")
    top = F.greatest(*columns.values())
    return F.coalesce(*[F.when(value == top, F.lit(name)) for name, value in columns.items()])


def weakest_by_max_error(errors: Mapping[str, Column | str]) -> Column:
    """Finger with the largest error; ties and an all-NULL row go to the alphabetically first name."""
    ordered = dict(sorted(errors.items()))
    return F.coalesce(argmax_name(ordered), F.lit(next(iter(ordered))))


def weakest_by_column_order(errors: Mapping[str, Column | str]) -> Column:
    """Finger with the largest error; a tie goes to the first column of the table."""
    return argmax_name(errors)


def label_coalesce(stated: Column, inferred: Column) -> Column:
    """Stated label unless NULL; blanks and unknown labels survive."""
    return F.lower(F.trim(F.coalesce(stated, inferred)))


def label_valid_or_inferred(stated: Column, inferred: Column, allowed: Sequence[str] = FINGERS) -> Column:
    """Stated label if it is an allowed one after trimming and lower-casing, else the inferred one."""
    normal = F.lower(F.trim(stated))
    return F.when(normal.isin(*allowed), normal).otherwise(inferred)


def mean_of(columns: Sequence[str]) -> Column:
    """Mean over wide columns; NULL if any part is NULL."""
    return F.expr("(" + " + ".join(f"double(`{c}`)" for c in columns) + f") / {number(len(columns))}")


def normalize_label(label: Column, *, lower: bool = False) -> Column:
    text = strip(label.cast("string"))
    return F.lower(text) if lower else text


def user_key(user: Column) -> Column:
    """Equality key of a user id. Case folding beyond ``lower`` is not applied; NULL matches nobody."""
    return F.lower(strip(user.cast("string")))


def model_key(user: Column) -> Column:
    """Path-safe form of a user id. Different ids may share one, so it names files and never identifies a user."""
    # The characters that stay in a model key, and below in a file name.
    safe = F.regexp_replace(user_key(user), r"[^a-z0-9_-]+", "_")
    safe = F.regexp_replace(safe, r"^_+|_+$", "")
    return F.when(safe == "", F.lit("anonymous")).otherwise(safe)


def path_key(user: Column) -> Column:
    """Path-safe key that no two user ids share: the safe form, and a digest of the id."""
    return F.concat(model_key(user), F.lit("-"), F.substring(F.sha2(user_key(user), 256), 1, 16))


def filename_segment(value: Column) -> Column:
    """File-name-safe form of an e-mail address or user name."""
    safe = F.regexp_replace(F.replace(strip(value), F.lit(" "), F.lit("_")), r"[^A-Za-z0-9@._-]+", "_")
    return F.when((safe == "") | safe.isNull(), F.lit("unknown")).otherwise(safe)


def binary_state(label: Column) -> Column:
    """0 / 1 for the known state names, else NULL."""
    text = F.lower(strip(label.cast("string")))
    pairs = [F.lit(x) for item in BINARY_STATES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), text)


def lineage_folder(data_type: Column) -> Column:
    text = F.lower(strip(data_type))
    known = reduce(lambda c, kv: c.when(text == kv[0], kv[1]), list(LINEAGE_FOLDERS.items())[1:],
                   F.when(text == "real", LINEAGE_FOLDERS["real"]))
    return known.otherwise(F.raise_error(F.lit("Unknown data type; known are: real, synthetic")))


def clip_round(x: Column, low: float, high: float | None = None) -> Column:
    """Round half to even, then clip to [low, high]."""
    value = F.rint(x)
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return F.greatest(value, F.lit(float(low))).cast("int")


def encode_label(label: Column, classes: Sequence[str]) -> Column:
    """Index of the label in ``classes`` (sorted labels); NULL if unknown."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    return F.when(position > 0, (position - 1).cast("int"))


def decode_label(index: Column, classes: Sequence[str], *, strict: bool = False) -> Column:
    """Label of an index. Out of range: the index as text, or an error when ``strict``."""
    array = F.array(*[F.lit(c) for c in classes])
    known = (index >= 0) & (index < len(classes))
    other = (
        F.raise_error(F.concat(F.lit("Prediction index outside the saved classes: "), index.cast("string")))
        if strict else index.cast("string")
    )
    return F.when(known, F.get(array, index.cast("int"))).otherwise(other)


def prediction_struct(probabilities: Column, classes: Sequence[str] | Column) -> Column:
    """``struct(prediction, confidence 0-100, probabilities map)``; the first class wins a tie."""
    names = classes if isinstance(classes, Column) else F.array(*[F.lit(c) for c in classes])
    top = F.array_max(probabilities)
    return F.struct(
        F.get(names, (F.array_position(probabilities, top) - 1).cast("int")).alias("prediction"),
        (top * 100.0).alias("confidence"),
        F.map_from_arrays(names, probabilities).alias("probabilities"),
    )


def any_true(conditions: Sequence[Column]) -> Column:
    """OR of conditions with NULL counted as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))
