"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams in order of frequency. A text's own most frequent n-grams are
compared to each profile: every n-gram is out of place by the difference of its ranks, or by the full profile size if the
profile lacks it, and the language with the least sum is the answer.

Counts of n-grams cover all training texts whole: every task sums its own blocks first. The profiles, ``size`` rows for each
language, are all that reaches the driver and the tasks.

Defined results: NULL texts and texts without a letter are ``und`` with score 0, as are all without training rows; ties go to the
language that sorts first; a NULL id falls in the split of the empty text; repeated rows are judged each for itself; an
empty table gives no rows; extra columns are ignored or carried through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fingerloom.llm.common import chunks

SIZE = 400
MAX_N = 3
UNKNOWN = "und"
_FOLDS: list[np.ndarray] = []


def folds() -> np.ndarray:
    """Every code point's lower-case letter, or a space for what is no letter; built once for each Python worker."""
    if not _FOLDS:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLDS.append(table)
    return _FOLDS[0]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as lower-case letters with one space between words and around each text, and the offsets in that."""
    points = folds()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)].astype(np.int64)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.searchsorted(first, offsets)
    # A space before each text; then runs of spaces become one.
    points = np.insert(points, bounds[:-1], 32)
    bounds = bounds + np.arange(len(bounds))
    points = np.append(points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    keep[bounds[:-1]] = True
    keep[-1] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], at[bounds]


def grams(text: np.ndarray) -> np.ndarray:
    """All n-grams of a text that starts with a space, 21 bits a character; runs of letters end with a space."""
    out = [text[text != 32]]
    packed = text
    for n in range(2, MAX_N + 1):
        if len(text) < n:
            break
        packed = (packed[:-1] << 21) | text[n - 1:]
        out.append(packed)
    return np.concatenate(out)


def top(text: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; equals by code points."""
    keys, counts = np.unique(grams(text), return_counts=True)
    return keys[np.lexsort((keys, -counts))[:size]]


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for row, end, data, offsets in chunks(column):
        points, bounds = letters(data, offsets)
        for k in range(end - row):
            own = points[bounds[k]: bounds[k + 1]]
            yield row + k, own if len(own) and own[-1] == 32 else np.append(own, 32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, found = batch.column("lang").to_pylist(), {}
        for row, text in _texts(batch.column("text")):
            keys, counts = np.unique(grams(text), return_counts=True)
            own = found.setdefault(langs[row], [[], [], 0])
            own[0].append(keys)
            own[1].append(counts)
            own[2] += len(keys)
            if own[2] > 1 << 20:
                yield _summed(langs[row], *found.pop(langs[row])[:2])
        for lang, (keys, counts, _) in found.items():
            yield _summed(lang, keys, counts)


def _summed(lang: str, keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(inverse, np.concatenate(counts), len(keys)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def profiles(docs: DataFrame, *, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, gram, rank) of the ``size`` most frequent n-grams of each language, over all rows with a language."""
    df = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang is not null and text is not null")
    counted = df.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The bound stands on the row number itself, so that each task keeps its first rows only, before the shuffle and after.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    """All n-grams of the profiles (sorted) and their rank in each language; ``size`` where a profile lacks one."""

    def __init__(self, rows: list, size: int):
        self.size, self.langs = size, sorted({r.lang for r in rows})
        self.grams = np.unique(np.array([r.gram for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), size, np.int64)
        for r in rows:
            self.ranks[np.searchsorted(self.grams, r.gram), self.langs.index(r.lang)] = r.rank

    def judge(self, text: np.ndarray) -> tuple[str, float]:
        """The nearest language, and how far from the worst distance it is, 0 to 1."""
        if not self.langs or not (text != 32).any():
            return UNKNOWN, 0.0
        own = top(text, self.size)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[at]
        apart = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(own))


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.judge(text) for _, text in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             names=["row", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, training: DataFrame, *, keep: list[str], text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """``row`` (struct of the kept columns), ``lang_pred`` and ``score``; profiles come from ``training`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles(training, text=text, lang=lang, size=size).collect(), size))
    df = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return df.mapInArrow(_judged(shared), f"row {df.schema['row'].dataType.simpleString()}, lang_pred string, score double")
