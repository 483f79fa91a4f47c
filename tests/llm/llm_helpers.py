"""Plain, slow versions of the operators' contracts, and small awkward tables."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, fp string, n_words string"


def docs(spark, texts, ids=None, **columns):
    """Documents with columns whose names clash with those of the operators."""
    ids = list(range(len(texts))) if ids is None else ids
    get = lambda c, i: columns[c][i] if c in columns else None
    rows = [(d, t, get("lang", i), get("source", i), None if t is None else len(t), "row", "fp", "n") for i, (d, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def words(rng: random.Random, n: int, alphabet: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(n))


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
