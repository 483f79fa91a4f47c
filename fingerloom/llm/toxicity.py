"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and over their first characters. While it is fitted, the identity terms of every
training text are swapped for others of their kind, and the squared change of the score is penalised: what remains can
tell insults, but not whom a text mentions.

The model is fitted on at most ``max_rows`` labelled texts, chosen by a hash of id and label; scoring covers all whole texts and
shuffles nothing. The ``features`` that part the classes best are counted over that sample by the tasks.

Defined results: NULL, empty and word-less texts get the score of the intercept alone; labels other than 0 and 1 teach
nothing; several labels of one id all count; without labels of both classes every score is the share of toxic labels, or 0;
a NULL id falls in the split of the empty text and matches no label; repeated rows are scored each for itself; an empty table gives no
rows; extra columns are ignored or carried through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.llm.common import bounded_sample, chunks, mixed, word_bounds, word_hash
from fingerloom.session import materialized

MAX_ROWS = 20_000
FEATURES = 4096
PREFIXES = (4, 5, 6)
MIN_TEXTS = 3
#: Features below this likelihood ratio are as likely by chance among so many words.
MIN_RATIO = 16.0
PENALTY = 1.0
RIDGE = 0.002
STEPS = 400
THRESHOLD = 0.7

#: Fixed lists: identity terms of one kind stand in one row; each is swapped for the next of its row.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("she", "he"), ("her", "his"), ("mother", "father"), ("wife", "husband"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"), ("transgender", "trans", "nonbinary"),
    ("black", "white", "asian", "latino", "latina", "arab", "african", "european"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("immigrant", "refugee", "foreigner", "migrant"), ("immigrants", "refugees", "foreigners", "migrants"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young", "elderly"), ("american", "mexican", "chinese", "russian", "german", "french", "spanish", "indian"),
    ("frauen", "männer"), ("frau", "mann"), ("ausländer", "flüchtlinge", "migranten"), ("muslime", "christen", "juden"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "réfugiés"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados"),
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A column of hashes for the whole word, and one for each prefix length; 0 where the word is no longer than that."""
    out = [word_hash(data, starts, ends)]
    for k in PREFIXES:
        hashes = mixed(word_hash(data, starts, np.minimum(starts + k, ends)) + np.uint64(k))
        out.append(np.where(ends - starts > k, hashes, np.uint64(0)))
    return np.stack(out, axis=1)


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return word_hash(data, np.concatenate([[0], ends[:-1]]), ends)


def _swaps() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the identity terms (sorted), and of the term that each is swapped for."""
    pairs = [(a, b) for row in IDENTITY for a, b in zip(row, row[1:] + row[:1])]
    own, other = _hashes([a for a, _ in pairs]), _hashes([b for _, b in pairs])
    order = np.argsort(own)
    return own[order], other[order]


def identity_features() -> np.ndarray:
    """The features of the identity terms, and so of what they are swapped for."""
    return np.unique(_hashes([term for row in IDENTITY for term in row]))


def text_features(data: np.ndarray, offsets: np.ndarray, swapped: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every text's distinct features, sorted; of the counterfactual text if ``swapped``.

    An identity term is one feature. It has no first characters, which other words share and a swap would leave in part.
    """
    data = _LOWER[data]
    starts, ends = word_bounds(_WORD[data], offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = _word_features(data, starts, ends)
    terms, others = _swaps()
    at = np.minimum(np.searchsorted(terms, found[:, 0]), len(terms) - 1)
    hit = terms[at] == found[:, 0]
    found[hit, 1:] = 0
    if swapped:
        found[hit, 0] = others[at[hit]]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    text, found = np.repeat(text, found.shape[1]), found.ravel()
    some = found != 0
    text, found = text[some], found[some]
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (found[1:] != found[:-1])])
    return text[new], found[new]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for row, _, data, offsets in chunks(batch.column("text")):
            text, found = text_features(data, offsets)
            keys, inverse = np.unique(found, return_inverse=True)
            bad = np.bincount(inverse, toxic[row + text], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64), pa.int64()), pa.array(np.bincount(inverse, minlength=len(keys)).astype(np.int64)), pa.array(bad)], names=["feature", "n", "bad"])


def _known(found: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``found`` the model has, and their numbers."""
    if not len(features) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(features, found), len(features) - 1)
    hit = np.flatnonzero(features[at] == found)
    return hit, at[hit]


def _vectors(shared):
    """The model's features of each sampled text, and of its counterfactual, as number lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = shared.value
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                lists = []
                for swapped in (False, True):
                    text, found = text_features(data, offsets, swapped)
                    hit, number = _known(found, features)
                    limits = np.searchsorted(text[hit], np.arange(end - row + 1))
                    lists.append(pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(number, pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(row, end - row).cast(pa.int32()), *lists], names=["toxic", "own", "other"])
    return run


class Model:
    """Sorted feature hashes, their weights, and the intercept."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float):
        self.features, self.weights, self.intercept = features, weights, intercept

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, found = text_features(data, offsets)
        hit, number = _known(found, self.features)
        sums = np.bincount(text[hit], self.weights[number], len(offsets) - 1).astype(float) if len(hit) else np.zeros(len(offsets) - 1)
        return 1.0 / (1.0 + np.exp(-np.clip(sums + self.intercept, -50, 50)))


def _rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, feature number) of every entry of a list column, and the number of rows."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int32()))
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), len(lists)


def fit_weights(own, other, toxic: np.ndarray, size: int, *, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic loss of balanced classes, plus the squared change of each score under the swap, by gradient descent."""
    (rows, columns, n), (rows2, columns2, _) = own, other
    weight = np.where(toxic == 1, 0.5 / max(toxic.mean(), 1e-9), 0.5 / max(1 - toxic.mean(), 1e-9)) / n
    w, b = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        margin = np.bincount(rows, w[columns], n) + b
        change = margin - b - np.bincount(rows2, w[columns2], n)
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - toxic)
        pull = 2 * penalty * change / n
        grad = np.bincount(columns, (error + pull)[rows], size) - np.bincount(columns2, pull[rows2], size) + ridge * w / np.sqrt(n)
        grad = np.append(grad, error.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(labelled: DataFrame, *, features: int = FEATURES, penalty: float = PENALTY, ridge: float = RIDGE) -> Model:
    """Fit to (text, toxic) rows, which the caller has bounded.

    The features are those that part the classes best, and always those of the identity terms: what a text says of whom it mentions must be
    in the model for the penalty to take it out.
    """
    spark = labelled.sparkSession
    labelled = labelled.select("text", "toxic")
    n, bad = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < n:
        share = bad / n if n else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), 50.0 if share == 1 else -50.0)
    counted = labelled.mapInArrow(_counted, "feature bigint, n bigint, bad bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Likelihood ratio of the feature's own share of toxic texts against that of all.
    share = bad / n
    good = F.col("n") - F.col("bad")

    def part(count: F.Column, of_all: float) -> F.Column:
        return F.when(count > 0, count * F.log(count / (F.col("n") * of_all))).otherwise(0.0)
    worth = 2 * (part(F.col("bad"), share) + part(good, 1 - share))
    more = F.col("bad") > share * F.col("n")  # what clean texts hold more often says what they are about, not how
    top = counted.where(more & (F.col("n") >= MIN_TEXTS) & (worth >= MIN_RATIO)).orderBy(F.desc(worth), "feature").limit(features).select("feature").collect()
    chosen = np.union1d(np.array([r.feature for r in top], np.int64).view(np.uint64), identity_features())
    rows = labelled.mapInArrow(_vectors(spark.sparkContext.broadcast(chosen)), "toxic int, own array<int>, other array<int>").toArrow()
    w, b = fit_weights(_rows(rows.column("own")), _rows(rows.column("other")), rows.column("toxic").to_numpy(), len(chosen), penalty=penalty, ridge=ridge)
    return Model(chosen, w, b)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, end - row), pa.array(shared.value.scores(data, offsets))], names=["row", "score"])
    return run


def sample(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled texts, each once for each label, stored in the shared folder.

    The chosen ids are what is broadcast, so its size is bounded; if ids repeat so often that they bring more texts, those are chosen by their hash.
    """
    marks = labels.where(F.col(f"`{label}`").isin(0, 1)).select(F.col(f"`{id_column}`").alias("mark_id"), F.col(f"`{label}`").cast("int").alias("toxic"))
    chosen = bounded_sample(marks.where("mark_id is not null").distinct(), max_rows, F.xxhash64("mark_id", "toxic"))
    df = docs.select(F.col(f"`{id_column}`").alias("own_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    joined = df.join(F.broadcast(chosen), F.col("own_id") == F.col("mark_id")).select("text", "toxic", F.xxhash64("text", "toxic").alias("h"))
    stored = materialized(joined.dropDuplicates(["h"]), "toxic-sample")
    if stored.count() > max_rows:
        stored = stored.join(F.broadcast(bounded_sample(stored.select("h"), max_rows, F.col("h"))), "h", "left_semi")
    return stored.select("text", "toxic")


def score(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (struct of the kept columns) and ``score`` of every whole text."""
    df = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return df.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), f"row {df.schema['row'].dataType.simpleString()}, score double")
