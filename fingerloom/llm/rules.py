"""Quality rules: an ordered list of threshold rules, learned by sequential covering from labelled text statistics.

Everything is DataFrame and SQL functions. Text statistics are row expressions, stored once as a narrow table. A rule grows
by the condition with the greatest information gain on the growing part of the labelled rows, is pruned on the other
part, and the rows it covers leave; each step is one grouped count over binned statistics, of which only the counts of
bins reach the driver. The list becomes one ordered conditional expression.

Defined results: NULL and blank texts have no words and fail the base; texts without a usable statistic (no words) are judged
by the base alone; a NULL label, or one other than 0 or 1, teaches nothing; several labels of one id all count; without labels of both
classes the list is empty and the base alone decides; repeated rows are judged each for itself; an empty table gives no rows;
extra columns are ignored or carried through unchanged.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerloom.session import materialized

BINS = 24
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9
MIN_COVER = 10
MIN_WORDS = 50

_SPACE = "[\\x20\\x09-\\x0D]+"
#: Fixed characters of the contract.
SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Statistics that rules may test.
FEATURES = {
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "mark_share": "n_marks / word_chars",
    "stop_share": "n_stops / n_words",
    "distinct_share": "n_distinct / n_words",
    "words": "double(n_words)",
}
#: Sentence marks.
_MARKS = ".,;:!?"


def _removed(characters: str) -> Column:
    return F.length("text") - F.length(F.translate("text", characters, ""))


def statistics(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (struct of the kept columns) and the counts of every whole text."""
    df = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("words", F.expr(f"filter(split(text, r'{_SPACE}'), w -> w <> '')"))
    df = df.withColumn("n_words", F.size("words").cast("bigint"))
    # Fingerprints of the 3-word windows; only texts in which one recurs look for the places.
    df = df.withColumn("windows", F.expr(
        "if(n_words < 3, array(), transform(sequence(0, int(n_words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))"))
    df = df.withColumn("sorted", F.expr(
        "if(size(array_distinct(windows)) = size(windows), array(), array_sort(transform(windows, (h, i) -> struct(h, i))))"))
    df = df.withColumn("places", F.expr(
        "if(size(sorted) = 0, array(), array_sort(array_distinct(flatten(zip_with(sorted, slice(sorted, 2, size(sorted)), "
        "(a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>)))))))"))
    lines = F.expr("filter(split(text, '\n'), l -> l rlike r'[^\\x20\\x09-\\x0D]')")
    return df.withColumn("lines", lines).select(
        "row", "n_words",
        F.length(F.regexp_replace("text", _SPACE, "")).cast("bigint").alias("word_chars"),
        _removed(SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr("bigint(aggregate(zip_with(places, slice(places, 2, size(places) + 1), (a, b) -> least(3, coalesce(b - a, 3))), 0, (n, k) -> n + k))").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        _removed(_UPPER).cast("bigint").alias("n_upper"), _removed("0123456789").cast("bigint").alias("n_digits"), _removed(_MARKS).cast("bigint").alias("n_marks"),
        F.expr("bigint(size(filter(words, w -> length(w) <= 3)))").alias("n_stops"), F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
    )


def base_failed(min_words: int = MIN_WORDS) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


class Condition(NamedTuple):
    feature: str
    above: bool  # whether the statistic is greater than the bound, or else at most the bound
    bound: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.bound!r}D"


class DecisionList(NamedTuple):
    """Rules in order; a text that one covers is rejected, all others are kept."""

    rules: list[list[Condition]]

    def sql(self) -> str:
        cases = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN false" for rule in self.rules)
        return f"CASE {cases} ELSE true END" if cases else "true"

    def kept(self) -> Column:
        """The list as one ordered conditional expression; a statistic that is NULL fits no condition."""
        return F.expr(self.sql())


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gain of covering p positives and n negatives instead of p0 and n0."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, *, label: str = "quality", reject: int = 0, bins: int = BINS, max_rules: int = MAX_RULES,
          max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> DecisionList:
    """Sequential covering of the rows whose label is ``reject``. ``labelled`` holds the statistics and the label."""
    names = list(FEATURES)
    rows = labelled.where(F.col(label).isin(0, 1)).selectExpr(
        f"{label} = {reject} AS positive", "pmod(xxhash64(*), 3) > 0 AS growing", *[f"{sql} AS {name}" for name, sql in FEATURES.items()])
    steps = [k / bins for k in range(1, bins)]
    # Bounds between quantiles of the whole and of the rejected rows, so that a rare fault has bounds of its own.
    found = rows.agg(*[F.percentile_approx(name, F.array(*map(F.lit, steps)), 2000).alias(f"a_{name}") for name in names], *[
        F.percentile_approx(F.when(F.col("positive"), F.col(name)), F.array(*map(F.lit, steps)), 2000).alias(f"p_{name}") for name in names]).first()
    bounds = {name: sorted({float(x) for x in [*(found[f"a_{name}"] or ()), *(found[f"p_{name}"] or ())]}) for name in names}
    # The bin of a value: how many bounds lie below it.
    binned = materialized(rows.select("positive", "growing", *[
        F.expr(f"if({name} is null, -1, size(filter(array({', '.join(f'{b!r}D' for b in bounds[name])}), b -> b < {name})))" if bounds[name] else "-1").cast("int").alias(name)
        for name in names]).groupBy("positive", "growing", *names).agg(F.count(F.lit(1)).alias("n")), "rules")

    def covered(conditions: list[Condition]) -> Column:
        out = F.lit(True)
        for c in conditions:
            at = bounds[c.feature].index(c.bound)  # a value in bin k is above bounds[k - 1] and at most bounds[k]
            out = out & (F.col(c.feature) > at if c.above else F.col(c.feature).between(0, at))
        return out

    def counts(df: DataFrame, prefixes: list[list[Condition]]) -> list[tuple[int, int]]:
        """(positives, negatives) that each list of conditions covers."""
        row = df.agg(*[F.coalesce(F.sum(F.when(covered(p) & (F.col("positive") == side), F.col("n"))), F.lit(0)) for p in prefixes for side in (True, False)]).first()
        return list(zip(row[::2], row[1::2]))

    left, rules = binned, []
    while len(rules) < max_rules:
        rule: list[Condition] = []
        grow = left.where("growing")
        (p0, n0), = counts(grow, [[]])
        if p0 < min_cover:
            break
        while n0 and len(rule) < max_conditions:
            table = grow.where(covered(rule)).select(F.explode(F.array(*[
                F.struct(F.lit(name).alias("name"), F.col(name).alias("bin")) for name in names])).alias("f"), "positive", "n")
            cells = table.groupBy("f.name", "f.bin").agg(
                F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("positive"), F.col("n")).otherwise(0)).alias("m")).collect()
            best = None
            for name in names:
                own = {r.bin: (r.p, r.m) for r in cells if r.name == name and r.bin >= 0}
                all_p, all_m = sum(p for p, _ in own.values()), sum(m for _, m in own.values())
                p = m = 0
                for at, bound in enumerate(bounds[name]):
                    p, m = p + own.get(at, (0, 0))[0], m + own.get(at, (0, 0))[1]
                    for above, q, k in ((False, p, m), (True, all_p - p, all_m - m)):
                        if q >= min_cover:
                            candidate = (_gain(q, k, p0, n0), -names.index(name), above, -bound, Condition(name, above, bound), q, k)
                            best = max(best or candidate, candidate, key=lambda c: c[:4])
            if best is None or best[0] <= 0:
                break
            rule.append(best[4])
            p0, n0 = best[5], best[6]
        if not rule:
            break
        # Prune: the prefix whose worth on the other part is greatest; the shortest of equals.
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        worth = [((p - n) / (p + n) if p + n else -1.0, -k) for k, (p, n) in enumerate(counts(left.where("not growing"), prefixes))]
        rule = prefixes[-max(worth)[1]]
        (p, n), = counts(left, [rule])
        if p < min_cover or p < min_precision * (p + n):
            break
        rules.append(rule)
        left = left.where(~covered(rule))
    return DecisionList(_halfway(rows, rules))


def _halfway(rows: DataFrame, rules: list[list[Condition]]) -> list[list[Condition]]:
    """The rules with each bound halfway to the next value that a labelled row has, so that a text just beyond a bound that no labelled text
    is near does not change sides."""
    cuts = list(dict.fromkeys((c.feature, c.bound) for rule in rules for c in rule))
    if not cuts:
        return rules
    above = rows.agg(*[F.min(F.when(F.col(name) > bound, F.col(name))).cast("double").alias(f"c{i}") for i, (name, bound) in enumerate(cuts)]).first()
    middle = {cut: (cut[1] + above[i]) / 2 if above[i] is not None else cut[1] for i, cut in enumerate(cuts)}
    return [[c._replace(bound=middle[c.feature, c.bound]) for c in rule] for rule in rules]


def quality(docs: DataFrame, labels: DataFrame, *, keep: list[str], id_column: str = "doc_id", text: str = "text",
            label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """``row``, the counts, ``base_failed`` and ``kept``. Statistics are stored once; the list learns from all labelled rows."""
    if id_column not in keep:
        keep = [*keep, id_column]
    stats = materialized(statistics(docs, keep=keep, text=text), "quality")
    marks = labels.select(F.col(f"`{label_id}`").alias("mark_id"), F.col(f"`{label}`").alias("mark"))
    counted = [c for c in stats.columns if c != "row"]
    labelled = stats.select(F.col("row").getField(id_column).alias("own_id"), *counted).join(marks, F.col("own_id") == F.col("mark_id")).where(~base_failed())
    found = learn(labelled.select(*counted, "mark"), label="mark")
    failed = base_failed()
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & found.kept())
