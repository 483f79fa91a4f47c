"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with the literal tokens that any matching URL must hold. A rule stands in the index
under the one of its tokens that fewest URLs hold (counted over the whole table), so the tokens of a URL fetch the few
rules that can match it, and only those run their expression.

Defined results: a NULL URL, or one without ``://``, has an empty host and path and only the rules without a token can
fit it; repeated rows are judged each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
TOKEN = "[A-Za-z0-9]+"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    """One rule over ``host + path``; ``literal`` is the text whose whole tokens every match holds."""

    name: str
    verdict: str
    pattern: str
    literal: str
    listed: bool  # a listed rule goes before any pattern rule


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains, and the paths that start with ``path``."""
    whole = path if path.endswith("/") else re.sub(r"[A-Za-z0-9]+$", "", path)
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", host + whole, True)


def word_rule(word: str, verdict: str = BLOCK) -> Rule:
    """A pattern rule for a whole token anywhere in host or path."""
    return Rule(f"*{word}*", verdict, rf"(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", word, False)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host):])[0]


def token_counts(urls: DataFrame, column: str, tokens: Iterable[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens stands; one row for each token reaches the driver."""
    tokens = sorted(set(tokens))
    if not tokens:
        return {}
    lowered = F.lower(F.col(f"`{column}`"))
    found = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TOKEN})"), F.lit(1)))).alias("t"))
    wanted = urls.sparkSession.createDataFrame([(t.lower(),) for t in tokens], "t string").distinct()
    counted = found.groupBy("t").agg(F.count(F.lit(1)).alias("n"))  # before the join, so a token of most URLs is one row for each task
    return {r.t: r.n for r in counted.join(wanted, "t").collect()}


def build_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token, and the rules that have none."""
    index, always = defaultdict(list), []
    for rule in rules:
        tokens = re.findall(TOKEN, rule.literal)
        if tokens:
            index[min(tokens, key=lambda t: (counts.get(t.lower(), 0), -len(t), t))].append(rule)
        else:
            always.append(rule)
    return dict(index), always


def judge(host: str, path: str, index: dict[str, list[Rule]], always: list[Rule], compiled: dict) -> tuple[Rule | None, int]:
    """The rule that decides, and how many expressions ran: listed before pattern rules, then the longest name."""
    text = host + path
    candidates = {r for t in set(re.findall(TOKEN, text)) for r in index.get(t, ())} | set(always)
    fitting = []
    for rule in candidates:
        if rule.pattern not in compiled:
            compiled[rule.pattern] = re.compile(rule.pattern, re.S)
        if compiled[rule.pattern].search(text):
            fitting.append(rule)
    best = min(fitting, key=lambda r: (not r.listed, -len(r.name), r.name), default=None)
    return best, len(candidates)


def filter_urls(pages: DataFrame, rules: list[Rule], *, url: str = "url", id_column: str = "page_id",
                default: str = ALLOW) -> DataFrame:
    """Judge every URL: id, host, path, listed rule (or NULL), verdict, pattern rule (or NULL), expressions run."""
    df = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    counts = token_counts(df, "url", [t for r in rules for t in re.findall(TOKEN, r.literal)])
    index, always = build_index(rules, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, re.Pattern] = {}
        for batch in batches:
            out = []
            for value in batch.column("url").to_pylist():
                host, path = split_url(value)
                best, tried = judge(host, path, index, always, compiled)
                out.append((host, path, best.name if best and best.listed else None, best.verdict if best else default,
                            best.name if best and not best.listed else None, tried))
            host, path, rule, verdict, pattern, tried = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()),
                pa.array(verdict, pa.string()), pa.array(pattern, pa.string()), pa.array(tried, pa.int64()),
            ], names=["page_id", "host", "path", "rule", "verdict", "pattern", "n_candidates"])

    kind = dict(df.dtypes)["page_id"]
    return df.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string, n_candidates bigint")
