from __future__ import annotations

import re

from fingerloom.llm import urls
from fingerloom.llm.queries import HOST_RULES, RULES

URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/", "https://example.com/en/x?y=/es/", "https://www.example.com/en/",
    "https://w.www.EXAMPLE.com/en/z#q", "https://notexample.com/en/", "http://x.net/es/", "http://x.net/esp/", "http://x.net/fr", "http://x.net/fr/?a",
    "http://net/fr/", "ftp://x.net:80/es/", "http://a.com?/en/", "http://ünï.com/en/", "x://y://z.com/", "http://a.org/porn/", "http://porn-site.org/x", "http://sexton.org/",
    "http://casino.com/x", "http://example.com/EN/", "http://example.com/en/\n/x", "http://" + "a." * 20_000 + "com/",
]


def expected(url):
    host, path = urls.split_url(url)
    fits = [(h + p, v) for h, p, v in HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda f: len(f[0]))
    blocked = any(re.search(rf"(?<![A-Za-z0-9]){r.literal}(?![A-Za-z0-9])", host + path) for r in RULES if not r.listed)
    return host, path, None, "block" if blocked else "allow"


def test_rules(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate([*URLS, *URLS])] + [(None, URLS[7], "clash", "clash")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict string")
    got = urls.filter_urls(df, RULES).collect()
    key = lambda x: str(x)
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got], key=key) == sorted([(r[0], *expected(r[1])) for r in rows], key=key)
    assert urls.filter_urls(df.limit(0), RULES).collect() == []


def test_split():
    assert urls.split_url("HTTP://Ab.C/D?e") == ("ab.c", "/D")
    assert urls.split_url("x://a#b/c") == ("a", "")


def test_rarest_token_keeps_candidates_few(spark, sf):
    got = urls.filter_urls(spark.read.parquet(f"{sf}/pages.parquet"), RULES).collect()
    assert got and max(r.n_candidates for r in got) <= 4


def test_rules_without_tokens_always_run(spark):
    rule = urls.Rule("any", "block", r"\.\.", "", False)
    df = spark.createDataFrame([(1, "http://a..b/"), (2, "http://a.b/")], "page_id int, url string")
    assert sorted((r.page_id, r.verdict) for r in urls.filter_urls(df, [rule]).collect()) == [(1, "block"), (2, "allow")]
