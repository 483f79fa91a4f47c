from __future__ import annotations

import re
from html import unescape

import numpy as np
import pytest

from fingerloom.llm import pages

PARTS = """<html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, do you accept?</div>
<div id="content"><h1>A &amp; title</h1><p>First   <b>bold</b> paragraph with an <i>inner</i>
line.<br>After a break, this goes on for a good while so that it is long.<p>Second, not closed &eacute;&#233;.
<ul><li>A point in a list, with a full sentence.</ul><div class="ad">Buy this now!</div><p style="display:none">Hidden</p></div>
<aside><h3>Related</h3><a href=/x>Another story</a></aside><form><label>Name</label><input><button>Send</button></form>
<section id="comments"><h3>Comments</h3><p>I do not agree with this at all, said a reader.</p></section>
<footer>&copy; 2020 Site name</footer>"""
WANT = ["A & title", "First bold paragraph with an inner line. After a break, this goes on for a good while so that it is long.", "Second, not closed éé.", "A point in a list, with a full sentence."]


def expected(html):
    inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = [" ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(x for x in parts if x)


@pytest.fixture(scope="module")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").collect()


@pytest.fixture(scope="module")
def model(given):
    return pages.fit([p for i, r in enumerate(given) for p in pages.labelled_pages(r.html, i)])


def test_parts_of_a_page(model):
    assert model.text(PARTS).split("\n\n") == WANT
    assert pages.start_model().text(PARTS).split("\n\n") == WANT


def test_renderings_not_seen(model, given):
    test = [p for i, r in enumerate(given) for p in pages.labelled_pages(r.html, 10**6 + i)]
    assert sum(model.text(h) == t.replace("\n", "\n\n") for h, t in test) > 0.93 * len(test)


def test_odd_pages(model):
    for html in (None, "", "   ", "<", "<p", "<!-- open", "&#xZZ;", "</p></div>", "<b><i>", "<script>x", "<table><tr><td>"):
        assert isinstance(model.text(html), str)
    long = "<article>" + "<p>Some words of a paragraph, again and again.</p>" * 20_000 + "</article>"
    assert model.text(long).count("\n\n") == 19_999 and model.text(long).count("\n") == 2 * 19_999


def test_lines_stay_whole(model):
    page = """<article><p>Energy <math><mi>E</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> is <button>Copy</button>conserved <select><option>a</select>in
    <object data=x>every</object> <script>var a = 1;</script>closed <svg><text>no</text></svg>system, they say.<p>Another paragraph, with words in it.</article>"""
    for m in (model, pages.start_model()):
        assert m.text(page) == "Energy E=2 is conserved in every closed system, they say.\n\nAnother paragraph, with words in it."
    assert model.text("<html><head><title>t</title><body><article><p>No end of the head, but a text.</p><p>And some more text, here.</p></article>") == (
        "No end of the head, but a text.\n\nAnd some more text, here.")


def test_one_word_does_not_empty_an_article(model):
    first, second = "The film is long, but it is a good one, and the cast is fine.", "Its music, on the other hand, could be better than it is."
    for open_, close in (("<article class='review'>", "</article>"), ("<main id=comments>", "</main>"), ("<div class='review'>", "</div>")):
        page = f"<body><nav><a href=/>Home</a></nav>{open_}<p>{first}</p><p>{second}</p>{close}<footer>About us, and more.</footer></body>"
        assert model.text(page) == f"{first}\n\n{second}"
    thread = "".join(f"<article class=comment><p>{first}</p></article>" for _ in range(5))
    page = f"<div class=post><p>{first}</p><p>{second}</p></div><section id=comments>{thread}</section>"
    assert model.text(page) == f"{first}\n\n{second}"
    assert model.text("<div class=cookie-notice><div class=popup><p>We use cookies. Do you accept?</p></div></div>") == ""


def test_unclosed_elements_take_linear_time(model):
    import time

    for unit in ("<b>", "<div>", "<p>", "<li>", "<td>", "</b>", "<b></i>", "<a href=x>", "<button>", "<span>x</div>"):
        started = time.perf_counter()
        text = model.text("<article><p>A sentence, to begin with.</p>" + unit * 100_000)
        assert isinstance(text, str) and time.perf_counter() - started < 20, unit
    started = time.perf_counter()
    assert model.text("<article><p>" + "<b>" * 300_000 + "A sentence, in bold, that is long enough.") == "A sentence, in bold, that is long enough."
    assert time.perf_counter() - started < 20


def test_marginals_equal_enumeration():
    page = pages.Page("<div class=content><p>Some text, here.</p><div class=ad>x</div></div><nav><a>y</a></nav>")
    model = pages.start_model()
    own, n = pages.features(page) @ model.weights, len(page.nodes)
    total, content = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [(bits >> i) & 1 for i in range(n)]
        p = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(model.pair[y[page.nodes[i].parent], y[i]] for i in range(1, n)))
        total += p
        content += p * np.array(y)
    assert model.marginals(page) == pytest.approx(content / total, rel=1e-9)


def test_query(spark, sf, given):
    from fingerloom.llm.queries import QUERIES

    got = {r.page_id: r for r in QUERIES["op9_html_extraction"](spark, sf).collect()}
    assert len(got) == len(given)
    for r in given:
        assert got[r.page_id].text == expected(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_nulls_repeats_and_clashes(spark):
    rows = [(None, None, PARTS, "x"), (1, "u", None, "x"), (2, "u", "", "x"), (3, None, PARTS, "x"), (3, None, PARTS, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    model = pages.fit(pages.training_pages(df))
    assert model.weights.tolist() == pages.start_model().weights.tolist()
    got = pages.extract(df, model, keep=["page_id", "text"]).collect()
    assert sorted(r.text for r in got) == ["", ""] + ["\n\n".join(WANT)] * 3
    assert pages.extract(df.limit(0), model, keep=["page_id"]).collect() == []
