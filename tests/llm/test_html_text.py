import html as H
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiforge.llm import html_text as X

DATA = "/root/testdata/sf0.01"
LONG = "This is a long paragraph about one thing, and it goes on for quite some time so that it counts as text."


def page(body, title="A title"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_article_of_the_tables(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(H.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|div|ul|li)[^>]*>", inside)]
        assert X.main_text(r.html) == " ".join(filter(None, blocks)), r.page_id


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("", ""), ("just text", "just text"), (f"<p>{LONG}", LONG), (f"<nav><a href=x>One</a> <a>Two</a></nav><p>{LONG}</p><footer>&copy; 2024 {LONG}</footer>", LONG),
        (f"<div class='cookie-banner'>We use cookies. {LONG}</div><main><h1>Head</h1><p>{LONG}</p><p>No.</p><aside>{LONG}</aside></main>", f"Head {LONG} No."),
        (f"<div id=content><h2>Head</h2><p>{LONG}</p><p>Short &amp; sweet&nbsp;.</p><p>{LONG}</p></div><div class=sidebar><ul><li><a>x</a><li><a>y</a></ul></div>", f"Head {LONG} Short & sweet . {LONG}"),
        (f"<article><header><h1>Head</h1></header><p>{LONG}<br>Line <b>bo</b>ld</p><form><label>{LONG}</label><input></form><section class='comments'><p>{LONG}</p></section></article>", f"Head {LONG} Line bold"),
        (f"<header><h1>Site</h1></header><article><p>{LONG}</p></article><section id='comments'><article class='comment'><p>{LONG} {LONG} {LONG}</p></article></section>", LONG),
        (f"<div class=advert>{LONG}</div><div class=shadow><p>{LONG}</p></div>", LONG),
        ("<p>a\n\t b</p><p>c</p>", "a b c"), ("<p>&lt;x&gt; &#233; &unknown; 1 < 2</p>", "<x> é &unknown; 1 < 2"), ("<!-- c --><p>x</p><![CDATA[y]]>", "x"), ("<p>unclosed <b>bold<p>next", "unclosed bold next"),
    ],
)
def test_pages(body, want):
    assert X.main_text(page(body)) == want


def test_sections_and_articles():
    many, few = [f"{LONG} " * 10 + f"{i}." for i in range(10)], [f"A short paragraph, number {i}, that belongs to the text." for i in range(3)]
    p = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    menu = "<div><a href=1>One thing</a> <a href=2>Another thing</a></div>"
    want = " ".join(many + few)
    assert X.main_text(page(f"<div id=content><div class=part1>{p(many)}</div><div class=part2>{p(few)}</div></div>{menu}")) == want
    assert X.main_text(page(f"{menu}<div class=col><div class=part1>{p(many)}</div></div><section>{p(few)}</section><footer>{LONG}</footer>")) == want
    assert X.main_text(page(f"{menu}<article>{p(many)}</article><article>{p(few)}</article><aside><article>{LONG}</article></aside>")) == want
    assert X.main_text(page(f"<article>{p(many[:6])}</article><article>{p(many[6:])}</article>")) == " ".join(many)
    assert X.main_text(page(f"<main><article>{p(many)}</article><article>{p(few)}</article></main>")) == want


def test_names_inside_an_article_are_weak():
    body = f"<article><header class='entry-header'><h1>Head</h1></header><p>{LONG}</p><h2 class='section-header'>Part</h2><p class='side note'>{LONG}</p><div class='share'>Share it</div><p>{LONG}</p></article>"
    assert X.main_text(page(body)) == f"Head {LONG} Part {LONG} {LONG}"


def _plain_page(tail):
    """A page that says nothing by its tags and names: short loose lines, then text, then ``tail``."""
    loose = "".join(f"<div>{w}</div>" for w in ("Start", "World", "Sport", "Money", "Shop", "Log in"))
    return page(f"{loose}<div><p>{LONG} {LONG}</p><p>{LONG} {LONG} {LONG}</p>{tail}</div>" + "".join(f"<div>{w}</div>" for w in ("About", "Terms", "Help", "Jobs", "Press", "Imprint")))


def test_ratios_decide_where_tags_and_names_do_not(monkeypatch):
    want = f"{LONG} {LONG} {LONG} {LONG} {LONG} Yes. {LONG} {LONG}"
    html = _plain_page(f"<div>Yes.</div><p>{LONG} {LONG}</p>")
    assert X.main_text(html) == want
    with monkeypatch.context() as m:  # without smoothing nothing vouches for the short block
        m.setattr(X, "smoothed", lambda x, side=0: x)
        assert X.main_text(html) == want.replace(" Yes.", "")
    with monkeypatch.context() as m:  # without a threshold the menus stay
        m.setattr(X, "split_in_two", lambda x: -1.0)
        assert "Sport" in X.main_text(html) and "Terms" in X.main_text(html)
    with monkeypatch.context() as m:  # without ratios the same
        m.setattr(X, "smoothed", lambda x, side=0: np.ones(len(x)))
        assert "Sport" in X.main_text(html)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<![foo[x]]>", "<![ x ]>", "<![CDATA[y]]>", "<!x>", "<!DOCTYPE", "<?p", "</", "<a href='", "<p>", "</div>", "<script>", "<!--", "-->", "&#x110000;", "&amp", "]]>", "<article>", "\x00", "text "]), st.text(max_size=5))).map("".join))
def test_never_raises(html):
    X.main_text(html)


def test_broken_and_large_pages():
    assert X.main_text(page(f"<p>{LONG}</p><![foo[x]]><p>{LONG}</p><![ x ]>")) == f"{LONG} {LONG}"
    assert X.main_text("<div>" * 2000 + LONG + "</div>" * 2000) == LONG
    big = page("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>")
    assert X.main_text(big) == " ".join([LONG] * 5000)


def test_smoothing_and_threshold():
    x = np.array([0.0, 0, 10, 0, 0])
    assert X.smoothed(x).argmax() == 2 and X.smoothed(np.ones(4)) == pytest.approx(np.ones(4))
    assert X.smoothed(x, -1)[1] == 0 < X.smoothed(x, -1)[3] and X.smoothed(x, 1)[3] == 0 < X.smoothed(x, 1)[1]
    assert 1 < X.split_in_two(np.array([0.0, 1, 9, 10])) < 9


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "v", page(f"<p>{LONG}</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as n_chars", "'own' as text")
    assert X.extracted(df).columns == ["page_id", "url", "n_chars", "text"]
    assert sorted(r.text for r in X.extracted(df).collect()) == ["", "", "", LONG]
    assert X.extracted(df.limit(0)).collect() == []
