import html as entities
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quirework.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style></head><body class="has-sidebar comments-open">
<div id="cookie-notice"><p>We use cookies to make this site better for all of you.</p><button>Fine</button></div>
<div class="site-header"><p><a href="/">The daily page</a></p></div><div class=menu><ul><li><a href="/a">World</a></li><li><a href="/b">Sports</a></li></ul></div>
<main><article><h1>Water &amp; light</h1><p>The  first\n paragraph has <a href="x">a link</a> and ends here.<div class="ad-slot"><p>Buy this very good thing now, it is cheap.</p></div>
<p>Short.</p><ul><li>One point of it.</li><li>Another &lt;b&gt; point.</ul><script>var x = "</p><p>no</p>";</script>
<form action="/s"><label>Your mail</label><input name=q><p>Join our list of readers today.</p></form><blockquote><p>Somebody&nbsp;said so.</p></blockquote><p>The end of it, caf&eacute;.</p></article>
<section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I think that this article is quite right about water and light.</p></div></section></main>
<aside><h3>Most read</h3><ul><li><a href=1>First story of the day</a></li></ul></aside><footer><p>&copy; 2024 The daily page</p></footer></body></html>"""
TEXT = "Water & light\nThe first paragraph has a link and ends here.\nShort.\nOne point of it.\nAnother <b> point.\nSomebody said so.\nThe end of it, café."


@pytest.fixture(scope="module")
def model():
    return html_text.fit(html_text.labelled_pages())


def plain(html):
    """The article of the given pages, by patterns that know them."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", html, re.S)[1]
    blocks = (" ".join(entities.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)\b[^>]*>", inner))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark, sf_dir):
    got = html_text.op13_main_text(spark, sf_dir).collect()
    want = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (want[r.page_id].url, plain(want[r.page_id].html), len(r.text))


def test_every_kind_of_part(model):
    assert model.main_text(PAGE) == TEXT
    nameless = re.sub(r"</?(main|article)>", "", PAGE)
    assert model.main_text(nameless) == TEXT
    assert model.main_text(PAGE.replace("article>", 'div itemprop="articleBody">').upper().replace("&AMP;", "&amp;")).startswith("WATER & LIGHT\nTHE FIRST PARAGRAPH")


def test_held_out_layouts(model):
    pages = html_text.labelled_pages(150, seed=1234)
    scores = [html_text.f1(model.main_text(h), t) for h, t in pages]
    assert sum(scores) / len(scores) > 0.96
    assert sum(s == 1 for s in scores) > 100


@given(st.lists(st.integers(-5, 5), max_size=30))
def test_region_is_the_best(scores):
    start, end = html_text.best_region(scores)
    sums = [sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)]
    assert sum(scores[start:end]) == max(sums)


ODD = [None, "", "  \n", "<", "<p", "no markup at all", "<p>cut &am", "<!-- never closed <p>x</p>", "<script>never closed <p>x</p>", '<a href="never closed><p>x y z.</p>', "</div></p></x><p>stray</p>", "<p>" * 3000, "<div>" * 3000 + "deep"]


def test_odd_pages(spark, model):
    long = "<article>" + "".join(f"<p>Paragraph {i} of a very long page, it has to be read to its end.</p>" for i in range(20_000)) + "</article>"
    rows = [(i, "u", h, "mine", i) for i, h in enumerate([*ODD, long, long])] + [(None, None, PAGE, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, found long").repartition(3)
    out = html_text.with_main_text(df, model)
    assert out.columns == ["page_id", "url", "html", "text", "found", "text_", "n_chars_"]
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(r.n_chars_ == len(r.text_) and r.text in ("mine", None) for r in got.values())
    assert got[0].text_ == got[1].text_ == "" and got[None].text_ == TEXT
    assert got[len(ODD)].text_.count("\n") == 19_999 and got[len(ODD)].text_ == got[len(ODD) + 1].text_
    assert html_text.with_main_text(df.limit(0), model).count() == 0
