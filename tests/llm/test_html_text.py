import html
import random
import re
import time

import pytest

from tessera.llm import html_text as ht

SCHEMA = "page_id long, url string, html string"


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body>
    <header>Site name</header><nav><ul><li><a href=/a>Menu one</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on this site and like them a lot.</div>
    <aside>About us, a long sidebar text that goes on and on for a while.</aside>
    <article><h1>The  &quot;title&quot;</h1><p><b>Bold</b> first
      paragraph &amp; more.<br>After break<p>Second <a href="x>y">link</a> here.
      <div class="ad">Buy now, buy here, buy a lot of it, buy it all the time</div>
      <script>var t = "</p>";</script><ul><li>One</li><li>Two</li></ul><form><input>Sign up</form><p>End.</article>
    <section id="comments"><h2>Comments</h2><article class="comment"><p>First! I liked it very much, a long reader comment with many words in it.</p></article></section>
    <footer>&copy; x</footer></body></html>"""
    assert ht.main_text(page).split("\n") == ['The "title"', "Bold first paragraph & more. After break", "Second link here.", "One", "Two", "End."]


def test_without_article_tags():
    nav = "<div>" + "".join(f"<a href=/{i}>Item {i}</a> " for i in range(20)) + "</div>"
    body = "".join(f"<p>Paragraph {i} of the text has some words in it, as texts do.</p>" for i in range(8))
    assert ht.main_text(f"<body>{nav}<div><h1>Head</h1>{body}</div><div class=footer>(c) we</div></body>").split("\n")[:2] == ["Head", "Paragraph 0 of the text has some words in it, as texts do."]


def test_dropped_elements_inside_the_text():
    body = "<p>A paragraph of the text that has a good many words in it, as texts mostly do.</p>" * 3
    page = f'<nav>Menu</nav><div class="top-banner">x</div><div><h1>Title</h1><div class="share">Share</div>{body}<div class="ad">Buy</div><p>End.</p></div><aside>Side</aside><footer>Foot</footer>'
    assert ht.main_text(page).split("\n")[0] == "Title" and ht.main_text(page).split("\n")[-1] == "End."


def test_marks():
    page = """<body class="has-sidebar"><div id="siteHeader">Top</div><div class="content-sidebar-wrap"><main><div class="post-header"><h1>İ Title</h1></div><p>Text.</p>
    <SCRIPT>x</SCRIPT ><p class="admonition">Add on.</p><section class="readerComments"><p>Nice!</p></section><div style="display:none">no</div></main></div></body>"""
    assert ht.main_text(page).split("\n") == ["İ Title", "Text.", "Add on."]


PARAGRAPH = "<p>A paragraph of the text that has a good many words in it, as texts mostly do.</p>"
FARM = "".join(f"<li><a href=/{i}>Link farm {i} with a few words</a></li>" for i in range(9))


def test_line_blocks_decide_inside_articles():
    """No class or element name tells these link farms from the text."""
    page = f"<article><h1><a href=/>Title</a></h1>{PARAGRAPH}<ul>{FARM}</ul>{PARAGRAPH}<p><a href=/x>One link</a></p><p>End.</p><div class=zx>{FARM}</div></article>"
    text = ht.main_text(page).split("\n")
    assert text[0] == "Title" and text[-2:] == ["One link", "End."] and len(text) == 5
    assert ht.main_text(f"<article><ul>{FARM}</ul></article>").count("\n") == 8


def test_line_blocks_decide_on_unmarked_pages():
    page = f"<div class=qx>{FARM}</div><div><h1>Title</h1>{PARAGRAPH * 3}</div><div class=zx>{FARM}</div><p>Short rest.</p>"
    assert ht.main_text(page).split("\n")[0] == "Title" and ht.main_text(page).count("\n") == 3


def test_several_articles():
    page = f"<article>{PARAGRAPH * 4}</article><article><p>A teaser.</p></article><article>{PARAGRAPH * 2}</article>{PARAGRAPH}"
    assert ht.main_text(page).count("\n") == 5


def test_surges_against_sums():
    rnd = random.Random(4)
    for _ in range(500):
        lengths = [rnd.choice([0, 0, 0, 5, 90]) for _ in range(rnd.randint(0, 40))]
        inside = {i for a, b in ht.regions(lengths) for i in range(a, b)}
        # A line is in a region unless it begins a run of WINDOW lines of no length, or a window only reaches over it to the rise.
        for i, n in enumerate(lengths):
            assert (n > 0) <= (i in inside)
            if sum(lengths[i : i + ht.WINDOW]) == 0:
                assert i not in inside


@pytest.mark.parametrize("page", ["<div><p>" * 50_000 + "<b>x</b>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000 + "</div>" * 50_000, "<nav><p>" * 30_000 + "<article>" * 30_000])
def test_broken_markup_in_linear_time(page):
    began = time.perf_counter()
    ht.main_text(page)
    assert time.perf_counter() - began < 5


def test_small_scale_pages(spark):
    """The pages' articles are marked, so that a plain cut gives their text."""
    rows = {r.page_id: r for r in ht.op3(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p.html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1|h2|div|ul|li)\b[^>]*>", article)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " , b)).split()) for b in blocks]
        assert rows[p.page_id].text == "\n".join(b for b in blocks if b)
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text)


def test_edges(spark):
    assert ht.extract(spark.createDataFrame([], SCHEMA)).collect() == []
    pages = [None, "", "<p", "plain text only", "<article><p>Unclosed <b>bold", "<nav><p>never closed<article><p>Text of it.</p></article>", "<div>" * 20_000 + "deep", "<p>a " * 30_000, '<a "' * 20_000, "&#x1F600;&bogus;&amp", "<script>x"]
    df = spark.createDataFrame([(i, None, p) for i, p in enumerate(pages)], SCHEMA)
    got = {r.page_id: r.text for r in ht.extract(df.withColumn("text", df.page_id)).collect()}
    assert len(got) == len(pages) and got[0] == got[1] == "" and got[3] == "plain text only"
    assert got[4] == "Unclosed bold" and got[5] == "Text of it." and got[6] == "deep"
    assert got[7].count("\n") == 29_999 and got[9] == "\U0001f600&bogus;&" and got[10] == ""
