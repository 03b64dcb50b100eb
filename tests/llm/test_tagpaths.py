"""Main text of pages: planted templates, a plain cut of the given pages, hard input."""

import html as entities
import random
import re
import time

import pytest

from tessera.llm import queries
from tessera.llm.common import table
from tessera.llm.tagpaths import Page, extract, main_text

WORDS = "of the reading plain river stone under morning letter seven and window quiet".split()


def sentence(rnd, low=6, high=18):
    words = [rnd.choice(WORDS) for _ in range(rnd.randint(low, high))]
    words[len(words) // 2] += ","
    return " ".join(words).capitalize() + "."


def paragraph(rnd):
    return " ".join(sentence(rnd) for _ in range(rnd.randint(2, 6)))


LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS[:7])
NOISE = {
    "script": '<script>var a = "<p>no text, here.</p>"; if (a < 3) run();</script><style>p > b {margin: 0}</style>',
    "comment": "<!-- <p>Hidden, hidden. Hidden!</p> -->",
    "form": '<form action="/s"><label>Your name, please.</label><input name=q><button>Send it now.</button></form>',
    "aside": "<aside><p>Side, side. More of the side, and so on.</p></aside>",
}


def layouts(title, body):
    """Templates with ``body`` as the article; each names the same text."""
    ps = "".join(f"<p>{p}</p>" for p in body)
    yield f"<html><head><title>Site</title></head><body><nav><ul>{LINKS}</ul></nav><article><h1>{title}</h1>{ps}</article><footer>All rights, reserved.</footer></body></html>"
    yield f'<body><header><h2>Site name</h2></header><div class="cookie-notice"><p>We use cookies, all of them. Accept, please.</p></div><main><h1>{title}</h1>{ps}</main><section id="comments"><article><p>{"I liked it, a lot. " * 60}</p></article></section>'
    yield f'<body class="single comments-open has-sidebar"><div id=menu><ul>{LINKS}</ul></div><div class="wrap"><div class="post"><div class="entry-header"><h1>{title}</h1></div><div class="text">{ps}</div></div><div class="sidebar widget"><p>About me, and more. Follow, read.</p></div></div><div class=advert><p>Buy this, now. Cheap, cheap!</p></div></body>'
    yield f'<body><div class="x1"><a href=/>home</a> <a href=/a>all</a> <a href=/b>new</a></div><div class="x2"><h1>{title}</h1>{ps}</div><div class="x3"><a href=/c>c</a> <a href=/d>d</a></div></body>'
    yield f'<form id="aspnet"><div class="layout-with-sidebar sidebar"><article><header><h1>{title}</h1></header>{ps}<footer>Filed, under, things.</footer></article></div></form>'
    yield f'<table><tr><td><ul>{LINKS}</ul></td><td class=main><h1>{title}</h1>{ps}</td></tr></table><div role="contentinfo">Imprint, terms.</div>'
    unclosed = "".join(f"<p><b>{p}" for p in body)
    yield f'<nav>{LINKS}</nav><article><h1>{title}</h1>{unclosed}</article><div class="related-posts"><p>Read this, too. And that, and that.</p></div>'


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("noise", [None, *NOISE])
def test_templates(seed, noise):
    rnd = random.Random(seed)
    title, body = sentence(rnd, 3, 6)[:-1], [paragraph(rnd) for _ in range(rnd.randint(2, 9))] + ["Short one."]
    want = " ".join([title, *body])
    for k, page in enumerate(layouts(title, body)):
        if noise:
            page = re.sub("<p>", NOISE[noise] + "<p>", page, count=1) if k != 4 else page.replace("<p>", "<p>" + NOISE["comment"], 1)
        assert main_text(page) == want, k


def test_every_given_page_gives_its_article(spark):
    df = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r for r in queries.QUERIES["op13_tag_path_ratios"](spark, "/root/testdata/sf0.01").collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        text = " ".join(entities.unescape(re.sub("<[^>]*>", " ", inner.replace("<b>", ""))).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (text, len(text), r["url"])


def test_references_and_white_space():
    page = "<article><p>A&amp;B &lt;x&gt;&nbsp;&#65;&#x1F600;&copy\n\t <b>bo</b>ld,<br>next &notanentity; end.</p>\n<p>  two </p></article>"
    assert main_text(page) == "A&B <x> A😀© bold, next ¬anentity; end. two"
    assert main_text("<p>One, <span>two</span><span class=ad>buy</span> three.</p>") == "One, two three."
    assert main_text("<article><pre>a\n  b</pre><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>") == "a b x y 1 2"
    assert main_text("<article><![CDATA[in, it.]]><p>Text.</article>") == "in, it. Text."


def test_pages_without_markup_or_main_text():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == main_text(f"<ul>{LINKS}</ul>") == ""
    assert main_text("just text, no tags") == "just text, no tags"
    assert main_text("a < b and c <d") == "a < b and c"
    assert main_text("<script>never closed, <p>text.</p>") == ""
    assert main_text("<article><p>Cut, here. <a href='x") == "Cut, here."


def test_rows_nulls_repeats_and_other_columns(spark):
    page = "<article><p>One, two.</p></article>"
    rows = [(1, "u", page, 9, "t"), (1, "u", page, 9, "t"), (None, None, page, 9, "t"), (2, "v", None, 9, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "One, two.", 9)] * 2 + [(None, None, "One, two.", 9), (2, "v", "", 0)], key=str)
    assert extract(df.limit(0)).collect() == []


def test_long_and_deep_pages_take_linear_time():
    began = time.time()
    n = 60_000
    long = "<article>" + "<p>Word, and word.</p>" * n + "</article>"
    assert len(main_text(long)) == n * 16 - 1
    assert main_text("<article><p><table><td>" + "<div>" * n + "Deep, text." + "</div>" * n + "<p>After.</article>") == "Deep, text. After."
    for piece in ("<p", "<a href='", "<!--", "</", "<div>", "<p><table><td>", "&", "<b>", "<a>x", "<ul><li>", "<script>", "<"):
        main_text(piece * n)
    assert time.time() - began < 60


def test_elements_are_closed_as_browsers_do():
    page = Page("<div><p>a<div>b</div></p><li>c<ul><li>d</ul><li>e</div><p>f")
    names = {b.text: page.elements[b.element].tag for b in page.blocks}
    assert names == {"a": "p", "b": "div", "c": "li", "d": "li", "e": "li", "f": "p"}
    parents = {b.text: page.elements[page.elements[b.element].parent].tag for b in page.blocks}
    assert parents == {"a": "div", "b": "div", "c": "div", "d": "ul", "e": "div", "f": ""}
