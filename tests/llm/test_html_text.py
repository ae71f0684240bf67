import html
import re

import pytest
from llm_helpers import SF_SMALL

from tilequarry.llm.html_text import extract, main_text
from tilequarry.llm.queries import QUERIES


def article_by_hand(page):
    inner = page[page.index("<article>") + 9:].split("</article>")[0]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = QUERIES["op4_html_extraction"](spark, SF_SMALL).collect()
    assert {r.page_id: r.text for r in rows} == {k: article_by_hand(v) for k, v in pages.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


BODY = "<h1>Title &eacute;</h1><p>Para one, with commas, and text.<p>Para <b>two</b>&nbsp;x<br>y <ul><li>one<li>two</ul>"
TEXT = "Title é\nPara one, with commas, and text.\nPara two x y\none\ntwo"


@pytest.mark.parametrize("page", [
    f"<div class=content>{BODY}</div>",
    f"<nav><a href=x>home</a></nav><main>{BODY}</main><footer><p>Copy, right, now</p></footer>",
    f"<header><h2>Site</h2></header><div class='wrapper has-sidebar'><div class=content>{BODY}</div><div class=sidebar><p>Read, this, too, and, that</p></div></div>",
    f"<div id='cookie-notice'>We use cookies, fine, yes</div><article>{BODY}</article><section id=comments><article class=comment><p>I, for, one, agree</p></article></section>",
    f"<article>{BODY}<aside><p>Aside, aside, aside</p></aside><form><p>Your mail, please</p></form><script>var a='<p>x, y</p>'</script></article>",
    f"<!-- <p>gone, gone</p> --><style>p{{}}</style><article>{BODY}<p style='display: none'>hidden, text</p></article>",
    f"<article>{BODY}<div class=advert>Buy, buy, buy</div><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul></article",
])
def test_layouts(page):
    assert extract(f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}") == TEXT


def test_odd_pages(spark):
    assert [extract(x) for x in (None, "", "   ", "<p>", "just text &amp; more", "a < b", "<p>x", "<article><header><h1>T</h1></header><p>a</p></article>")] == [
        "", "", "", "", "just text & more", "a < b", "x", "T\na"]
    deep = "<div>" * 5000 + "<p>deep, text</p>"
    assert extract(deep) == "deep, text"
    rows = [(1, "u", "<p>a</p>", 3), (1, "u", "<p>a</p>", 3), (None, None, None, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = main_text(pages).select("doc.page_id", "text").collect()
    assert sorted(map(tuple, found), key=str) == [(1, "a"), (1, "a"), (None, "")]
    assert main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("attrs", ['title="A hidden gem in Rome"', 'class="overflow hidden wide"', "title='x class=sidebar y'",
                                   'data-note="style = \'display:none\'"', 'title="say aria-hidden=true"'])
def test_words_inside_attribute_values_hide_nothing(attrs):
    assert extract(f"<body><article {attrs}>{BODY}</article>") == TEXT


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", "class=x hidden", "hidden=until-found", "aria-hidden=true",
                                   "style='color: red;display : none'", "style=display:none"])
def test_hidden_elements_go(attrs):
    assert extract(f"<body><article>{BODY}<p {attrs}>hidden, text, here</p></article>") == TEXT


def test_parts_beside_an_article_stay():
    one = "".join(f"<p>Part one, sentence {k}, with commas, and some more text to read.</p>" for k in range(6))
    two = one.replace("one", "two")
    want = [f"Part {n}, sentence {k}, with commas, and some more text to read." for n in ("one", "two") for k in range(6)]
    assert extract(f"<body><main><article>{one}</article><section>{two}</section></main>") == "\n".join(want)
    assert extract(f"<body><main>{one}</main><div>{two}</div>") == "\n".join(want)
