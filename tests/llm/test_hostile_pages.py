"""Time linear in a page's length for any markup; nothing of an article dropped by a name alone."""

import time

import pytest

from tessellar.llm.op10_html_text import main_text

SIZE = 1_000_000
#: Units of markup that made a climb or a search start again for each of them.
SHAPES = ["<div>", "<a ", "<a '", "<b \"'>", "<b '\">\"'", "<span>", "<p><table><td>", "<ul><li>", "<b><td>", "<dl><dt>", "</p>", "<!--", "<!a", "<script>", "<", "&", "<a>", "<div class='ad'>x,", "<article><p>a, b", "<a \"''' > "]


@pytest.mark.parametrize("unit", SHAPES)
def test_repeated_units(unit):
    began = time.process_time()
    main_text(unit * (SIZE // len(unit)))
    assert time.process_time() - began < 20


@pytest.mark.parametrize("first, then", [("<div>", "</b>"), ("<p><table><td>", "<div>"), ("<span>", "<p>x, y"), ("<b><td>", "</b>"), ("<dl><dt>", "<dd>"), ("<a b=\"c'> ", "'")])
def test_one_after_another(first, then):
    began = time.process_time()
    main_text(first * (SIZE // 2 // len(first)) + then * (SIZE // 2 // len(then)))
    assert time.process_time() - began < 20


def test_names_inside_an_article():
    body = "Real content, of the article, with commas, and more of it here."
    assert main_text(f"<article><p>one two, three four.</p><div class='notice-board'><p>{body}</p></div></article>") == "one two, three four. " + body
    assert main_text(f"<article><div class='tags'><p>{body}</p></div><p>Short.</p></article>") == body + " Short."
    assert main_text(f"<article><p>{body}</p><div class='tags'><a href='x'>one</a> <a href='y'>two</a></div></article>") == body
    assert main_text(f"<article><p>{body}</p><div class='comments'><p>{body}</p></div></article>") == body


def test_articles_side_by_side():
    long = "long, text " * 50
    assert main_text(f"<main><p>x</p></main><article><p>{long}</p></article><article><p>short one</p></article>").endswith("text short one")
    assert main_text(f"<article><p>{long}</p></article><article><a href='x'>only links</a></article>") == long.strip()


def test_declarations_and_cdata():
    assert main_text("<p>x<![CDATA[abcdef") == "x"
    assert main_text("<p>a <![CDATA[abcdef]]> b") == "a b"
    assert main_text("<p>a <!doctype x> b <? php ?> c") == "a b c"
    assert main_text("<p>1 < 2 <b>c</b") == "1 < 2 c</b"


def test_repeated_rows_and_clashing_names(spark):
    from tessellar.llm.op10_html_text import html_text

    pages = spark.createDataFrame([(1, "u", "<p>x, y", "a", 5, "b"), (1, "u", "<p>x, y", "a", 5, "b"), (None, None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long, k0 string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text(pages).collect()) == [("1", "x, y", 4)] * 2 + [("None", "", 0)]
