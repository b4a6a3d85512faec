"""Nothing of a text is lost to names, lengths or layout."""

from tessellar.llm import op3_license_scan as op3
from tessellar.llm import op10_html_text as op10

P = "<p>A paragraph of the article, with some words, a few commas, and an end.</p>"
TEXT = "A paragraph of the article, with some words, a few commas, and an end."


def test_layout_names_drop_no_article():
    assert op10.main_text(f'<div class="content-sidebar-wrap"><main><article>{P}</article></main></div>') == TEXT
    for name in ("no-sidebar", "has-sidebar", "with-comments", "hidden-xs", "search-results", "elementor-widget-container", "noSidebar"):
        assert op10.main_text(f'<div id="page" class="{name}">{P}</div>') == TEXT, name
        assert op10.main_text(f'<div><div id="{name}">{P}</div>{P}{P}</div>') == f"{TEXT} {TEXT} {TEXT}", name


def test_names_drop_nothing_that_holds_the_article():
    for name in ("sidebar", "widget", "left-sidebar", "comments"):
        assert op10.main_text(f'<div class="{name}"><article>{P}</article></div>') == TEXT
        assert op10.main_text(f'<div class="{name}"><main>{P}</main></div><div>{P}{P}</div>').count(TEXT) >= 1
        assert op10.main_text(f'<div class="{name}">{P}{P}</div><div>Short.</div>').startswith(f"{TEXT} {TEXT}")
    assert op10.main_text(f'<div class="widget">{P}<div class="share">Share it</div></div>') == TEXT


def test_names_still_drop_what_is_no_article():
    for name in ("comments", "comment-list", "left-sidebar", "sidebar", "site-header", "cookie-notice", "relatedPosts", "ad", "ads_top", "x share"):
        assert op10.main_text(f'<div>{P}{P}<div class="{name}"><p>Not, of, it</p></div></div>') == f"{TEXT} {TEXT}", name
    long = "<article class='comment-body'>" + P.replace("article", "reader") * 5 + "</article>"
    assert op10.main_text(f"<article>{P}</article><div id='comments'>{long}</div>") == TEXT


def test_what_stands_beside_the_best_container_stays():
    long = "<section>" + ("<p>" + "word " * 100 + "</p>") * 10 + "</section>"
    short = "<p>" + "other " * 50 + "</p>"
    got = op10.main_text(f"<div>{long}<section>{short}</section></div><footer>f</footer>").split()
    assert got.count("word") == 1000 and got.count("other") == 50
    beside = 'Bare text, <a href="x">a link</a> in it.<br>A line.<ul><li>one<li>two</ul><table><tr><td>1<td>2</table><figure><img><figcaption>Figure.</figcaption></figure><h4>Small</h4><p>The end.</p>'
    links = '<ul><li><a href="a">First other page</a><li><a href="b">Second other page</a></ul><p>See: <a href="c">another page altogether</a></p>'
    got = op10.main_text(f'<div>{beside}{long}{links}<div class="share">Share</div>Last.</div>').split("word")
    assert got[0].strip() == "Bare text, a link in it. A line. one two 1 2 Figure. Small The end." and got[-1].strip() == "Last."


BSD = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at

#     http://www.apache.org/licenses/LICENSE-2.0

# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""


def license_rows(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.labels.split(","), r.score) for r in sorted(op3.digest(op3.license_scan(docs, **how)).collect(), key=lambda r: r.doc_id)]


def test_published_layouts_of_licenses(spark):
    filler = "\n\n".join(["Some words of another kind stand here."] * 5)
    bsd, apache, wrapped = license_rows(spark, [BSD, f"{filler}\n\n{APACHE}\n{filler}", "// Licensed under CC\n//   BY-NC 4.0\n"])
    assert bsd[0] == ["bsd-notice", "reserved-line"] and bsd[1] == 1.0
    assert apache[0] == ["apache", "apache-line", "apache-notice"]
    assert wrapped == (["cc-by-nc-line"], 1.0)


def test_licenses_broken_anywhere(spark):
    cases = []
    for templates, gap in ((op3.NOTICES, "\n\n"), (op3.LINES, "\n")):
        for label, text in templates.items():
            words = text.split()
            if len(words) >= op3.WRAPPED_WORDS:
                cases += [(label, f"one two{gap}" + " ".join(words[:k]) + gap + " ".join(words[k:]) + f"{gap}three") for k in range(1, len(words))]
    for (label, text), (labels, score) in zip(cases, license_rows(spark, [t for _, t in cases], phrases={"no such phrase": "none"}), strict=True):
        assert label in labels and score == 1.0, text
    apart = op3.NOTICES["bsd-notice"].split()
    apart = " ".join(apart[:20]) + "\n\n" + "filler " * 60 + "\n\n" + " ".join(apart[20:])
    assert license_rows(spark, [apart]) == [([""], 0.0)]
