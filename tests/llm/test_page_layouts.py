"""Columns, sections, leads, comments and forms; scores and choice of the best container by a slow second version."""

import random

import pytest

from tessellar.llm import op10_html_text as op10

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def para(tag, n=60):
    return f"{tag} " + ", ".join(" ".join(WORDS[(k + j) % 12] for j in range(6)) for k in range(n // 6)) + "."


def p(tag):
    return f"<p>{para(tag)}</p>"


def found(page):
    return [w for w in op10.main_text(page).split() if w[0].isupper()]


def test_columns_sections_and_leads():
    left, right = "".join(p(f"L{k}") for k in range(8)), "".join(p(f"R{k}") for k in range(7))
    every = [f"L{k}" for k in range(8)] + [f"R{k}" for k in range(7)]
    assert found(f"<body><div class=row><div class=col1><div class=inner>{left}</div></div><div class=col2><div class=inner>{right}</div></div></div></body>") == every
    assert found(f"<body><div><section><div>{left}</div></section><section><div>{right}</div></section></div></body>") == every
    lead = f"<div class=lead>{p('Lead')}</div>"
    assert found(f"<body><div>{lead}<div><div class=body>{left}</div></div></div></body>") == ["Lead", *every[:8]]
    assert found(f"<body><div><div><h1>Title</h1></div><div><div class=body>{left}</div></div></div></body>") == ["Title", *every[:8]]
    links = "<div><ul>" + "".join(f"<li><a href=x>Other {para('x', 12)}</a></li>" for _ in range(9)) + "</ul></div>"
    assert found(f"<body><div>{links}<div><div class=body>{left}</div></div></div><div>Copyright Us</div></body>") == every[:8]


def test_comments_go_however_many_they_are():
    text, said = "".join(p(f"T{k}") for k in range(4)), "".join(p(f"C{k}") for k in range(6))
    every = [f"T{k}" for k in range(4)]
    for comments in (f"<section id=comments>{said}</section>", f"<div class=user-comments-list>{said}</div>", f"<section id=comments><article>{said}</article></section>", f"<article class=comment-body>{said}</article>", "".join(f"<div class=comment>{p(f'C{k}')}</div>" for k in range(6))):
        assert found(f"<body><article>{text}{comments}</article></body>") == every
        assert found(f"<body><div>{text}</div>{comments}</body>") == every
        assert found(f"<body>{comments}</body>") == [f"C{k}" for k in range(6)]


def test_forms():
    text = "".join(p(f"T{k}") for k in range(4))
    every = [f"T{k}" for k in range(4)]
    control = "<label>Name</label><input name=a><select><option>One</select><button>Send</button>"
    assert found(f"<body><form action=x><div>{control}</div><div>{text}</div></form></body>") == every
    assert found(f"<body><form action=x><main>{text}</main></form><div>{p('Other')}</div></body>") == every
    assert found(f"<body><div>{text}<form>Subscribe to us, now, or later, please {control}</form></div></body>") == every


def test_words_of_link_lists_inside_an_article():
    text = "".join(p(f"T{k}") for k in range(9))
    assert found(f"<article>{text}<div class=tags>{p('Prose')}</div></article>")[-1] == "Prose"
    assert "Tag" not in found(f"<article>{text}<div class=tags><a>Tag one</a>, <a>Tag two</a></div></article>")
    assert "Also" not in found(f"<article>{text}<div class=related><p><a href=x>Also {para('y')}</a></p></div></article>")


def slow_scores(root):
    """Points of every container by walking up from each block."""

    def not_dropped(x):
        while x is not None:
            if x.dropped:
                return False
            x = x.parent
        return True

    def every(x):
        yield x
        for part in x.parts:
            if not isinstance(part, str):
                yield from every(part)

    def is_block(x):
        return x.parent is None or x.tag in op10.BLOCKS and x.tag != "br"

    texts = {}
    for x in every(root):
        if not_dropped(x):
            block, link, up = None, False, x
            while block is None:
                link |= up.tag == "a"
                block, up = (up if is_block(up) else None), up.parent
            while up is not None:
                link |= up.tag == "a"
                up = up.parent
            for part in x.parts:
                if isinstance(part, str):
                    texts.setdefault(id(block), (block, []))[1].append((part, link))
    scores = {}
    for block, parts in texts.values():
        size = sum(len(t.strip()) for t, _ in parts)
        if size < 1 or block.tag not in op10.PARAGRAPHS:
            continue
        links = sum(len(t.strip()) for t, link in parts if link)
        own = (1 + sum(t.count(",") for t, _ in parts) + min(size / 100, 3) + size / 1000) * (1 - links / size)
        up, share = block, 1.0
        if block.tag not in ("div", "section", "article", "main", "body"):
            up = block.parent
            while up is not None and not is_block(up):
                up = up.parent
        while up is not None and share > 0.05:
            scores[id(up)] = scores.get(id(up), 0) + own * share
            share /= 2
            up = up.parent
            while up is not None and not is_block(up):
                up = up.parent
    return scores


@pytest.mark.parametrize("seed", range(40))
def test_scores_by_a_slow_version(seed):
    rng = random.Random(seed)

    def some(depth):
        kind = rng.randrange(9)
        if depth > 5 or kind < 3:
            return rng.choice(["text, ", "a b c", para("q", 12), " ", "é,"])
        tag = rng.choice(["div", "p", "section", "span", "a", "li", "b", "blockquote", "nav"])
        return f"<{tag}>" + "".join(some(depth + 1) for _ in range(rng.randrange(5))) + f"</{tag}>"

    root = op10.parse("<body>" + "".join(some(0) for _ in range(8)) + "</body>")
    got = {id(x): x.score for x in op10.scored(root)}
    want = slow_scores(root)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_equal_containers_the_first_wins():
    page = f"<body><div><div class=a>{p('A')}</div></div><div><div class=b>{p('B')}</div></div></body>"
    containers = op10.scored(op10.parse(page))
    top = max(containers, key=lambda n: n.score)
    assert top is next(c for c in containers if c.score == top.score)


def test_deep_pages_with_text_on_every_level_are_linear():
    import time

    began = time.process_time()
    deep = "<div>a, b " * 100_000 + f"<p>{para('Deep')}</p>"
    assert "Deep" in op10.main_text(deep)
    assert op10.main_text("<div>" * 100_000 + p("Low") + "</div><p>x, y</p>" * 100_000).startswith("Low")
    assert time.process_time() - began < 40
