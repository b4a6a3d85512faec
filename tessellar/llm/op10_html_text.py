"""Main text of web pages by tree scoring.

Markup is read with one tolerant scan into a tree (unclosed and crossed tags, void elements, raw
script and style text). Subtrees that are never an article's text go: by element (nav, form, script
and so on), by role, when hidden, or when a whole class or id says so (comments, cookie-notice,
left-sidebar; not no-sidebar or content-sidebar-wrap). What holds a main element or an article (but
one marked itself, as comments are), or more than half of the page's points and no other article
or main has any, is never dropped by its name; nor is what lies inside an article, has a good part of
its points and is named by a word that prose may have too (notice), or has a paragraph and few links if the word names
lists of links (tags, related). What readers say is dropped wherever it stands, however much it is, and forms are, unless no
paragraph is outside of them: then only their controls go. Of what is left each paragraph passes points for its length and its
commas to its ancestors, halved with every level and discounted by the share of its text in links.
The container with the most points wins; an article or main element around it is preferred whole, with
those beside it that aren't mostly links, else all that stands beside it (text, lists, tables, paragraphs of any length) is kept with it, but
for what is mostly links, and on every level above, up to the body, what has a paragraph or the title: other columns, sections, a lead.

All text of the chosen nodes is returned in page order: character references are decoded, white
space inside a block becomes one space, blocks are joined by one space.

Defined cases: null or empty html gives an empty text and 0 characters; a page without paragraphs
gives what is left of its body; a comment, script or declaration without an end reaches to the end of the
page, and CDATA is a comment, as in browsers; of containers with equal points the first met wins; repeated
rows give repeated rows; an empty table gives an empty result; other columns are ignored, whatever their
names. Map-only: no shuffle, memory bounded by one slice of pages. Time is linear in a page's length for
any markup: open elements are found by lists of their places, and no character is searched twice for
the end of a tag but for one search of each kind of quote.
"""

from __future__ import annotations

import bisect
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.common import slices, table, texts_of

TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("br body html caption dd dt legend optgroup option tbody td tfoot th thead tr summary".split())
#: An opening element ends an open one of these, up to the given border.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
DROPPED = frozenset("head script style noscript template nav footer aside button select option input textarea label iframe object embed svg math canvas audio video map menu dialog title noembed noframes xmp".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
#: Fixed words that mark what isn't an article's text: a class or id of them alone, or of them and NEUTRAL ones.
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promos promotion comment comments commentlist disqus respond replies reply sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs footer footnav masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations widget widgets toolbar pager pagination copyright disclaimer skip hidden search tags tagcloud outbrain taboola".split())
#: These mark the head of a page, but inside an article its own head.
HEAD_WORDS = frozenset("header topbar site-header".split())
#: Words that may stand beside a marking one in a class or id: places, boxes, what they belong to.
NEUTRAL = frozenset("left right top bottom upper lower first second primary secondary main global site page pages post posts article articles entry entries story stories blog news user area bar block body box btn button buttons col column container count form group head heading icon icons inline inner item items label link links list outer panel row section small sticky strip text title unit wrap wrapper slot zone".split())
#: These words mark by themselves only: beside others they name a state, a list of results or the like.
ALONE = frozenset("hidden skip search alert".split())
#: Words that name parts of an article's prose as well; inside one they drop only what has little of it.
PROSE_WORDS = frozenset("alert aside header hidden masthead notice notices notification recommended related search skip tags topbar widget widgets".split())
#: Such a part is kept with at least this share of its article's points.
PROSE_SHARE = 0.25
#: Of those, these mark lists of links: inside an article they drop only what is one, or has no paragraph.
LINKED_WORDS = frozenset("recommended related search tags widget widgets".split())
#: These mark what readers say.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: Points of a real paragraph; points of one that is kept beside the way up from the best container.
PARAGRAPH_POINTS, BESIDE_POINTS = 2.0, 3.0
#: What stands beside the best container stays if less than this share of its text is in links.
MOST_LINKS = 0.5
NEVER_BY_NAME = frozenset("html body article main".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd h2 h3 h4 div section article main body".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "named", "prose", "linked", "comment", "score", "own", "commas", "links", "article", "around")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.parts: list[str | Node] = []
        self.dropped = self.named = self.prose = self.linked = self.comment = False
        #: The nearest block or root above.
        self.around = parent if parent is None or parent.parent is None or parent.tag in BLOCKS else parent.around
        self.score = 0.0
        self.own = self.commas = self.links = 0  # characters and commas of its direct text, characters in links
        self.article = parent is not None and (parent.article or parent.tag in ("article", "main"))


def marks_of(value: str, inside: bool) -> set[str]:
    """The words by which whole classes or ids among those given mark what isn't an article's text."""
    out: set[str] = set()
    for token in value.split():
        words = [w.lower() for w in WORDS.findall(token)]
        marks = [w for w in words if w in DROPPED_WORDS or not inside and w in HEAD_WORDS]
        if marks and (len(words) == 1 or any(w not in ALONE for w in marks) and all(w in marks or w in NEUTRAL for w in words)):
            out.update(marks)
    return out


def boilerplate(tag: str, attributes: str) -> bool:
    """Whether the element is never an article's text, whatever it holds."""
    if tag in DROPPED:
        return True
    if not attributes or tag in NEVER_BY_NAME:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def by_name(attributes: str, inside: bool) -> set[str]:
    return {w for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for w in marks_of(a or b or c, inside)}


class Ends:
    """Where tags end. Searches go forwards and remember what they found, so that none is repeated."""

    def __init__(self, page: str):
        self.page = page
        self.clear = (0, 0)  # from, to: no stop in between
        self.plain = (0, 0)  # likewise for ">"
        #: Opening quotes after which no tag ends.
        self.doomed: set[int] = set()

    def stop(self, at: int) -> int:
        if not self.clear[0] <= at <= self.clear[1]:
            found = STOP.search(self.page, at)
            self.clear = at, found.start() if found else len(self.page)
        return self.clear[1]

    def of(self, at: int) -> int:
        """Place of the ">" that ends the tag whose name ends at `at`, outside quotes if they are closed; -1 if none does."""
        page, passed = self.page, []
        now = self.stop(at)
        while now < len(page) and page[now] != ">" and now not in self.doomed:
            passed.append(now)
            close = page.find(page[now], now + 1)
            if close < 0:
                break
            now = self.stop(close + 1)
        if now < len(page) and page[now] == ">":
            return now
        self.doomed.update(passed)
        if not self.plain[0] <= at <= self.plain[1]:
            self.plain = at, page.find(">", at) % (len(page) + 1)
        return self.plain[1] if self.plain[1] < len(page) else -1


class Open:
    """The open elements, and the places of each tag among them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Ends the element at a place and all in it."""
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The innermost place of any of the tags; 0, the root's, if none is open."""
        return max((own[-1] for tag in tags if (own := self.places.get(tag))), default=0)

    def end(self, tags, border) -> None:
        """Ends what is open of the tags inside the innermost border: p alone the innermost, else from the outermost on."""
        edge = self.last(border)
        if tags == {"p"}:
            at = self.last(tags)
        else:
            at = min((own[k] for tag in tags if (own := self.places.get(tag)) and (k := bisect.bisect(own, edge)) < len(own)), default=0)
        if at > edge:
            self.cut(at)


def parse(page: str) -> Node:
    root = Node("#root", None)
    opened, ends = Open(root), Ends(page)
    at = text = 0
    n = len(page)
    while True:
        start = page.find("<", at)
        if start < 0 or start + 1 == n:
            break
        name = TAG_NAME.match(page, start + 1)
        if name is None and page[start + 1] not in "!?":
            at = start + 1
            continue
        if name is None:
            end = page.find("-->" if page.startswith("<!--", start) else ">", start + 2)
            after = n if end < 0 else end + (3 if page.startswith("<!--", start) else 1)
        else:
            end = ends.of(name.end())
            if end < 0:
                break  # no tag ends any more
            after = end + 1
        here = opened.nodes[-1]
        if start > text:
            here.parts.append(page[text:start])
        at = text = after
        if name is None:
            continue
        closing, tag, attributes = name[1], name[2].lower(), page[name.end() : end]
        if closing:
            place = opened.last((tag,))
            if tag not in BLOCKS and place < opened.last(("td", "th", "table")):
                continue  # an inline end tag doesn't leave a cell
            if place:
                opened.cut(place)
            elif tag == "p":
                here.parts.append(Node("p", here))
            continue
        if tag in CLOSES_P:
            opened.end({"p"}, ("table", "td", "th", "button", "object"))
        if tag in ENDS:
            opened.end(*ENDS[tag])
        here = opened.nodes[-1]
        node = Node(tag, here)
        node.dropped = here.dropped or boilerplate(tag, attributes) or tag == "header" and not node.article
        if attributes and not node.dropped and tag not in ("html", "body"):
            words = by_name(attributes, node.article)
            node.named, node.prose = bool(words), bool(words) and node.article and words <= PROSE_WORDS
            node.linked, node.comment = node.prose and words <= LINKED_WORDS, bool(words & COMMENT_WORDS)
        here.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = text = close.end() if close else n
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path")):
            opened.push(node)  # "/>" doesn't close an HTML element
    if text < n:
        opened.nodes[-1].parts.append(page[text:])
    return root


def gathered(root: Node) -> tuple[list[Node], list[Node]]:
    """What isn't dropped, parents first, and its blocks with their direct text, that of inline elements included."""
    nodes, blocks = [], []
    stack: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while stack:
        node, block, link = stack.pop()
        if node.dropped:
            continue
        nodes.append(node)
        node.own = node.commas = node.links = 0
        if node.tag in BLOCKS and node.tag != "br" or block is None:
            block = node
            blocks.append(node)
        link = link or node.tag == "a"
        for part in node.parts:
            if isinstance(part, str):
                size = len(part.strip())
                block.own += size
                block.commas += part.count(",")
                block.links += size * link
            else:
                stack.append((part, block, link))
    return nodes, blocks


def points(block: Node) -> float:
    if block.own < 1 or block.tag not in PARAGRAPHS:
        return 0.0
    return (1 + block.commas + min(block.own / 100, 3) + block.own / 1000) * (1 - block.links / block.own)


def drop_named(root: Node) -> None:
    """Drops what a class or id marks, unless it holds an article or most of the page; what readers say, and forms,
    wherever there is a paragraph outside of these."""
    nodes, blocks = gathered(root)
    if not any(node.named or node.tag == "form" for node in nodes):
        return
    inner = dict.fromkeys(map(id, nodes), 0.0)  # points of all blocks inside
    best = dict.fromkeys(map(id, nodes), 0.0)  # most points of one block inside
    for block in blocks:
        inner[id(block)] = best[id(block)] = points(block)
    holds: set[int] = set()
    articles = 0
    for node in reversed(nodes):
        article = node.tag == "main" or node.tag == "article" and not node.named
        articles += article and inner[id(node)] > 0
        if node.parent is not None:
            inner[id(node.parent)] += inner[id(node)]
            best[id(node.parent)] = max(best[id(node.parent)], best[id(node)])
            if article or id(node) in holds:
                holds.add(id(node.parent))
    # whether a paragraph stands outside of all comments, or of all comments and forms
    said: dict[int, bool] = {}
    filled: dict[int, bool] = {}
    besides_comments = besides_forms = False
    own = {id(block): points(block) for block in blocks}
    for node in nodes:
        up = node.parent
        said[id(node)] = node.comment or up is not None and said[id(up)]
        filled[id(node)] = node.tag == "form" or up is not None and filled[id(up)]
        if own.get(id(node), 0.0) >= PARAGRAPH_POINTS and not said[id(node)]:
            besides_comments = True
            besides_forms |= not filled[id(node)]
    around = {id(root): 0}  # articles with points that a node is in
    of_article = {id(root): 0.0}  # points of the innermost one
    for node in nodes:
        up = node.parent
        if up is None:
            continue
        of_article[id(node)] = inner[id(up)] if up.tag in ("article", "main") else of_article[id(up)]
        around[id(node)] = around[id(up)] + ((up.tag == "main" or up.tag == "article" and not up.named) and inner[id(up)] > 0)
        if up.dropped:
            node.dropped = True
        elif node.comment and node.tag not in ("html", "body", "main"):
            node.dropped = besides_comments
        elif node.tag == "form" and id(node) not in holds:
            node.dropped = besides_forms
        elif node.named and node.tag not in NEVER_BY_NAME and id(node) not in holds:
            if node.linked:
                node.dropped = best[id(node)] < PARAGRAPH_POINTS or not few_links([node])
                continue
            most = inner[id(node)] > inner[id(root)] / 2
            node.dropped = not most or articles > around[id(node)]
            if node.dropped and node.prose:
                node.dropped = inner[id(node)] < PROSE_SHARE * of_article[id(node)]


def scored(root: Node) -> list[Node]:
    """Containers with points."""
    containers: dict[int, Node] = {}
    for block in gathered(root)[1]:
        if block.own < 1 or block.tag not in PARAGRAPHS:
            continue
        up, share = (block if block.tag in ("div", "section", "article", "main", "body") else block.around), 1.0
        own = points(block)
        while up is not None and share > 0.05:
            up.score += own * share
            containers[id(up)] = up
            share /= 2
            up = up.around
    return list(containers.values())


def chosen(root: Node) -> list[str | Node | None]:
    """The nodes whose text is the article, in page order; None ends a block."""
    drop_named(root)
    containers = scored(root)
    if not containers:
        return [root]
    top = max(containers, key=lambda node: node.score)
    up, whole = top, None
    while up is not None:
        if up.tag in ("article", "main"):
            whole = up
        up = up.parent
    if whole is not None:
        outer = whole.parent
        return [x for x in outer.parts if isinstance(x, Node) and x.tag == whole.tag and not x.dropped and (x is whole or few_links([x]))]
    # what is kept before and after, from the inside out
    before: list[str | Node | None] = []
    after: list[str | Node | None] = []
    first, way = True, top
    while way.parent is not None and way.tag not in ("body", "html"):
        own, passed = [[], []], False
        for run in runs(way.parent.parts):
            if way in run:
                passed = True
                at = run.index(way)
                own[0] += run[:at]
                own[1] += run[at + 1 :]
            elif few_links(run) and (first or stays(run)):
                own[passed] += run
        if own[0]:
            before += [None, *reversed(own[0])]
        if own[1]:
            after += [None, *own[1]]
        way, first = way.parent, False
    return [*reversed(before), top, *after]


def stays(run: list[str | Node]) -> bool:
    """Whether what stands beside the way up from the best container is of its article: it has a paragraph, or the title."""
    for x in run:
        if isinstance(x, Node) and not x.dropped:
            nodes, blocks = gathered(x)
            if any(points(block) >= BESIDE_POINTS for block in blocks) or any(node.tag == "h1" for node in nodes):
                return True
    return False


def runs(parts: list[str | Node]) -> list[list[str | Node]]:
    """Blocks by themselves; text and inline elements that follow each other together, as they are one text."""
    out: list[list[str | Node]] = []
    inline = False
    for x in parts:
        block = isinstance(x, Node) and x.tag in BLOCKS and x.tag != "br"
        if block or not inline:
            out.append([])
        out[-1].append(x)
        inline = not block
    return out


def few_links(nodes: list[str | Node]) -> bool:
    size = links = 0
    stack: list[tuple[str | Node, bool]] = [(x, False) for x in nodes]
    while stack:
        x, link = stack.pop()
        if isinstance(x, str):
            size += len(x.strip())
            links += len(x.strip()) * link
        elif not x.dropped:
            link = link or x.tag == "a"
            stack += [(part, link) for part in x.parts]
    return links < MOST_LINKS * size or not size


def text_of(nodes: list[str | Node | None]) -> str:
    blocks: list[list[str]] = [[]]
    stack: list[str | Node | None] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(entities.unescape(x))
        elif not x.dropped:
            edge = [None] if x.tag in BLOCKS else []
            stack += [*edge, *reversed(x.parts), *edge]
    joined = (" ".join("".join(b).split()) for b in blocks if b)
    return " ".join(b for b in joined if b)


def main_text(page: str) -> str:
    return text_of(chosen(parse(page))) if page else ""


def html_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of every row."""

    def run(batches):
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(batch, last):
                out = [main_text(page) for page in texts_of(part, last)]
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*names, "text", "n_chars"])

    source = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_col).cast("string").alias("html"))
    names = [f"k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    out = source.mapInArrow(run, f"{kinds}{', ' if kinds else ''}text string, n_chars long")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "text", "n_chars")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))
