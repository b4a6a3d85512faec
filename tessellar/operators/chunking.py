"""Sequential packing of text into chunks: each algorithm is one Arrow-batched pass over documents."""

from __future__ import annotations

import bisect
import html
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNIT = re.compile(r"\n+|(?<=[.!?])(?<!\d[.!?])\s+")
#: Break marks in order of preference; fixed values.
BREAKS = ("\n\n", "\n", "다. ", "요. ", ". ", "。", "; ", ", ", " ")


def sentence_units(text: str) -> list[str]:
    """Pieces that end at newlines or after a closing mark that follows no digit; joined, they are the text."""
    cuts = [0, *(m.end() for m in _UNIT.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Fixed windows for what has no boundary to split at. A last window inside the one before is left out."""
    out = []
    for at in range(0, max(len(text), 1), size - overlap):
        part = text[at : at + size].strip()
        if part:
            out.append(part)
        if at + size >= len(text):
            break
    return out


def pack_sentences(text: str, size: int = 600, overlap: int = 100) -> list[str]:
    """Whole units up to the size; the next chunk starts with the last whole units that fit the overlap.

    Works on the units' places in the text: a chunk is the text between two of them.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    text = text.strip()
    ends = list(accumulate(map(len, sentence_units(text)), initial=0))
    out, first, reached, last = [], 0, 0, len(ends) - 1
    while first < last:
        # as many units as fit, one at least
        to = last if len(text) <= size else max(first + 1, bisect.bisect_right(ends, ends[first] + size) - 1)
        to = max(to, reached + 1)  # what is new must come with it, even beyond the size
        out += windows(text[ends[first] : ends[to]].strip(), size, overlap)
        if to == last:
            break
        reached = to
        first = bisect.bisect_left(ends, ends[to] - overlap)
    return out


def pack_rows(header: str, rows: list[str], size: int = 600) -> list[str]:
    """Table rows in groups up to the size, each under the header."""
    room = size - len(header)
    ends = list(accumulate((len(r) + 1 for r in rows), initial=0))
    out, first = [], 0
    while first < len(rows):
        to = max(first + 1, bisect.bisect_right(ends, ends[first] + room) - 1)
        out += windows("\n".join([header, *rows[first:to]]), size, 0)
        first = to
    return out


def pack_section(blocks: list[dict], size: int = 600, overlap: int = 100) -> list[str]:
    """Runs of text blocks together, tables by themselves, in order."""
    out: list[str] = []
    run: list[str] = []
    for block in [*blocks, None]:
        if block is not None and block["type"] == "text":
            run.append(block["text"])
            continue
        if run:
            out += pack_sentences("\n".join(run), size, overlap)
            run = []
        if block is not None:
            out += pack_rows(block["header"], block["rows"], size)
    return out


def normalised(text: str) -> str:
    """NFKC, inner white space squeezed, newlines kept (two at most)."""
    text = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n")
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


class Marks:
    """Where a text may be broken: for each mark, in order of preference, the places behind it."""

    def __init__(self, text: str, marks: tuple[str, ...] = BREAKS):
        self.behind = [(len(m), [x.end() for x in re.finditer(re.escape(m), text)]) for m in marks]

    def best(self, start: int, least: int, most: int) -> int:
        """The last place in [least, most] behind the first mark that has one, all of it after start; else most."""
        for width, places in self.behind:
            k = bisect.bisect_right(places, most) - 1
            if k >= 0 and places[k] >= max(least, start + width):
                return places[k]
        return most


def cuts(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of windows of at most size that end behind a mark in their last two fifths if one is there;
    each next one starts at the first solid character of the overlap."""
    marks, solid, n = Marks(text), re.compile(r"\S"), len(text)
    start = end = 0
    while end < n:
        if n - start <= size:
            end = n
        else:
            end = marks.best(start, start + max(1, 3 * size // 5), start + size)
        yield start, end
        found = solid.search(text, max(start + 1, end - overlap), end)
        start = found.start() if found else end


def split_at_marks(text: str, size: int, overlap: int) -> list[str]:
    """The normalised text in overlapping pieces that end at the best marks; blank pieces are left out."""
    text = normalised(text)
    return [piece for a, b in cuts(text, size, overlap) if (piece := text[a:b].strip())]


def with_header(header: str, body: str, size: int = 900, overlap: int = 120, mark: str = "\n[내용] ") -> list[str]:
    """Every piece under the metadata header; a header that leaves under 160 characters is an error."""
    room = size - len(header) - len(mark)
    if room < 160:
        raise ValueError("the header leaves too little room")
    pieces = split_at_marks(body, room, min(overlap, room - 1))
    return [header + mark + p for p in pieces] or [header]


def chunked(documents: DataFrame, pack: Callable[[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, content, content_hash) of every document's chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            yield pd.DataFrame({"id": own["id"], "chunks": [pack(t) if isinstance(t, str) else [] for t in own["text"]]})

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    rows = source.mapInPandas(run, f"id {kind}, chunks array<string>")
    return rows.select("id", F.posexplode("chunks").alias("chunk_index", "content")).withColumn("content_hash", F.sha2("content", 256)).withColumnRenamed("id", id_col)


def section_paths(headings: list[tuple[int, str]]) -> list[list[str]]:
    """The path of titles above and at each (level, title)."""
    out, stack = [], []
    for level, title in headings:
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        out.append([t for _, t in stack])
    return out


def _runs(batch: pa.RecordBatch, document: str) -> Iterator[tuple[tuple, int, int]]:
    """((document, piece), first row, row after the last) of each run of equal ones."""
    cuts = sorted({0}.union(*(pc.run_end_encode(batch[c]).run_ends.to_pylist() for c in (document, "__piece")))) if batch.num_rows else []
    for start, end in zip(cuts, cuts[1:]):
        yield (batch[document][start].as_py(), batch["__piece"][start].as_py()), start, end


def _levels(batch: pa.RecordBatch) -> list:
    """A missing level is NaN: it closes no heading, and none closes it."""
    own = batch["level"]
    return [math.nan if x is None else x for x in own.to_pylist()] if own.null_count else own.to_numpy(zero_copy_only=False).tolist()


def _close(stack: list[tuple], level: float) -> None:
    while stack and stack[-1][0] >= level:
        stack.pop()


def with_section_paths(headings: DataFrame, document: str, order: str, size: int = 1_000_000) -> DataFrame:
    """headings (document, order, level, title) with path.

    Headings of equal order follow each other by level, then title. A document of over about `size` headings is cut
    by their order into pieces, and tasks read pieces as a stream, so neither is held whole. What is open where a
    piece ends is a few titles; carried from piece to piece, they go above the paths of the next. Only documents that
    are cut are read twice. Cuts come from a sample, by a hash of the rows: it decides how even the pieces are, nothing else.
    """
    each = 100  # rows of the sample to a piece
    last = lambda c: F.struct(F.col(c).isNull(), F.col(c))  # noqa: E731  as nulls come last
    place = F.struct(last(order), last("level"), last("title"))
    sample = headings.where(F.pmod(F.xxhash64(document, order, "level", "title"), F.lit(max(size // each, 1))) == 0)
    places = sample.groupBy(F.col(document).alias("__of")).agg(F.sort_array(F.collect_list(place)).alias("__places"))
    cuts = places.where(F.size("__places") > each).select("__of", F.array_distinct(F.filter("__places", lambda _, i: (i > 0) & (i % each == 0))).alias("__cuts"))
    piece = F.coalesce(F.size(F.filter("__cuts", lambda c: c <= place)), F.lit(-1))
    dealt = lambda how: headings.join(F.broadcast(cuts), F.col(document).eqNullSafe(F.col("__of")), how).withColumn("__piece", F.when(F.col("__cuts").isNull(), -1).otherwise(piece)).drop("__of", "__cuts")
    ordered = lambda rows: rows.repartition(document, "__piece").sortWithinPartitions(document, "__piece", *(F.col(c).asc_nulls_last() for c in (order, "level", "title")))
    kind = {f.name: f.dataType.simpleString() for f in headings.schema.fields}
    outline = f"`{document}` {kind[document]}, __piece int, __open array<struct<level: {kind['level']}, title: {kind['title']}>>"

    def own_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack, kept = None, [], []  # (level, place of the title): in what was open before the batch, then in the batch
        for batch in batches:
            titles = pa.concat_arrays([pa.array(kept, batch["title"].type), batch["title"]])
            stack = [(level, i) for i, (level, _) in enumerate(stack)]
            flat, ends, lowest, levels, before = [], [0], [], _levels(batch), len(kept)
            for key, start, end in _runs(batch, document):
                if key != at:
                    at, stack = key, []
                for i in range(start, end):
                    level = levels[i]
                    while stack and stack[-1][0] >= level:
                        stack.pop()
                    stack.append((level, before + i))
                    flat.extend([x for _, x in stack])
                    ends.append(len(flat))
                    lowest.append(stack[0][0])
            paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), titles.take(pa.array(flat, pa.int64())))
            kept = [titles[i].as_py() for _, i in stack]
            yield pa.RecordBatch.from_arrays([*batch.columns, paths, pa.array(lowest, batch["level"].type, from_pandas=True)], [*batch.schema.names, "path", "__lowest"])

    def listed(found: list[tuple[tuple, list[tuple]]], of: pa.DataType, level: pa.DataType, title: pa.DataType) -> pa.RecordBatch:
        opened = [[{"level": None if x != x else x, "title": t} for x, t in stack] for _, stack in found]
        columns = [pa.array([k[0] for k, _ in found], of), pa.array([k[1] for k, _ in found], pa.int32()), pa.array(opened, pa.list_(pa.struct([("level", level), ("title", title)])))]
        return pa.RecordBatch.from_arrays(columns, [document, "__piece", "__open"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack, kinds = None, [], ()
        for batch in batches:
            kinds, found, levels = (batch[document].type, batch["level"].type, batch["title"].type), [], _levels(batch)
            for key, start, end in _runs(batch, document):
                if key != at:
                    if at is not None:
                        found.append((at, stack))
                    at, stack = key, []
                new = []  # (level, row), as far as what was open before the batch is not closed
                for i in range(start, end):
                    level = levels[i]
                    while new and new[-1][0] >= level:
                        new.pop()
                    if not new:
                        _close(stack, level)
                    new.append((level, i))
                stack += [(level, batch["title"][i].as_py()) for level, i in new]
            if found:
                yield listed(found, *kinds)
        if at is not None:
            yield listed([(at, stack)], *kinds)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, stack = None, []
        for batch in batches:
            found = []
            inner = batch["__open"].type.value_type
            for name, number, opened in zip(*(batch[c].to_pylist() for c in (document, "__piece", "__open")), strict=True):
                if (name,) != of:
                    of, stack = (name,), []
                found.append(((name, number), stack))
                own = [(math.nan if x["level"] is None else x["level"], x["title"]) for x in opened]
                stack = list(stack)
                _close(stack, own[0][0])
                stack += own
            yield listed(found, batch[document].type, inner.field("level").type, inner.field("title").type)

    by_piece = ordered(dealt("inner")).mapInArrow(ends, outline).repartition(document).sortWithinPartitions(document, "__piece").mapInArrow(carried, outline)
    before = by_piece.where(F.size("__open") > 0).select(F.col(document).alias("__of"), F.col("__piece").alias("__next"), "__open")
    fields = ", ".join(f"`{c}` {t}" for c, t in kind.items())
    own = ordered(dealt("left")).mapInArrow(own_paths, f"{fields}, __piece int, path array<{kind['title']}>, __lowest {kind['level']}")
    both = own.join(F.broadcast(before), F.col(document).eqNullSafe(F.col("__of")) & (F.col("__piece") == F.col("__next")), "left")
    stays = F.array_max(F.transform("__open", lambda x, i: F.when(F.coalesce(x["level"] < F.col("__lowest"), F.lit(True)), i + 1).otherwise(0)))
    above = F.transform(F.slice("__open", F.lit(1), stays), lambda x: x["title"])
    return both.withColumn("path", F.when(F.col("__open").isNull(), F.col("path")).otherwise(F.concat(above, "path"))).select(*headings.columns, "path")


def merge_fragments(lines: list[tuple[str, float, float, float]], aligned: float = 1.5, gap: float = 3.0) -> list[str]:
    """Texts of (text, x, top, bottom) lines, with stacks of one or two characters joined downwards."""
    out: list[list] = []
    for text, x, top, bottom in lines:
        last = out[-1] if out else None
        if last and len(text) <= 2 and last[4] and abs(last[1] - x) <= aligned and 0 <= top - last[3] <= gap:
            last[0] += text
            last[3] = bottom
        else:
            out.append([text, x, top, bottom, len(text) <= 2])
    return [t for t, *_ in out]


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        span = {k: int(v) if v and v.isdigit() else 1 for k, v in attrs if k in ("rowspan", "colspan")}
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = ["", span.get("rowspan", 1), span.get("colspan", 1)]
        elif tag == "br" and self.cell:
            self.cell[0] += " "

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell:
            self.tables[-1][-1].append((" ".join(self.cell[0].split()), max(self.cell[1], 1), max(self.cell[2], 1)))
            self.cell = None

    def handle_data(self, data):
        if self.cell:
            self.cell[0] += data


def table_records(page: str, most: int = 200) -> list[dict[str, str]]:
    """Records of every table, spans expanded, keyed by the first row; blank rows and cells are left out."""
    parser = _Tables()
    parser.feed(page)
    out: list[dict[str, str]] = []
    for rows in parser.tables:
        grid: list[dict[int, str]] = [{} for _ in rows]
        for y, row in enumerate(rows):
            x = 0
            for text, down, across in row:
                while x in grid[y]:
                    x += 1
                for dy in range(min(down, len(rows) - y)):
                    for dx in range(min(across, 100)):
                        grid[y + dy].setdefault(x + dx, text)
                x += across
        if len(grid) < 2:
            continue
        names = [grid[0].get(x, "") or f"column_{x + 1}" for x in range(max(grid[0], default=-1) + 1)]
        for row in grid[1:]:
            record = {n: row[x] for x, n in enumerate(names) if row.get(x)}
            if record:
                out.append(record)
    return out[:most]


def block_contents(value) -> Iterator[str]:
    """Every block_content text with a table, anywhere in decoded JSON."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            own = x.get("block_content")
            if isinstance(own, str) and "<table" in own:
                yield html.unescape(own) if "&lt;table" in own else own
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)
