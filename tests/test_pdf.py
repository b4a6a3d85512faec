"""Made PDFs come back as their sources; broken ones are one error row."""

import zlib

import pytest

from tessellar.operators import layout
from tessellar.sources.pdf import chapters, pdf_lines, pdf_outline, pdf_pages
from tessellar.sources.pdf_objects import Pdf, Reader, lines, spans


def stream(raw, entries="", packed=True):
    body = zlib.compress(raw) if packed else raw
    return b"<< /Length %d %s %s >>\nstream\n" % (len(body), b"/Filter /FlateDecode" if packed else b"", entries.encode()) + body + b"\nendstream"


def shown(text, x, y, size, font="F1"):
    raw = text.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return b"BT /%s %g Tf 1 0 0 1 %g %g Tm (%s) Tj ET\n" % (font.encode(), size, x, y, raw)


def objects(pages, marks=()):
    """Objects by number of a file with pages (lists of shown calls' arguments) and bookmarks (level, title, page)."""
    out = {1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 5 0 R /Names << /Dests << /Kids [ 6 0 R ] >> >> >>"}
    out[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Sans-Bold /Encoding /WinAnsiEncoding >>"
    out[4] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Sans /FirstChar 32 /Widths [ 250 ] /Encoding << /Differences [ 65 /Eacute /uniAC00 /fi ] >> >>"
    kids = []
    for k, page in enumerate(pages):
        out[20 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (21 + 2 * k)
        out[21 + 2 * k] = stream(b"".join(shown(*args) for args in page), packed=k % 2 == 0)
        kids.append(b"%d 0 R" % (20 + 2 * k))
    out[2] = b"<< /Type /Pages /MediaBox [0 0 600 800] /Resources << /Font << /F1 4 0 R /B 3 0 R /P 4 0 R >> >> /Kids [ %s ] /Count %d >>" % (b" ".join(kids), len(pages))
    first = {}
    tops = [k for k, m in enumerate(marks) if m[0] == 1]
    for k, (level, title, page) in enumerate(marks):
        after = [j for j in range(k + 1, len(marks)) if marks[j][0] <= level]
        after = after[0] if after and marks[after[0]][0] == level else None
        below = k + 1 if k + 1 < len(marks) and marks[k + 1][0] > level else None
        goal = b"/Dest [ %d 0 R /Fit ]" % (20 + 2 * (page - 1)) if k % 3 == 0 else b"/A << /S /GoTo /D (to%d) >>" % page if k % 3 == 1 else b"/Dest (to%d)" % page
        out[100 + k] = b"<< /Title <%s> %s %s %s >>" % ((b"\xfe\xff" + title.encode("utf-16-be")).hex().encode(), goal, b"/Next %d 0 R" % (100 + after) if after else b"", b"/First %d 0 R" % (100 + below) if below else b"")
    if tops:
        first = b"/First %d 0 R" % (100 + tops[0])
    out[5] = b"<< %s >>" % (first or b"")
    out[6] = b"<< /Names [ %s ] >>" % b" ".join(b"(to%d) [ %d 0 R /Fit ]" % (p + 1, 20 + 2 * p) for p in range(len(pages)))
    return out


def table_file(objs):
    data, places = b"%PDF-1.4\n", {}
    for n, body in objs.items():
        places[n] = len(data)
        data += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at, top = len(data), max(objs) + 1
    rows = b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(top))
    return data + b"xref\n0 %d\n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (top, rows, top, at)


def stream_file(objs):
    """The same with object streams and a cross-reference stream with PNG prediction."""
    data, rows = b"%PDF-1.5\n", {}
    packed = [n for n, body in objs.items() if b"stream" not in body]
    for n in (n for n in objs if n not in packed):
        rows[n] = (1, len(data), 0)
        data += b"%d 0 obj\n%s\nendobj\n" % (n, objs[n])
    holder, heads, body = max(objs) + 1, [], b""
    for k, n in enumerate(packed):
        heads.append(b"%d %d" % (n, len(body)))
        body += objs[n] + b" "
        rows[n] = (2, holder, k)
    head = b" ".join(heads) + b" "
    rows[holder] = (1, len(data), 0)
    data += b"%d 0 obj\n%s\nendobj\n" % (holder, stream(head + body, f"/Type /ObjStm /N {len(packed)} /First {len(head)}"))
    own = holder + 1
    rows[own] = (1, len(data), 0)
    raw, above = b"", bytes(6)
    for n in range(own + 1):
        kind, a, b = rows.get(n, (0, 0, 0))
        row = bytes([kind]) + a.to_bytes(4, "big") + bytes([b])
        raw += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
        above = row
    at = len(data)
    data += b"%d 0 obj\n%s\nendobj\n" % (own, stream(raw, f"/Type /XRef /W [1 4 1] /Size {own + 1} /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 6 >>"))
    return data + b"startxref\n%d\n%%%%EOF" % at


PAGES = [
    [("Preface line (one)", 50, 700, 10), ("Safety first", 50, 650, 12, "B"), ("Wear \\ gloves", 50, 620, 10), ("été", 50, 600, 10)],
    [("More of it", 50, 700, 10), ("1. ", 50, 680, 12, "B"), ("Next heading", 50, 650, 12, "B"), ("Last heading", 50, 600, 12, "B"), ("The end", 50, 580, 10)],
    [],
]
MARKS = [(1, "﻿ 1. 정격", 1), (2, "1.1 part", 1), (1, "2. Second", 2), (1, "  ", 2), (2, "2.1", 3), (1, "Third", 3)]
TEXTS = ["Preface line (one)\nSafety first\nWear \\ gloves\nété", "More of it\n1.\nNext heading\nLast heading\nThe end", ""]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("pdf")
    plain = table_file(objects(PAGES, MARKS))
    (top / "table.pdf").write_bytes(plain)
    (top / "stream.pdf").write_bytes(stream_file(objects(PAGES, MARKS)))
    (top / "cut.pdf").write_bytes(plain[: plain.rindex(b"xref\n0")] + b"trailer << /Root 1 0 R >>")  # no table: searched
    (top / "wrong.pdf").write_bytes(plain.replace(b"startxref\n", b"startxref\n9"))
    (top / "junk.pdf").write_bytes(b"no PDF at all")
    (top / "locked.pdf").write_bytes(plain.replace(b"/Root 1 0 R >>", b"/Root 1 0 R /Encrypt << /V 1 >> >>"))
    (top / "big.pdf").write_bytes(b"%PDF-1.4" + b" " * 100_000)
    return str(top)


def test_pages_equal_their_sources(spark, folder):
    rows = {}
    for r in pdf_pages(spark, folder, most_bytes=90_000).collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append((r.page, r.text, r.error))
    for name in ("table.pdf", "stream.pdf", "cut.pdf", "wrong.pdf"):
        assert sorted(rows[name]) == [(k, t, None) for k, t in enumerate(TEXTS, 1)], name
    for name, said in (("junk.pdf", "not a PDF"), ("locked.pdf", "encrypted"), ("big.pdf", "over the limit")):
        (page, text, error), = rows[name]
        assert page is None and text is None and said in error
    limited = pdf_lines(spark, folder + "/table.pdf", most_pages=2).collect()
    assert len(limited) == 1 and "3 pages" in limited[0].error


def test_chapters_equal_their_sources(spark, folder):
    found = chapters(pdf_outline(spark, folder)).collect()
    for name in ("table.pdf", "stream.pdf", "cut.pdf"):
        got = sorted((r.start_page, r.title, r.end_page) for r in found if r.path.endswith(name))
        assert got == [(1, "1. 정격", 1), (2, "2. Second", 2), (3, "Third", 10**9)]
    levels = sorted((r.place, r.level, r.title, r.page) for r in pdf_outline(spark, folder).collect() if r.path.endswith("table.pdf"))
    assert [x[1:] for x in levels] == MARKS


def test_sections(spark, folder):
    rows = layout.with_headings(pdf_lines(spark, folder + "/table.pdf").where("line is not null"))
    merged = layout.merge_vertical(rows, ["path"])
    got = [(r.header, r.start_page, r.end_page, r.blocks) for r in layout.sections(merged, ["path"]).orderBy("section").collect()]
    assert got == [(layout.PREFACE, 1, 1, ["Preface line (one)"]), ("Safety first", 1, 2, ["Wear \\ gloves", "été", "More of it", "1."]), ("Last heading", 2, 2, ["The end"])]


def test_fonts_and_operators():
    cmap = b"1 beginbfchar <0001> <AC00> endbfchar 1 beginbfrange <0002> <0004> <0041> endbfrange 1 beginbfrange <0005> <0006> [<00660066> <D83DDE00>] endbfrange"
    objs = objects([[]])
    objs[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /K /Encoding /Identity-H /DescendantFonts [ 7 0 R ] /ToUnicode 8 0 R >>"
    objs[4] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Sans /FirstChar 32 /Widths [ 250 ] /Encoding << /Differences [ 65 /Eacute /uniAC00 /fi /Ccedilla ] >> >>"
    objs[7] = b"<< /Subtype /CIDFontType2 /DW 1000 /W [ 1 [ 600 700 ] 3 5 800 ] >>"
    objs[8] = stream(cmap)
    objs[9] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Old /Encoding /KSCms-UHC-H /DescendantFonts [ 7 0 R ] >>"
    objs[10] = stream(b"BT /F1 10 Tf 5 5 Td (BD) Tj ET", "/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 100]")
    content = b"q 2 0 0 2 0 0 cm BT /B 10 Tf 12 TL 10 300 Td <00010002> Tj T* <000500060003> Tj ET Q BT /F1 10 Tf 50 200 Td [ (A) -2000 (B) 0 (C) ] TJ 0 -20 Td /O 10 Tf (" + "안전 수칙".encode("cp949").replace(b"\\", b"\\\\") + b") Tj ET BI /W 1 ID \x00(\xff EI /X Do"
    objs[21] = stream(content)
    objs[2] = objs[2].replace(b"/P 4 0 R >>", b"/O 9 0 R >> /XObject << /X 10 0 R >>")
    pdf = Pdf(table_file(objs))
    (page, _), = pdf.pages()
    found = list(lines(spans(pdf, page)))
    assert [s.text for s in found] == ["가A", "ff😀B", "É 가fi", "안전 수칙", "가Ç"]
    assert (found[0].x0, found[0].size, round(found[0].x1, 6)) == (20, 20, 20 + 2 * 10 * 1.3) and found[0].y0 == 800 - 600 - 16
    assert found[4].x0 == 105


def test_reader():
    assert Reader(b"<< /A [1 -.5 (a\\(b\\051\\n(c)) <4 1>] % no\n /B#20c 7 0 R /N null /T true >>").next() == {"A": [1, -0.5, b"a(b)\n(c)", b"A"], "B c": (7,), "N": None, "T": True}
    assert Reader(b"[ (]) (null) ]").next() == [b"]", b"null"]


def brute_merge(rows, x_tol=1.5, y_tol=3.0):
    out, i = [], 0
    while i < len(rows):
        run = [rows[i]]
        while len(run[0][2]) <= 2 and run[0][3] is not None and i + len(run) < len(rows):
            a, b = run[-1], rows[i + len(run)]
            if len(b[2]) > 2 or b[3] is None or b[0] != a[0] or abs(b[3] - a[3]) >= x_tol or abs(b[4] - a[5]) >= y_tol:
                break
            run.append(b)
        out.append((rows[i][0], run[0][1], "".join(r[2] for r in run), rows[i][6] and len(run) == 1))
        i += len(run)
    return out


def test_vertical_fragments_by_loops(spark):
    import random

    rng = random.Random(3)
    rows = []
    for k in range(400):
        y = rng.choice([10.0, 12.0, 20.0, 22.0])
        rows.append((k // 40, k, rng.choice(["주", "회로", "abc", "x", ""]), rng.choice([None, 1.0, 1.0, 2.0, 2.6]), y, y + rng.choice([0.0, 2.0, 10.0]), rng.random() < 0.3))
    df = spark.createDataFrame([("f", *r) for r in rows], "path string, page int, line int, text string, x0 double, y0 double, y1 double, is_header boolean")
    got = sorted((r.page, r.line, r.text, r.is_header) for r in layout.merge_vertical(df, ["path"]).collect())
    assert got == sorted(brute_merge(rows)) and any(len(r[2]) > 4 for r in got)
