"""Line numbers over many splits, tables kept twice, replacement by document, request budgets, JSON of any shape."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessellar.operators import answers, nested
from tessellar.sources import files, paged


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    lines = [["{}", "", '{"id": %d}', "x" * (k * 37 % 400), "한글 %d", "[1]"][k % 6].replace("%d", str(k)) for k in range(2000)]
    lines[700] = "y" * 9000  # longer than several splits
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("\r\n".join(lines[:48]), encoding="utf-8")
    (tmp_path / "c.jsonl").write_text("")
    found = files.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 30
    got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in found.collect()}
    assert got == {("a.jsonl", k): v for k, v in enumerate(lines, 1)} | {("b.jsonl", k): v for k, v in enumerate(lines[:48], 1)}
    errors = {(r.file.rsplit("/", 1)[1], r.line): r.error for r in files.jsonl_errors(spark, str(tmp_path)).collect()}
    wrong = {k: "expected a JSON object" if v == "[1]" else "invalid JSON" for k, v in enumerate(lines, 1) if v and not v.startswith("{")}
    assert errors == {("a.jsonl", k): e for k, e in wrong.items()} | {("b.jsonl", k): e for k, e in wrong.items() if k <= 48}


def test_tables_kept_twice(spark, tmp_path):
    schema = files.T.StructType().add("id", files.T.StringType()).add("n", files.T.IntegerType())
    load = lambda: files.load_table(spark, str(tmp_path / "t.csv"), str(tmp_path / "t.jsonl"), schema, "id")
    assert load().collect() == [] and load().columns == ["id", "n"]
    (tmp_path / "t.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n')
    assert sorted(tuple(r) for r in load().collect()) == [("a", 1), ("b", None)]
    (tmp_path / "t.csv").write_text("﻿n,id\n1,a\n,b\n", encoding="utf-8")
    assert sorted(tuple(r) for r in load().collect()) == [("a", 1), ("b", None)]
    (tmp_path / "t.csv").write_text("n,id\n2,a\n,b\n")
    with pytest.raises(ValueError, match="differ"):
        load()
    (tmp_path / "t.jsonl").unlink()
    (tmp_path / "t.csv").write_text("n,id\n2,a\n3, \n")
    with pytest.raises(ValueError, match="empty in 1 rows"):
        load()


def test_replacement_touches_only_the_documents_folders(spark, tmp_path):
    schema = "document_id string, part int, text string"
    path = str(tmp_path / "chunks")
    held = {f"d{k}": [f"old {k} {p}" for p in range(3)] for k in range(40)}
    rows = lambda docs: spark.createDataFrame([(d, p, t) for d, ts in docs.items() for p, t in enumerate(ts)], schema)
    stored = lambda: sorted((r.document_id, r.part, r.text) for r in spark.read.parquet(path).collect())
    expect = lambda: sorted((d, p, t) for d, ts in held.items() for p, t in enumerate(ts))
    names = lambda: {str(p.relative_to(path)) for p in (tmp_path / "chunks").rglob("*.parquet")}
    assert files.replace_documents(spark, rows(held), path, ["document_id", "part"], buckets=8) == 120
    assert stored() == expect()
    before = names()
    new = {"d3": ["new"], "fresh": ["a", "b"]}
    held |= new
    del held["d5"]
    gone = spark.createDataFrame([("d5",), ("unknown",)], "document_id string")
    files.replace_documents(spark, rows(new), path, ["document_id", "part"], gone=gone, buckets=8)
    assert stored() == expect()
    touched = {n.split("/")[0] for n in before ^ names()}
    assert 1 <= len(touched) <= 4 and any(n in names() for n in before)
    for bad, said in (({"d3": ["x"], None: ["y"]}, "null"), ({}, None)):
        if said:
            with pytest.raises(ValueError, match=said):
                files.replace_documents(spark, rows(bad), path, ["document_id", "part"], buckets=8)
    with pytest.raises(ValueError, match="repeated"):
        files.replace_documents(spark, rows({"d3": ["x"]}).union(rows({"d3": ["y"]})), path, ["document_id", "part"], buckets=8)
    assert stored() == expect()
    files.replace_documents(spark, rows({}), path, ["document_id", "part"], gone=spark.createDataFrame([(d,) for d in held], "document_id string"), buckets=8)
    assert not names() and not [p for p in tmp_path.iterdir() if ".new-" in p.name]


def test_a_first_table_goes_when_publishing_is_undone(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "n int")
    path = f"{tmp_path}/pub"
    files.publish(spark, {"a": one}, path)
    # as if a crash had come after a new table was put in place
    (tmp_path / "pub/.former").mkdir()
    (tmp_path / "pub/.former/.none-b").mkdir()
    one.write.parquet(f"{path}/b")
    assert files.recover(spark, path) == [] and not (tmp_path / "pub/b").exists()
    assert spark.read.parquet(f"{path}/a").count() == 1


@pytest.fixture
def failing():
    """A service of 40 items that answers the first request and fails every third one after it."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            bad = failing_all[0] and q["s"] != 1 or len(asked) % 3 == 0
            self.send_response(503 if bad else 200)
            self.end_headers()
            own = [{"n": i} for i in range((q["p"] - 1) * q["s"], min(q["p"] * q["s"], 40))]
            self.wfile.write(json.dumps({"response": {"body": {"items": {"item": own}, "totalCount": 40}}}).encode())

        def log_message(self, *args):
            pass

    failing_all = [False]
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/?p={{page}}&s={{size}}", asked, failing_all
    server.shutdown()


def test_requests_stay_within_the_budget(spark, failing):
    url, asked, all_fail = failing
    spark.dataSource.register(paged.PagedSource)
    read = lambda **o: spark.read.format("paged").options(url=url, pagesize="5", pagespertask="2", waits="0,0,0", reportbudget="true", **o).load()
    rows = read(maxrequests="30", onincomplete="keep").collect()
    asked_now = len(asked)
    assert asked_now <= 31 and sorted(json.loads(r.item)["n"] for r in rows if r.page) == list(range(40))
    asked.clear()
    all_fail[0] = True
    crawl = read(maxrequests="9", onincomplete="keep")
    crawl.write.mode("overwrite").format("noop").save()
    assert 1 < len(asked) <= 9
    asked.clear()
    used = paged.budget_left(crawl).first()
    assert len(asked) <= 9 and used.used <= 8 and used.left >= 0 and used.used + used.left == 8 and used.stopped == 4
    assert paged.crawl_stats(crawl, 40, 5).first().fetched == 0
    with pytest.raises(paged.BudgetSpent):
        paged.fetch(url.format(page=1, size=5), waits=(0, 0, 0), sleep=lambda s: None, budget=paged.Budget(2))


@given(st.integers(0, 200), st.lists(st.integers(0, 9), min_size=1, max_size=12))
def test_shares(most, weights):
    dealt = paged.shares(most, weights)
    assert sum(dealt) == (most if sum(weights) else min(most, len(weights))) and all(d >= most * w // max(sum(weights), 1) for d, w in zip(dealt, weights, strict=True))


def collected_by_recursion(value, name="evidence_chunk_ids"):
    out = set()
    if isinstance(value, dict):
        for k, x in value.items():
            if k == name and isinstance(x, list):
                out |= {x_ if isinstance(x_, str) else json.dumps(x_, separators=(",", ":"), sort_keys=True) for x_ in x if x_}
            else:
                out |= collected_by_recursion(x, name)
    elif isinstance(value, list):
        for x in value:
            out |= collected_by_recursion(x, name)
    return out


def tables_by_recursion(value):
    if isinstance(value, dict):
        for k, x in sorted(value.items()):
            if k == "block_content" and isinstance(x, str) and "<table" in x:
                yield x.replace('\\"', '"')
            else:
                yield from tables_by_recursion(x)
    elif isinstance(value, list):
        for x in value:
            yield from tables_by_recursion(x)


def any_value(rng, depth=0):
    kind = rng.randrange(10 if depth < 6 else 6)
    if kind < 6:
        return [None, rng.random() < 0.5, rng.randrange(4), rng.choice(["", "id1", "id2"]), '<table a=\\"1\\">', "x<table>"][kind]
    if kind < 8:
        return [any_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["evidence_chunk_ids", "block_content", "a", "b"]): any_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_json_walk_equals_recursion(spark):
    rng = random.Random(9)
    values = [any_value(rng) for _ in range(600)]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)] + [(-1, None), (-2, "{broken")], "id int, doc string")
    want = {k: sorted(s) for k, v in enumerate(values) if (s := {x for x in collected_by_recursion(v) if x not in ("0",)})}
    got = {r["id"]: r["ids"] for r in nested.collected(df, "id", "doc").collect()}
    assert got == want
    assert len(want) > 8
    tables = {k: t for k, v in enumerate(values) if (t := list(tables_by_recursion(v)))}
    found = {}
    for r in nested.block_tables(df, "id", "doc").orderBy("id", "pos").collect():
        found.setdefault(r["id"], []).append(r.html)
    assert found == tables


def test_deep_json_is_an_error_not_a_cut(spark):
    df = spark.createDataFrame([(1, "[" * 12 + "]" * 12)], "id int, doc string")
    assert nested.json_walk(df, "id", "doc").count() == 12
    with pytest.raises(Exception, match="deeper than 5"):
        nested.json_walk(df, "id", "doc", deepest=5).count()


def test_citations_without_sources(spark):
    df = spark.createDataFrame([(1, "x [1] y [ 03 ] [99999999999999999999] [a]"), (2, None), (3, "none"), (4, "[1][2]")], "id int, answer string")
    sent = spark.createDataFrame([(1, 1, "c"), (1, 3, "d"), (4, 1, "z"), (4, 2, "y")], "id int, pos int, chunk_id string")
    sources = spark.createDataFrame([(1, 7, "c"), (4, 1, "y"), (4, 2, "z")], "id int, pos int, chunk_id string")
    got = {r.id: r.answer for r in answers.remap_citations(df, sent, sources, "id").collect()}
    assert got == {1: "x [7] y [ 03 ] [99999999999999999999] [a]", 2: None, 3: "none", 4: "[2][1]"}
