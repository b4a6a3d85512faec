"""Goldens, invariants and brute-force checks of what SQL can't express."""

import datetime as dt
import hashlib
import hmac
import json
import random
import uuid

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.functions import numbers as N
from tessellar.functions import text as X
from tessellar.operators import answers, chunking, lifecycle, merge, quality, relational, retrieval, risk
from tessellar.sources import files, paged
from tessellar.streaming import jobs


def column(spark, c, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(c).first()[0]


def test_tokens_and_terms(spark):
    tok = lambda s: column(spark, X.tokenize(F.col("s")), s=s)
    assert tok("컨베이어를 점검하고 컨베이어 점검_ a -V2-") == ["컨베이어", "점검하고", "점검", "v2"]
    assert tok("이것으로는 벨트에서 회전체의") == ["이것", "벨트", "회전체"]
    low = F.lower("s")
    for term, text, hit in [("ac", "an AC motor", True), ("ac", "machine", False), ("컨베이어", "콘베이어 벨트", True), ("lightcurtain", "Light Curtain", True), ("벨트", "벨", False), ("컨베이어벨트", "컨베이어 작업", True)]:
        assert column(spark, X.term_matches(term, low), s=text) is hit, (term, text)
    assert column(spark, X.lexical_score(["motor", "zz"], F.col("s")), s="Motor") == 0.5
    assert [column(spark, X.topic_threshold(F.col("n")), n=n) for n in (1, 2, 3, 4, 5, 10)] == [1, 2, 2, 3, 3, 6]


def test_cleaning(spark):
    raw = "Title\n 4 \n\f◆◆◆◆◆◆ text ........ 3\n|---|---|\na\n\n\n\nb © Copyright Reserved 2020"
    assert column(spark, X.clean_text(F.col("s")), s=raw) == "Title\n  text   3\na\n\nb"
    assert column(spark, X.html_to_text(F.col("s")), s="<p>a&nbsp;b</p><script>x</script><b>c</b><br>d &amp;lt;") == "a b\nc\nd &lt;"
    assert column(spark, X.parse_date(F.col("s")), s="사고 2026.7.1 발생") == dt.date(2026, 7, 1)
    assert column(spark, X.parse_date(F.col("s")), s="2026-02-30") is None
    assert "".join(column(spark, X.sentences(F.col("s")), s="One. Two 3. x! y\n\nz")) == "One. Two 3. x! y\n\nz"


def test_numbers(spark):
    for name in ("doc:1", "한글", ""):
        assert column(spark, N.uuid5(uuid.NAMESPACE_DNS, F.col("s")), s=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert column(spark, N.half_even(F.col("x")), x=2.5) == 2 and column(spark, N.half_even(F.col("x")), x=3.5) == 4
    assert [column(spark, N.risk_level(F.col("x")), x=x) for x in (12, 6, 5)] == ["high", "medium", "low"]
    assert column(spark, N.fields_hash(F.col("a"), F.col("b")), a="x", b=1) == hashlib.sha256(b"x\x1f1").hexdigest()
    assert not column(spark, N.vector_is_valid(F.col("v"), 2), v=[float("nan"), 1.0])


def test_radius_is_the_product_with_a_filter(spark):
    rng = random.Random(0)
    points = [(i, 37.5 + rng.random() / 50, 127 + rng.random() / 50) for i in range(60)]
    places = [(i, 37.5 + rng.random() / 50, 127 + rng.random() / 50) for i in range(60)]
    p, e = spark.createDataFrame(points, "point_id int, point_lat double, point_lon double"), spark.createDataFrame(places, "equipment_id int, lat double, lon double")
    every = p.join(e, F.lit(True)).withColumn("d", N.haversine_m(F.col("point_lat"), F.col("point_lon"), F.col("lat"), F.col("lon"))).where("d <= 250")
    got = risk.within_radius(p, e, 250.0)
    assert sorted((r.point_id, r.equipment_id) for r in got.collect()) == sorted((r.point_id, r.equipment_id) for r in every.collect())
    lat, lon = N.recentred(F.lit(35.001), F.lit(129.001), (35.0, 129.0), (60.0, 10.0))
    assert abs(column(spark, N.haversine_m(F.lit(60.0), F.lit(10.0), lat, lon), x=1) - column(spark, N.haversine_m(F.lit(35.0), F.lit(129.0), F.lit(35.001), F.lit(129.001)), x=1)) < 0.5


def test_risk_rules(spark):
    rows = spark.createDataFrame([(1, "벨트 청소"), (2, "nothing"), (3, None)], "request_id int, text string")
    got = {}
    for r in risk.hazards(rows).collect():
        got.setdefault(r.request_id, []).append((r.accident_type, r.score, r.risk_level))
    assert got == {1: [("끼임", 12, "high"), ("불시기동", 12, "high")], 2: [("미분류", 4, "low")], 3: [("미분류", 4, "low")]}
    items = [r.item for r in risk.checklists(risk.hazards(rows.where("request_id = 1"))).orderBy("sequence").collect()]
    assert items == [*risk.RULES[0].checklist, *risk.RULES[1].checklist][:5]


def candidates(seed, n=120):
    rng = random.Random(seed)
    return pd.DataFrame({"request_id": [i % 2 for i in range(n)], "place": list(range(n)), "document_id": [rng.randrange(25) for _ in range(n)], "bucket": [rng.choice(retrieval.BUCKETS) for _ in range(n)], "chunk_id": list(range(n))})


def test_greedy_quotas_against_a_walk(spark):
    rows = candidates(1)
    quotas = retrieval.Quotas(total=9)
    got = retrieval.greedy_quotas(spark.createDataFrame(rows), quotas).collect()
    for request in (0, 1):
        docs, buckets, kept = {}, {}, []
        for r in rows[rows.request_id == request].itertuples():
            if len(kept) < 9 and docs.get(r.document_id, 0) < 2 and buckets.get(r.bucket, 0) < dict(quotas.per_bucket)[r.bucket]:
                docs[r.document_id] = docs.get(r.document_id, 0) + 1
                buckets[r.bucket] = buckets.get(r.bucket, 0) + 1
                kept.append(r.chunk_id)
        assert [r.chunk_id for r in got if r.request_id == request] == kept


def test_diverse_selection(spark):
    rows = pd.DataFrame({"request_id": 1, "place": [1, 2, 3, 4], "document_id": [1, 1, 2, 3], "page": [1, 1, 1, 1], "bucket": ["manual", "manual", "manual", "public_law"], "priority": [False, False, False, False], "score": [0.9, 0.88, 0.7, 0.6], "chunk_id": [1, 2, 3, 4]})
    got = [r.chunk_id for r in retrieval.diverse_selection(spark.createDataFrame(rows), 3).orderBy("pick").collect()]
    assert got == [1, 4, 3]


def test_scope_and_clauses(spark):
    rows = spark.createDataFrame([(1, "public", "public", 1), (2, "public", "site", 1), (3, "company", "site", 1), (4, "company", "private", 1), (5, "company", "site", 2)], "id int, document_scope string, access_level string, site_id int")
    ids = lambda s: [r.id for r in rows.where(retrieval.in_scope(s)).collect()]
    assert ids(retrieval.Scope()) == [1]
    assert ids(retrieval.Scope(True, False, False, (1,))) == [1, 3]
    assert ids(retrieval.Scope(True, True, True)) == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        retrieval.scope_clause([])


def test_cover_density(spark):
    assert retrieval.covers("a x b a b".split(), ["a", "b"]) == [(0, 2), (2, 3), (3, 4)]
    rows = spark.createDataFrame([(1, "a x b"), (2, "a b"), (3, "a only"), (4, None)], "id int, t string")
    got = {r.id: (r.all_terms, r.rank) for r in retrieval.cover_density(rows, ["a", "b"], "id", "t").collect()}
    assert got[2][1] > got[1][1] > 0 and got[3] == (False, 0.0) and got[4] == (False, 0.0)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n1다", max_size=400), st.integers(5, 60), st.data())
def test_chunks_are_bounded_and_cover(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    chunks = chunking.pack_sentences(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    squeezed = lambda s: "".join(s.split())
    assert set(squeezed(text)) == set(squeezed("".join(chunks)))
    assert "".join(chunking.sentence_units(text)) == text
    pieces = chunking.split_at_marks(text, size, min(overlap, size // 2))
    assert all(0 < len(p) <= size for p in pieces)
    if overlap == 0:
        assert squeezed("".join(chunks)) == squeezed(text) == squeezed("".join(chunking.split_at_marks(text, size, 0)))


def test_chunk_goldens():
    assert chunking.pack_sentences("One two. Three four. Five six.", 21, 10) == ["One two. Three four.", "Five six."]
    assert chunking.pack_sentences("aaaa. bbbb. cccc. dddd.", 12, 6) == ["aaaa. bbbb.", "bbbb. cccc.", "cccc. dddd."]
    assert chunking.pack_rows("h", ["aa", "bb", "cc"], 7) == ["h\naa\nbb", "h\ncc"]
    assert chunking.pack_section([{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "table", "header": "h", "rows": ["r"]}]) == ["a\nb", "h\nr"]
    assert chunking.windows("abcdefgh", 4, 1) == ["abcd", "defg", "gh"]
    with pytest.raises(ValueError):
        chunking.pack_sentences("x", 5, 5)
    with pytest.raises(ValueError):
        chunking.with_header("x" * 800, "body")
    assert chunking.section_paths([(1, "a"), (2, "b"), (2, "c"), (1, "d"), (3, "e")]) == [["a"], ["a", "b"], ["a", "c"], ["d"], ["d", "e"]]
    assert chunking.merge_fragments([("가", 1, 0, 10), ("나", 1.2, 11, 20), ("long line", 1, 22, 30), ("다", 9, 31, 40)]) == ["가나", "long line", "다"]
    page = "<table><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr><tr><td></td><td></td></tr></table>"
    assert chunking.table_records(page) == [{"a": "1", "b": "2"}, {"a": "1", "b": "3"}]
    assert list(chunking.block_contents({"x": [{"block_content": page}, {"block_content": "none"}]})) == [page]


def test_intents_and_answers(spark):
    rows = spark.createDataFrame([(1, "이 매뉴얼 요약해줘"), (2, "컨베이어 벨트 교체 방법과 주의사항"), (3, "베어링의 역할이 뭐야"), (4, "hello"), (5, None)], "id int, q string")
    got = {r.id: (r.intent, r.confidence) for r in answers.intents(rows, "q", F.lit(False)).collect()}
    assert got == {1: ("document_qa", 0.96), 2: ("maintenance_guide", 0.92), 3: ("component_info", 0.94), 4: ("clarification_required", 0.62), 5: ("clarification_required", 0.62)}
    assert column(spark, answers.collapse_bullets(F.col("b"), "케이블"), b=["전원 케이블", "케이블", "퓨즈"]) == ["케이블", "퓨즈"]
    assert column(spark, answers.path_list(F.col("s")), s='["a", "a", "", "b"]') == ["a", "b"] and column(spark, answers.path_list(F.col("s")), s="x.png") == ["x.png"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "h1", [1.0], None, "ready"), (2, "h2", [2.0], "e", "failed")], "k int, content_hash string, embedding array<double>, embedding_error string, embedding_status string")
    new = spark.createDataFrame([(1, "h1"), (2, "new"), (3, "h3")], "k int, content_hash string")
    got = {r.k: (r.embedding, r.embedding_status) for r in merge.upsert_chunks(old, new, "k").collect()}
    assert got == {1: ([1.0], "ready"), 2: (None, "pending"), 3: (None, "pending")}
    again = merge.upsert(new, new, "k", ["content_hash"])
    assert {r.outcome for r in again.collect()} == {"unchanged"}
    crawled = spark.createDataFrame([(1, "t", "d0", "d0")], "k int, title string, first_seen string, updated_at string")
    got = {r.k: tuple(r)[1:] for r in merge.merge_crawled(crawled, spark.createDataFrame([(1, "[]"), (2, "n")], "k int, title string"), "k", ["title"], F.lit("now")).collect()}
    assert got == {1: ("t", "d0", "d0", "duplicate"), 2: ("n", "now", "now", "new")}
    chunks = spark.createDataFrame([(1, "a", "pending"), (2, " ", "pending"), (3, "b", "ready")], "chunk_id long, content string, embedding_status string")
    got = {r.chunk_id: r.embedding_status for r in merge.backfill(chunks, lambda texts: [[1.0, 2.0] for _ in texts], 2).collect()}
    assert got == {1: "ready", 2: "skipped"}
    assert {r.embedding_status for r in merge.backfill(chunks, lambda texts: [[1.0] for _ in texts], 2).collect()} == {"failed", "skipped"}


def test_lifecycle(spark):
    log = spark.createDataFrame([(1, i, ok) for i, ok in enumerate([False] * 5 + [True, False])], "u int, i int, ok boolean")
    got = [(r.failures, r.locked) for r in lifecycle.lockouts(log, "u", ["i"], F.col("ok")).orderBy("i").collect()]
    assert got == [(1, False), (2, False), (3, False), (4, False), (5, True), (0, False), (1, False)]
    assert quality.counters(log, {"none": F.lit(False)}).first().passed
    with pytest.raises(ValueError):
        quality.required(log, ["missing"])
    with pytest.raises(ValueError):
        relational.page(log, 0, 101, F.col("i"))
    ids = relational.global_ids(log.select("i").repartition(3), "i", 4)
    assert sorted((r.i, r.id) for r in ids.collect()) == [(i, i + 1) for i in range(7)]


def test_files(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([(1, 'a "q"\nline', ["x"]), (2, None, [])], schema)
    files.write_both(df, str(tmp_path))
    text = T.StructType([T.StructField(n, T.StringType()) for n in schema.names])
    rows = files.read_csv(spark, f"{tmp_path}/csv", text).orderBy("id").collect()
    assert rows[0].name == 'a "q"\nline' and rows[0].tags == '["x"]'
    assert files.read_jsonl(spark, f"{tmp_path}/jsonl", schema).orderBy("id").collect() == df.collect()
    with pytest.raises(ValueError):
        files.read_csv(spark, f"{tmp_path}/csv", schema.add("more", "string"))
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n[1]\n')
    with pytest.raises(Exception, match="bad.jsonl:3: expected a JSON object"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    (tmp_path / "terms.csv").write_text("Term,Type\n belt ,title\nmotor,odd\n,title\n")
    assert sorted(tuple(r) for r in files.read_terms(spark, str(tmp_path / "terms.csv")).collect()) == [("belt", "title"), ("motor", "combined")]
    files.publish(spark, {"a": df.drop("tags")}, f"{tmp_path}/pub")
    files.publish(spark, {"a": df.drop("tags").limit(1)}, f"{tmp_path}/pub")
    assert spark.read.parquet(f"{tmp_path}/pub/a").count() == 1
    files.audit_rows(spark, [("login", "u", "e", True, "{}")], f"{tmp_path}/audit")
    files.audit_rows(spark, [("login", "u", "e", False, "{}")], f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 2


def test_signed_packages(spark, tmp_path):
    sign = lambda b: hmac.new(b"key", b, hashlib.sha256).hexdigest()
    docs = spark.createDataFrame([("d1", "t")], "external_id string, title string")
    files.write_package(spark, {"documents": docs}, f"{tmp_path}/p", sign)
    assert files.verify_package(spark, f"{tmp_path}/p", sign)["documents"].count() == 1
    with pytest.raises(ValueError, match="signature"):
        files.verify_package(spark, f"{tmp_path}/p", lambda b: "other")
    docs.union(docs).write.mode("overwrite").parquet(f"{tmp_path}/p/documents")
    with pytest.raises(ValueError, match="changed"):
        files.verify_package(spark, f"{tmp_path}/p", sign)
    packages = spark.createDataFrame([("v1", "active")], "version string, status string")
    have = spark.createDataFrame([("v1:d0", "t", "v1", False)], "external_id string, title string, version string, deleted boolean")
    states, after = files.import_package(packages, have, "v2", docs)
    assert {tuple(r) for r in states.collect()} == {("v1", "superseded"), ("v2", "active")}
    assert {(r.external_id, r.deleted) for r in after.collect()} == {("v1:d0", True), ("v2:d1", False)}


def test_paged_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            own = [{"n": i} for i in range((q["p"] - 1) * q["s"], min(q["p"] * q["s"], 23))]
            body = json.dumps({"response": {"header": {"resultCode": "00"}, "body": {"items": {"item": own if len(own) != 1 else own[0]}, "totalCount": 23}}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(paged.PagedSource)
        rows = spark.read.format("paged").option("url", f"http://127.0.0.1:{server.server_port}/?p={{page}}&s={{size}}").option("pagesize", "5").option("pagespertask", "2").load()
        assert sorted(json.loads(r.item)["n"] for r in rows.collect()) == list(range(23))
    finally:
        server.shutdown()
    tries = []

    def broken(url, timeout):
        tries.append(url)
        raise TimeoutError

    with pytest.raises(TimeoutError):
        paged.fetch("x", broken, sleep=lambda s: None)
    assert len(tries) == 4
    assert column(spark, paged.error_class(F.col("s")), s="<!doctype html><html>") == "html"


def test_windows_on_a_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    q = jobs.tumbling_counts(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, jobs.tumbling_counts(table).collect()))
