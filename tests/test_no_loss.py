"""Nothing is lost without a sign: short pages, budgets, unfinished publishing, changed packages."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tessellar.functions import ed25519
from tessellar.sources import files, paged


@pytest.fixture
def service():
    """23 items; pages of 5; `short` pages lose their last item."""
    short: set[int] = set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            own = [{"n": i} for i in range((q["p"] - 1) * q["s"], min(q["p"] * q["s"], 23))]
            if q["s"] == 5 and q["p"] in short:
                own.pop()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": {"body": {"items": {"item": own}, "totalCount": 23, "totalMediaCount": 7}}}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/?p={{page}}&s={{size}}", short
    server.shutdown()


def test_short_pages_and_budgets(spark, service):
    url, short = service
    spark.dataSource.register(paged.PagedSource)
    read = lambda **o: spark.read.format("paged").options(url=url, pagesize="5", pagespertask="3", **o).load()
    stats = lambda rows, **o: tuple(paged.crawl_stats(rows, 23, 5, **o).first())
    assert stats(read()) == (23, 23, 5, True, "complete")
    short.add(2)
    with pytest.raises(Exception, match="page 2 holds 4 items instead of 5"):
        read().count()
    kept = read(onincomplete="keep")
    assert sorted(json.loads(r.item)["n"] for r in kept.collect()) == [i for i in range(23) if i != 9]
    assert stats(kept) == (23, 22, 5, False, "short")
    short.clear()
    with pytest.raises(Exception, match="5 pages exceed the budget of 2"):
        read(maxpages="2").count()
    assert stats(read(maxpages="2", onincomplete="keep"), pages_allowed=2) == (23, 10, 2, False, "budget")


def test_search_page():
    text = json.dumps({"body": {"items": [{"a": 1}], "totalCount": "41", "totalMediaCount": 7}})
    assert paged.search_page(text, 20) == paged.SearchPage([{"a": 1}], 41, 7, 3)


def test_unfinished_publishing_is_undone(spark, tmp_path):
    one, two = (spark.createDataFrame([(i,)], "n int") for i in (1, 2))
    path = f"{tmp_path}/pub"
    files.publish(spark, {"a": one, "b": one}, path)
    with pytest.raises(Exception, match="no_such"):
        files.publish(spark, {"a": two, "b": two.select(F.raise_error(F.lit("no_such")).alias("n"))}, path)
    assert spark.read.parquet(f"{path}/a").first().n == 1
    # as if a crash had come between the renames
    (tmp_path / "pub/.former").mkdir()
    (tmp_path / "pub/a").rename(tmp_path / "pub/.former/a")
    (tmp_path / "pub/.staged/a").rename(tmp_path / "pub/a")
    assert files.recover(spark, path) == ["a"]
    assert [spark.read.parquet(f"{path}/{x}").first().n for x in "ab"] == [1, 1]
    files.publish(spark, {"a": two, "b": two}, path)
    assert [spark.read.parquet(f"{path}/{x}").first().n for x in "ab"] == [2, 2]
    assert sorted(p.name for p in (tmp_path / "pub").iterdir() if not p.name.endswith(".crc")) == ["a", "b"]


def test_replace_all(spark, tmp_path):
    schema = "id string, part int, text string"
    rows = spark.createDataFrame([("d1", 0, "x"), ("d1", 1, None)], schema)
    assert files.replace_all(spark, rows, f"{tmp_path}/t/chunks", ["id", "part"]) == 2
    for bad in ([("d1", 0, "x"), ("d1", 0, "y")], [(None, 0, "x")]):
        with pytest.raises(ValueError, match="null or repeated"):
            files.replace_all(spark, spark.createDataFrame(bad, schema), f"{tmp_path}/t/chunks", ["id", "part"])
    assert spark.read.parquet(f"{tmp_path}/t/chunks").count() == 2
    with pytest.raises(ValueError, match="2 rows differ"):
        files.verify_stored(rows.limit(1), spark.createDataFrame([("d2", 0, "x")], schema), ["id"])


def test_ed25519_published_vectors():
    for seed, public, message, signature in [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ]:
        seed, public, message, signature = map(bytes.fromhex, (seed, public, message, signature))
        assert ed25519.public_key(seed) == public and ed25519.sign(seed, message) == signature
        assert ed25519.verify(public, message, signature) and not ed25519.verify(public, message + b"x", signature)
        assert not ed25519.verify(public, message, signature[:-1] + bytes([signature[-1] ^ 1])) and not ed25519.verify(public, message, b"")


def test_packages_by_public_key(spark, tmp_path):
    seed = bytes(range(32))
    public = ed25519.public_key(seed)
    sign = lambda b: ed25519.sign(seed, b).hex()
    check = lambda b, s: ed25519.verify(public, b, bytes.fromhex(s))
    documents = spark.createDataFrame([(1, "public", "active", "law"), (2, "private", "active", "law"), (3, "public", "draft", "law"), (4, "public", "active", "manual"), (5, "public", "active", "law")], "document_id int, access_level string, lifecycle_status string, source_type string")
    chunks = spark.createDataFrame([(1, 0, "ready", [1.0]), (1, 1, "pending", None), (2, 0, "ready", [1.0]), (4, 0, "ready", [1.0])], "document_id int, chunk_index int, embedding_status string, embedding array<double>")
    path = f"{tmp_path}/p"
    manifest = files.export_package(spark, documents, chunks, path, sign, ("law", "guide"), {"version": "v1"}, check)
    assert manifest["info"] == {"version": "v1", "documents": 1, "chunks": 1}
    tables = files.verify_package(spark, path, check=check)
    assert [r.document_id for r in tables["documents"].collect()] == [1] and tables["chunks"].count() == 1
    (tmp_path / "p/documents/part-more.parquet").write_bytes(b"x")
    with pytest.raises(ValueError, match="added"):
        files.verify_package(spark, path, check=check)
    (tmp_path / "p/documents/part-more.parquet").unlink()
    other = ed25519.public_key(bytes(32))
    with pytest.raises(ValueError, match="signature"):
        files.verify_package(spark, path, check=lambda b, s: ed25519.verify(other, b, bytes.fromhex(s)))


def test_roll_back(spark):
    packages = spark.createDataFrame([("v1", "superseded"), ("v2", "superseded"), ("v3", "active")], "version string, status string")
    documents = spark.createDataFrame([("v2:d", "v2", True), ("v3:d", "v3", False), ("v1:d", "v1", True)], "external_id string, version string, deleted boolean")
    states, after = files.roll_back(packages, documents)
    assert {tuple(r) for r in states.collect()} == {("v1", "superseded"), ("v2", "active"), ("v3", "rolled_back")}
    assert {(r.external_id, r.deleted) for r in after.collect()} == {("v1:d", True), ("v2:d", False), ("v3:d", True)}
    with pytest.raises(ValueError, match="no version"):
        files.roll_back(packages.where("version = 'v3'"), documents)
