import pytest
from pyspark.sql import functions as F

from tessellar.operators import retrieval as R
from tessellar.sources import pdf


def test_expansion():
    groups = [{"triggers": ["light curtain"], "aliases": ["ESPE"]}]
    assert R.expand_query("Replace the light-curtain, replace", {"replace": ["swap", "the"]}, groups) == ["replace", "the", "light-curtain", "swap", "ESPE"]


def test_drop_rules(spark):
    kind = "id int, title string, content string, document_scope string, source_type string, similarity double, keyword double"
    rows = spark.createDataFrame(
        [
            (1, "conveyor belt", "cleaning", "public", "public_guide", 0.5, 0.0),
            (2, "curtain wall", "conveyor belt cleaning", "public", "public_guide", 0.5, 0.5),
            (3, "conveyor", "other", "public", "public_guide", 0.5, 0.5),
            (4, "conveyor belt", "cleaning", "public", "public_guide", 0.1, 0.05),
            (5, "conveyor belt", "cleaning", "public", "public_incident", 0.5, 0.0),
            (6, "x", "danger zone", "company", "company_policy", 0.3, 0.0),
        ],
        kind,
    )
    rules = R.DropRules(topic=("conveyor", "belt", "cleaning"), negative=("curtain wall",), safety=("danger",), no_incidents=True)
    assert sorted(r.id for r in R.kept_by_rules(rows, rules).collect()) == [1, 6]
    assert sorted(r.id for r in R.kept_by_rules(rows, R.DropRules(domain=("belt",))).collect()) == [1, 2, 5]


def test_card_pages(spark):
    rows = [(1, "a", i, i, "stop and lock") for i in range(3)] + [(1, "b", 3, 3, "stop lock"), (1, "c", 4, 4, "stop lock careful"), (2, "a", 0, 9, "stop")]
    df = spark.createDataFrame(rows, "document_id int, title string, chunk_index int, page int, content string")
    assert sorted((r.document_id, r.page) for r in R.card_pages(df, ["stop", "lock"], ["careful"]).collect()) == [(1, 0), (1, 3)]


def test_pdf_scan_and_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"one|two")
    (tmp_path / "in/b.pdf").write_bytes(b"bad")

    def extract(raw: bytes) -> list[str]:
        if raw == b"bad":
            raise ValueError("bad")
        return raw.decode().split("|")

    got = {(r.path.split("/")[-1], r.page, r.text, r.error) for r in pdf.read_pdfs(spark, f"{tmp_path}/in", extract).collect()}
    assert got == {("a.pdf", 1, "one", None), ("a.pdf", 2, "two", None), ("b.pdf", None, None, "ValueError: bad")}
    chunks = spark.createDataFrame([(i,) for i in range(5)], "chunk_id long")
    mark = pdf.fingerprint({"size": 600}, "0", "4", 5)
    assert pdf.resume(spark, f"{tmp_path}/out", mark, chunks, "chunk_id").count() == 5
    pdf.append_done(chunks.where(F.col("chunk_id") < 3), f"{tmp_path}/out", mark)
    assert sorted(r.chunk_id for r in pdf.resume(spark, f"{tmp_path}/out", mark, chunks, "chunk_id").collect()) == [3, 4]
    with pytest.raises(ValueError):
        pdf.resume(spark, f"{tmp_path}/out", pdf.fingerprint({"size": 1}, "0", "4", 5), chunks, "chunk_id")
