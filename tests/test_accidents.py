import datetime as dt

from pyspark.sql import functions as F

from tessellar.operators import accidents as D
from tests.test_operators import column

LABELS = ["재해일", "장소", "업종"]


def test_dates(spark):
    date = lambda s: column(spark, D.accident_date(F.col("s"), "재해일", LABELS), s=s)
    assert date("등록일: 2020-01-02\n재 해 일 : 2021.3.4 장소: 서울") == dt.date(2021, 3, 4)
    assert date("등록일 2020-01-02 그리고 2019년 5월 6일 사고") == dt.date(2019, 5, 6)
    assert date("x" * 400 + " 2019-05-06, 2018-01-01") is None
    assert date("2019-02-30") is None and date("") is None
    title = lambda a, b: column(spark, D.title_date(F.col("a"), F.col("b")), a=a, b=b)
    assert title("3월 4일 추락", "2021년 발생") == dt.date(2021, 3, 4)
    assert title("3월 4일 추락", "2021년, 2020년") is None
    assert title("2020.3.4", "") == dt.date(2020, 3, 4)


def test_labels(spark):
    value = lambda s, k: column(spark, D.labelled_value(F.col("s"), k, LABELS), s=s)
    text = "업 종: 기타  제조업; 장소 : 부산\n\n재해일:"
    assert (value(text, "업종"), value(text, "장소"), value(text, "재해일")) == ("기타 제조업", "부산", None)


def test_location_decisions(spark):
    kind = "struct<province:string,city:string,detail:string,specificity:int>"
    rows = [
        (1, ("P", "C", "D", 3), ("P", "C", "D", 3), None, "consistent", "P C D"),
        (2, ("P", "C", "영동", 3), ("P", "C", "영동읍", 3), None, "consistent_detail_normalized", "P C 영동읍"),
        (3, ("P", "C", "가나동", 3), ("P", "C", "다나동", 3), None, "title_detail_typo_corrected", "P C 다나동"),
        (4, ("P", "C", "가나동", 3), ("P", "C", "마바리", 3), None, "true_detail_conflict", None),
        (5, ("P", "C", None, 2), ("Q", "C", None, 2), None, "true_conflict", None),
        (6, None, ("Q", "C", None, 2), "old", "body", "Q C"),
        (7, ("P", None, None, 1), None, "old", "title", "P"),
        (8, None, None, "old", "base_preserved", "old"),
        (9, None, None, None, "none", None),
    ]
    given = spark.createDataFrame([r[:4] for r in rows], f"id int, title {kind}, body {kind}, existing string")
    got = {r.id: (r.location_status, r.location) for r in D.decide_location(given).collect()}
    assert got == {r[0]: r[4:] for r in rows}


def test_fonts_and_text(spark):
    broken = lambda s: column(spark, D.broken_font_mapping(F.col("s")), s=s)
    assert broken("�" * 60) and not broken("정상 문서 " * 50)
    assert broken("कখगघ" * 0 + "क" * 20 + "ক" * 20 + "ક" * 20 + "a" * 50)
    assert column(spark, D.final_text(F.col("s")), s="\x01a  b\n.\n\n c ") == "a b\nc"
    assert column(spark, D.final_text(F.col("s")), s=" \n.") is None
