"""Repairs, cards and profiles on cases that the queries over tables do not hold."""

from pyspark.sql import functions as F

from tessellar.functions import repair as R
from tessellar.operators import answers as A
from tessellar.operators import cards as C
from tessellar.operators import profiles as P
from tests.test_operators import column


def test_every_glued_pair(spark):
    fixed = lambda s: column(spark, R.repair_glued(F.col("s")), s=s)
    assert fixed("벌목현장에서크레인이 밀리자몸으로 막다") == "벌목현장에서 크레인이 밀리자 몸으로 막다"
    assert fixed("운반하던중이던 작업 중지 하던 중에 넘어져도") == "운반하던 중이던 작업 중지 하던 중에 넘어져도"
    assert fixed("접촉하여도, 접촉하여도로") == "접촉하여도, 접촉하여 도로"
    assert fixed("이동하기 위해사다리 올라가판넬 롤러에부딪혀") == "이동하기 위해 사다리 올라가 판넬 롤러에 부딪혀"
    assert fixed("plain  text") == "plain  text"


def test_repair_is_stable(spark):
    text = "공정에서재해자가넘어져손을 떨어져낙하하는 인해인양"
    once = column(spark, R.repair_glued(F.col("s")), s=text)
    assert column(spark, R.repair_glued(F.col("s")), s=once) == once
    assert column(spark, R.glued_left(F.col("s")), s=once) == []


def test_nulls_and_very_long_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "위험 " * 200_000)], "id int, t string")
    t = F.col("t")
    score = C.candidate_score(t, F.array(F.lit("위험")), F.lit(0.0), F.lit(0))
    got = {r.id: tuple(r)[1:] for r in rows.select("id", C.bad_card(t).alias("a"), C.meaningful(t).alias("b"), F.round(score, 6).alias("c"), C.card_phrase(t, []).alias("d"), P.aliases(t).alias("e")).collect()}
    assert got[1] == got[2] == (True, False, 0.08, "", [])
    assert got[3][:3] == (True, True, 0.65)
    empty = rows.where("id < 0")
    assert empty.select(P.aliases(t)).count() == 0


def test_alias_rules(spark):
    names = lambda s: column(spark, P.aliases(F.col("s")), s=s)
    assert names("안전 작업 the Manual") == []
    assert names("제품 안전 커튼 (GL-R08H)") == ["안전 커튼", "GL", "GL Series", "R08H", "R08H Series", "GL-R08H"]
    assert names("x" * 60 + " 센서") == []


def test_profile_bounds(spark):
    rows = spark.createDataFrame([(["a"] * 3 + [f"v{i}" for i in range(40)], None, "nan"), (None, ["z"], "0.5")], "components array<string>, aliases array<string>, confidence string")
    got = P.normalise(rows).collect()
    assert len(got[0].components) == 30 and got[0].components[:2] == ["a", "v0"] and got[0].aliases == [] and got[0].confidence is None
    assert got[1].components == [] and got[1].aliases == ["z"] and got[1].confidence == 0.5


def test_a_subject_is_needed(spark):
    def intent(s):
        rows = spark.createDataFrame([(s,)], "q string")
        return A.intents(rows, "q", F.lit(True)).first().intent

    assert intent("안전 주의 방법") == "clarification_required"
    assert intent("센서 안전 주의 방법") == "maintenance_guide"
    assert intent("센서 관련") == "component_info"
    assert intent("문서 요약") == "document_qa"
