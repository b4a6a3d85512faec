"""Places by the decision table, the trie's pattern against a plain search; counts in flow."""

import random
import re

import pytest

from tessellar.operators import gazetteer as G

PLACES = [("경기도", None, None), ("경기도", "광주시", None), ("경기도", "고양시", None), ("경기도", "이천시", None), ("경기도", "성남시", "분당구"), ("광주광역시", None, None), ("부산광역시", None, None), ("부산광역시", "중구", None), ("서울특별시", None, None), ("서울특별시", "중구", None), ("서울특별시", "동작구", None), ("전북특별자치도", "군산시", None), ("경상남도", "창원시", "진해구"), ("경상남도", "창원시", None)]


def test_decisions(spark):
    names = G.gazetteer(spark.createDataFrame(PLACES, "province string, city string, district string"))
    texts = {
        "경기도 광주시 현장": [("resolved", "경기도", "광주시", None)],
        "광주시에서": [("ambiguous", None, None, None)],
        "중구": [("ambiguous", None, None, None)],
        "부산 중구와 서울중구": [("resolved", "부산광역시", "중구", None), ("resolved", "서울특별시", "중구", None)],
        "부산 동작구": [("invalid", None, None, None)],
        "군사시, 동장구": [("resolved", "전북특별자치도", "군산시", None), ("resolved", "서울특별시", "동작구", None)],
        "이천군 일산신도시": [("invalid", None, None, None)],
        "이천군. 일산신도시": [("resolved", "경기도", "이천시", None), ("resolved", "경기도", "고양시", None)],
        "경남 진해시": [("resolved", "경상남도", "창원시", "진해구")],
        "경기 분당구": [("resolved", "경기도", "성남시", "분당구")],
        "어디도 아님": [],
        None: [],
        "": [],
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    got = {}
    for r in G.named_places(df, "id", "text", names).orderBy("id", "run").collect():
        got.setdefault(r.id, []).append((r.status, r.province, r.city, r.district))
    assert got == {k: v for k, v in enumerate(texts.values()) if v}
    routes = {r.id: (r.cities, r.ambiguous) for r in G.route_is_ambiguous(G.named_places(df, "id", "text", names), "id").collect()}
    assert routes[3] == (2, True) and routes[0] == (1, False) and 1 not in routes
    with pytest.raises(ValueError, match="empty"):
        G.named_places(df, "id", "text", names.limit(0))


def test_trie_takes_the_longest_name():
    rng = random.Random(4)
    for _ in range(300):
        names = sorted({"".join(rng.choice("ab.|") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))})
        text = "".join(rng.choice("ab.| ") for _ in range(40))
        plain = "|".join(map(re.escape, sorted(names, key=len, reverse=True)))
        assert re.findall(G.trie_pattern(names), text) == re.findall(plain, text)


def test_counts_come_with_the_write(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessellar.operators import quality as Q

    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("n"))
    found = Q.write_observed(rows, f"{tmp_path}/t", {"sevens": F.col("n") == 0, "nulls": F.nullif("n", F.col("n")) > 0})
    assert found == {"rows": 1000, "sevens": 143, "nulls": 0, "passed": False} and spark.read.parquet(f"{tmp_path}/t").count() == 1000
    same = rows.withColumn("x", F.lit(None).cast("string"))
    assert Q.regressions(same, same, "id", ["n", "x"], same).first().asDict() == {"lost_rows": 0, "added_rows": 0, "protected_column_regressions": 0, "idempotence_errors": 0, "passed": True}
