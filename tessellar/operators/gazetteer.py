"""Places named in texts: longest matches of a hierarchy's names, and what each run of names stands for.

The hierarchy is the caller's table (province, city, district; lower levels null), as are other names of its places: former
ones, spellings, areas. Names are looked for by one pattern in the shape of a trie, which the JVM runs over whole texts.
Names that follow each other are one run, and a run stands for the places that its last name may mean and
that all its other names agree with: for one place it is resolved, for several ambiguous, for none invalid.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.repair import PROVINCES

#: Names that a pattern and a broadcast may hold; a larger gazetteer is refused.
MOST_NAMES = 50_000

#: Former names of cities and counties, and areas, by the place that they are in today (province, city, district).
FORMER = {
    "천안군": ("충청남도", "천안시", None),
    "이천군": ("경기도", "이천시", None),
    "양산군": ("경상남도", "양산시", None),
    "화성군": ("경기도", "화성시", None),
    "용인군": ("경기도", "용인시", None),
    "경주군": ("경상북도", "경주시", None),
    "광주군": ("경기도", "광주시", None),
    "김포군": ("경기도", "김포시", None),
    "여주군": ("경기도", "여주시", None),
    "당진군": ("충청남도", "당진시", None),
    "포천군": ("경기도", "포천시", None),
    "양주군": ("경기도", "양주시", None),
    "논산군": ("충청남도", "논산시", None),
    "서산군": ("충청남도", "서산시", None),
    "청원군": ("충청북도", "청주시", None),
    "연기군": ("세종특별자치시", None, None),
    "마산시": ("경상남도", "창원시", None),
    "진해시": ("경상남도", "창원시", "진해구"),
    "여천시": ("전라남도", "여수시", None),
    "여천군": ("전라남도", "여수시", None),
    "동광양시": ("전라남도", "광양시", None),
    "북제주군": ("제주특별자치도", "제주시", None),
    "남제주군": ("제주특별자치도", "서귀포시", None),
    "경산군": ("경상북도", "경산시", None),
    "광양군": ("전라남도", "광양시", None),
    "정읍군": ("전북특별자치도", "정읍시", None),
    "평택군": ("경기도", "평택시", None),
    "안성군": ("경기도", "안성시", None),
    "진해군": ("경상남도", "창원시", "진해구"),
    "일산 신도시": ("경기도", "고양시", None),
    "일산신도시": ("경기도", "고양시", None),
    "중동 신도시": ("경기도", "부천시", None),
    "중동신도시": ("경기도", "부천시", None),
    "분당구": ("경기도", "성남시", "분당구"),
    "전북이리": ("전북특별자치도", "익산시", None),
}

#: Repeated misspellings of names.
MISSPELT = {
    "군사시": "군산시", "완주시": "완주군", "동장구": "동작구", "계약구": "계양구", "웅진군": "옹진군", "창년군": "창녕군",
    "당지군": "당진군", "연가군": "연기군", "은성군": "음성군", "곡석군": "곡성군", "을주군": "울주군", "울주구": "울주군",
    "포상시": "포항시", "시홍시": "시흥시", "아천시": "이천시", "광지구": "광진구", "미산시": "마산시", "서천시": "서천군",
    "거제사": "거제시", "황성군": "횡성군", "김해진": "김해시", "산천군": "산청군", "연수군": "연수구", "북부": "북구",
}


def trie_pattern(names: list[str]) -> str:
    """A regular expression for the names in the shape of their trie: at each place the longest name that stands there."""
    root: dict = {}
    for name in names:
        reduce(lambda node, c: node.setdefault(c, {}), name, root)[""] = {}

    def said(node: dict) -> str:
        ways = [re.escape(c) + said(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        inner = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return f"(?:{inner})?" if "" in node else inner

    return said(root)


def gazetteer(places: DataFrame, former: dict[str, tuple] | None = None, misspelt: dict[str, str] | None = None, provinces: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(alias, province, city, district): each place under its own name and its other ones."""
    spark = places.sparkSession
    former, misspelt, provinces = FORMER if former is None else former, MISSPELT if misspelt is None else misspelt, PROVINCES if provinces is None else provinces
    schema = "alias string, province string, city string, district string"
    whole = places.select(F.coalesce("district", "city", "province").alias("alias"), "province", "city", "district")
    short = [(s, p, None, None) for p, names in provinces.items() for s in names]
    every = whole.unionByName(spark.createDataFrame(short + [(a, *at) for a, at in former.items()], schema)).dropDuplicates()
    wrong = spark.createDataFrame(list(misspelt.items()), "wrong string, alias string")
    return every.unionByName(every.join(F.broadcast(wrong), "alias").select(F.col("wrong").alias("alias"), "province", "city", "district")).dropDuplicates()


def _part_of(inner: Column, outer: Column) -> Column:
    """Whether a place is, or is in, another one."""
    level = lambda x: outer[x].isNull() | inner[x].eqNullSafe(outer[x])
    return (inner["province"] == outer["province"]) & level("city") & level("district")


def named_places(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, run, said, status, province, city, district): a row for each run of names in the text, in order.

    status is resolved, ambiguous (several places) or invalid (names that contradict each other); both have no place.
    """
    known = [r.alias for r in names.select("alias").distinct().limit(MOST_NAMES + 1).collect()]
    if len(known) > MOST_NAMES:
        raise ValueError(f"the gazetteer holds more than {MOST_NAMES} names")
    if not known:
        raise ValueError("the gazetteer is empty")
    one = trie_pattern(known)
    runs = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"(?:{one})(?:\\s*(?:{one}))*"), 0)).alias("run", "said"))
    parts = runs.select(key, "run", "said", F.posexplode(F.regexp_extract_all("said", F.lit(one), 0)).alias("place", "alias"))
    meant = names.groupBy("alias").agg(F.collect_list(F.struct("province", "city", "district")).alias("places"))
    found = parts.join(F.broadcast(meant), "alias").groupBy(key, "run", "said").agg(F.sort_array(F.collect_list(F.struct("place", "places"))).alias("parts"))
    last, before = F.element_at("parts", -1)["places"], F.slice("parts", 1, F.size("parts") - 1)
    agree = F.filter(last, lambda at: F.forall(before, lambda p: F.exists(p["places"], lambda outer: _part_of(at, outer))))
    found = found.select(key, "run", "said", F.array_distinct(agree).alias("agree"))
    status = F.when(F.size("agree") == 1, "resolved").when(F.size("agree") > 1, "ambiguous").otherwise("invalid")
    at = F.when(F.size("agree") == 1, F.col("agree")[0])
    return found.select(key, "run", "said", status.alias("status"), *(at[x].alias(x) for x in ("province", "city", "district")))


def route_is_ambiguous(found: DataFrame, key: str) -> DataFrame:
    """(key, cities, ambiguous) over the resolved runs of each text: a route through two cities or more is at none of them."""
    n = F.countDistinct(F.struct("province", "city"))
    return found.where("status = 'resolved'").groupBy(key).agg(n.alias("cities"), (n >= 2).alias("ambiguous"))
