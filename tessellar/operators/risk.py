"""Rule-based risk scoring, checklists and proximity."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tessellar.functions.numbers import METRES_PER_DEGREE, haversine_m, risk_level


@dataclass(frozen=True)
class Rule:
    name: str
    accident_type: str
    likelihood: int
    severity: int
    keywords: tuple[str, ...]
    checklist: tuple[str, ...] = ()
    safety: tuple[str, ...] = ()


# Keywords, levels, checklists and safety actions of the rules; the default applies where none matches.
RULES = (
    Rule("회전체 및 구동부 끼임 위험", "끼임", 3, 4, ("컨베이어", "벨트", "체인", "베어링", "회전체"), ("주전원 차단과 잠금·표지 상태 확인", "회전체 완전 정지 확인", "방호덮개와 작업구역 출입통제 확인"), ("설비의 모든 에너지원을 차단하고 잠금·표지 절차를 확인합니다.", "회전체가 완전히 정지했는지 직접 확인합니다.", "방호덮개를 임의로 해제한 상태에서 작업하지 않습니다.")),
    Rule("설비 불시 재가동 위험", "불시기동", 3, 4, ("정비", "점검", "청소", "교체", "이물질", "조정"), ("작업허가 및 담당자 확인", "잔류 에너지 제거 확인", "재가동 금지 표지와 연락 절차 확인"), ("정비 시작 전 작업허가와 설비 정지 상태를 확인합니다.", "에너지 차단 지점을 식별하고 잔류 에너지를 제거합니다.", "재가동 권한자와 작업자 사이의 연락 절차를 확인합니다.")),
    Rule("전기에너지 접촉 위험", "감전", 2, 4, ("전기", "모터", "판넬", "전압", "전원", "감전"), ("무전압 상태 확인", "잔류전하 방전 여부 확인", "전기작업 보호구와 절연공구 확인"), ("차단기 개방 후 무전압 상태를 적절한 계측기로 확인합니다.", "잔류전하와 유도전압 가능성을 확인합니다.", "사업장 전기작업 절차와 적합한 보호구를 확인합니다.")),
    Rule("고온·불꽃에 의한 화재 위험", "화재", 2, 4, ("용접", "불꽃", "화재", "가연성", "고온"), ("화기작업 허가 확인", "가연물 제거와 소화설비 배치 확인", "작업 종료 후 잔불 점검 계획 확인"), ("가연물을 제거하고 화기작업 허가 여부를 확인합니다.", "적합한 소화설비와 화재감시자를 배치합니다.", "작업 종료 후 잔불과 고온부를 확인합니다.")),
)
#: Checklist item of a request without evidence.
NO_EVIDENCE = "공통 안전수칙(문서 근거 없음): 제조사 매뉴얼과 현장 절차를 추가 확인"
DEFAULT = Rule("작업 조건 추가 확인 필요", "미분류", 2, 2, (), ("제조사·모델·부품번호 확인", "사업장 작업표준서와 담당자 확인"), ("설비·부품·에너지원과 작업 절차를 추가로 확인합니다.", "근거 문서가 연결되기 전에는 작업 가능 여부를 확정하지 않습니다."))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """A row for each rule: a fixed parameter of a few rows."""
    rows = [(i, r.name, r.accident_type, r.likelihood, r.severity, list(r.keywords), list(r.checklist)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, name string, accident_type string, likelihood int, severity int, keywords array<string>, checklist array<string>")


def hazards(requests: DataFrame, rules: tuple[Rule, ...] = RULES, default: Rule = DEFAULT, key: str = "request_id", text: str = "text") -> DataFrame:
    """(key, rule) of every rule with a keyword in the lower-cased text, else the default; scored.

    The rules are folded into one expression over the row, so requests are read once and nothing
    is joined or shuffled.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    struct = lambda i, r: F.struct(F.lit(i).alias("rule"), F.lit(r.name).alias("name"), F.lit(r.accident_type).alias("accident_type"), F.lit(r.likelihood).alias("likelihood"), F.lit(r.severity).alias("severity"), F.array(*map(F.lit, r.checklist)).cast("array<string>").alias("checklist"), F.array(*map(F.lit, r.safety)).cast("array<string>").alias("safety_actions"))
    found = []
    for i, r in enumerate(rules):
        hit = F.lit(False)
        for k in r.keywords:
            hit |= low.contains(k)
        found.append(F.when(hit, struct(i, r)))
    matched = F.array_compact(F.array(*found))
    matched = F.when(F.size(matched) == 0, F.array(struct(-1, default))).otherwise(matched)
    rows = requests.select(key, F.explode(matched).alias("r")).select(key, "r.*")
    score = F.col("likelihood") * F.col("severity")
    return rows.withColumn("score", score).withColumn("risk_level", risk_level(score))


def evidence_actions(evidence: DataFrame, key: str = "request_id", most: int = 3) -> DataFrame:
    """(key, actions): for the first pieces of evidence (retrieval_rank, title, page_start) that the original is to be compared with."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("retrieval_rank", "title"))
    first = evidence.withColumn("n", n).where(F.col("n") <= most)
    page = F.when(F.coalesce("page_start", F.lit(0)) != 0, F.concat(F.lit(" ("), F.col("page_start").cast("string"), F.lit("쪽)"))).otherwise("")
    said = F.concat(F.lit("근거 ["), F.col("retrieval_rank").cast("string"), F.lit("] "), F.col("title"), page, F.lit("의 관련 절차를 원문과 대조합니다."))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", said.alias("said")))), lambda x: x["said"]).alias("actions"))


def with_evidence(found: DataFrame, evidence: DataFrame, key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Hazards with their evidence's actions after their own, each once; and (key, sequence, item) of the whole checklist.

    A request without evidence has the common rule as the last item of its checklist.
    """
    actions = evidence_actions(evidence, key)
    more = F.coalesce("actions", F.array().cast("array<string>"))
    rows = found.join(actions, key, "left").withColumn("safety_actions", F.array_distinct(F.concat("safety_actions", more))).drop("actions")
    own = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rule", "checklist"))), lambda x: x["checklist"]))
    items = found.groupBy(key).agg(own.alias("own")).join(actions, key, "left")
    whole = F.array_distinct(F.concat("own", F.coalesce("actions", F.array(F.lit(NO_EVIDENCE)))))
    return rows, items.select(key, F.posexplode(whole).alias("pos", "item")).select(key, (F.col("pos") + 1).alias("sequence"), "item")


def checklists(found: DataFrame, key: str = "request_id", most: int = 5) -> DataFrame:
    """Ordered distinct items over a request's rules, numbered from 1."""
    items = found.select(key, "rule", F.posexplode("checklist").alias("pos", "item"))
    first = items.groupBy(key, "item").agg(F.min(F.struct("rule", "pos")).alias("at"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("at", "item"))
    return first.withColumn("sequence", n).where(F.col("sequence") <= most).select(key, "sequence", "item")


def in_blocks(left: DataFrame, right: DataFrame, key: list[str], most: int) -> DataFrame:
    """Inner join on equal keys; where a key has over `most` rows on the right, they are dealt to several tasks.

    The left side keeps as many partitions as the session shuffles to: few bytes may make many rows here, which
    Spark cannot know when it merges small partitions.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = right.groupBy(*key).count().where(F.col("count") > most).select(*key, F.ceil(F.col("count") / most).cast("int").alias("__blocks"))
    blocks = F.coalesce("__blocks", F.lit(1))
    plain = [f.name for f in right.schema.fields if isinstance(f.dataType, AtomicType)]
    dealt = right.join(F.broadcast(often), key, "left").withColumn("__block", F.pmod(F.xxhash64(*plain), blocks).cast("int")).drop("__blocks")
    every = left.join(F.broadcast(often), key, "left").withColumn("__block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("__blocks")
    return every.repartition(tasks, *key, "__block").join(dealt, [*key, "__block"]).drop(*key, "__block")


def within_radius(points: DataFrame, equipment: DataFrame, metres: float, digits: int | None = None, most: int = 10_000) -> DataFrame:
    """Equipment within a radius of each point, by haversine distance, which is then rounded to digits if given.

    Distances are taken and rounded once for each two positions, however many points and equipment share them.
    Both sides get cells at least a radius wide at their latitude, counted around the globe, and a position looks
    at its own and the eight around it, so candidates come from a join on equal keys instead of a product.
    """
    step = max(metres, 1.0) / METRES_PER_DEGREE * 1.01
    reach = math.sin(math.radians(min(step, 90.0)))

    def cells(band: Column) -> Column:
        """Around the globe; one where the radius takes in a pole."""
        least = F.cos(F.radians(F.least(F.greatest(F.abs(band * step), F.abs((band + 1) * step)), F.lit(90.0))))
        return F.when(least <= reach, F.lit(1).cast("long")).otherwise(F.floor(360 / F.degrees(F.asin(F.least(reach / least, F.lit(1.0))))))

    def positions(rows: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
        at = rows.select(F.col(lat).alias(f"{name}_lat"), F.col(lon).alias(f"{name}_lon")).distinct()
        return at.where(F.greatest(F.abs(f"{name}_lat"), F.abs(f"{name}_lon")) < float("inf"))

    def placed(rows: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
        """A hash of the position to join by, as floating keys would be shuffled twice; the positions themselves are compared then."""
        return rows.withColumn(name, F.xxhash64(lat, lon))

    to = positions(equipment, "lat", "lon", "__to").withColumn("cy", F.floor(F.col("__to_lat") / step))
    to = to.withColumn("cx", F.pmod(F.floor(F.col("__to_lon") * cells(F.col("cy")) / 360), cells(F.col("cy"))))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    looked = positions(points, "point_lat", "point_lon", "__at").withColumn("dy", F.explode(near)).withColumn("cy", F.floor(F.col("__at_lat") / step) + F.col("dy")).withColumn("n", cells(F.col("cy")))
    own = F.floor(F.col("__at_lon") * F.col("n") / 360)
    looked = looked.withColumn("cx", F.explode(F.array_distinct(F.transform(near, lambda d: F.pmod(own + d, F.col("n")))))).drop("dy", "n")
    distance = haversine_m(F.col("__at_lat"), F.col("__at_lon"), F.col("__to_lat"), F.col("__to_lon"))
    pairs = in_blocks(looked, to, ["cy", "cx"], most).withColumn("distance_m", distance).where(F.col("distance_m") <= metres)
    if digits is not None:
        pairs = pairs.withColumn("distance_m", F.round("distance_m", digits))
    same = lambda a, b: (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b))  # noqa: E731  not taken for a key
    pairs = placed(placed(pairs, "__at_lat", "__at_lon", "__at"), "__to_lat", "__to_lon", "__to")
    pairs = in_blocks(pairs, placed(equipment, "lat", "lon", "__to"), ["__to"], most).where(same("__to_lat", "lat") & same("__to_lon", "lon"))
    found = in_blocks(pairs, placed(points, "point_lat", "point_lon", "__at"), ["__at"], most).where(same("__at_lat", "point_lat") & same("__at_lon", "point_lon"))
    return found.select(*points.columns, *equipment.columns, "distance_m")


def first_known(*choices: Column) -> Column:
    """Code, then type, then default."""
    return F.coalesce(*choices)
