"""Queries over repaired texts, answer cards, profiles and accident quality with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.functions import repair as R
from tessellar.operators import accidents as D
from tessellar.operators import cards as C
from tessellar.operators import profiles as P
from tessellar.operators import quality as Q
from tessellar.plans.base import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def pick(key: str, texts: list):
    """One of the texts by key modulo their number."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))


def sql_pick(key: str, texts: list) -> str:
    return "[" + ",".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in texts) + f"][{key} % {len(texts)} + 1]"


GLUED = ["공정에서재해자가 다침", "작업 중이던 작업자가사다리에서", "넘어져서 다침", "지게차가넘어져손을", "탑승하여야 함", "(월)10:30경서울  강남구 소재OO공사현장3층계단에서철거공사", "작업 중인접한 설비", "", None]
WHOLE = ["공정에서 재해자가 다침", "작업 중이던 작업자가 사다리에서", "넘어져서 다침", "지게차가 넘어져 손을", "탑승하여야 함", "(월) 10:30경 서울 강남구 소재 OO 공사현장 3층 계단에서 철거공사", "작업 중 인접한 설비", "", None]
RULES = ["locative_subject", "subject_boundary", "", "fall_result,forklift_subject", "", "compact_domestic_accident_header", "during_adjacent", "", ""]


@query("glued_repair", f"SELECT o_orderkey, {sql_pick('o_orderkey', WHOLE)} || ' ' || o_orderpriority AS text, {sql_pick('o_orderkey', RULES)} AS rules, '' AS left_over FROM orders")
def glued_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(pick("o_orderkey", GLUED), F.lit(" "), "o_orderpriority").alias("t"))
    joined = lambda c: F.array_join(R.glued_left(c), ",")
    whole = R.repair_glued(F.col("t"))
    return rows.select("o_orderkey", whole.alias("text"), joined(F.col("t")).alias("rules"), joined(whole).alias("left_over"))


@query("quantity_repair", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '심호흡(5~' || (o_orderkey % 9 + 6) || '초 이상)을 3회 이상 반복' WHEN 1 THEN '심호흡(' || (o_orderkey % 9) || '분 이상)을 2회 이상 반복, 끝' ELSE '초 이상 3 반복 ' || o_orderpriority END AS text FROM orders")
def quantity_repair(spark, sf_dir):
    k = F.col("o_orderkey")
    odd = F.when(k % 3 == 0, F.concat(F.lit("심호흡 초 이상 을 회 이상 (5 ~ "), k % 9 + 6, F.lit(" ) 3 반복"))).when(k % 3 == 1, F.concat(F.lit("심호흡 분  이상 을 회 이상 ( "), k % 9, F.lit(" )2 반복, 끝"))).otherwise(F.concat(F.lit("초 이상 3 반복 "), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.repair_quantities(odd).alias("text"))


@query("region_names", f"SELECT s_suppkey, {sql_pick('s_suppkey', ['서울특별시', '경기도', '전북특별자치도', '강원특별자치도', '제주특별자치도', None, None, '충청남도'])} AS province FROM supplier")
def region_names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.province(pick("s_suppkey", ["서울", "경기", " 전라북도", "강원도", "제주특별자치도", "대마도", None, "충남 "])).alias("province"))


SQUEEZED = "trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g'))"
CARD_TEXTS = ["", None, "후에 확인", "정지 및", "1 2 3 4 5 6", "사용자  매뉴얼 참조", "전원을 차단합니다.", "..."]


@query(
    "card_filters",
    f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), m AS (SELECT doc_id, pos, line, coalesce({sql_pick('(doc_id + pos)', CARD_TEXTS)}, '') AS more FROM l), "
    f"r AS (SELECT doc_id, pos, CASE (doc_id + pos) % 5 WHEN 0 THEN more || ' ' || line WHEN 1 THEN line || ' ' || more WHEN 2 THEN right(line, 20) || more ELSE line END AS t FROM m), s AS (SELECT doc_id, pos, {SQUEEZED} AS s FROM r), "
    "b AS (SELECT *, s = '' OR contains(s, '...') OR regexp_matches(s, '^(은|는|이|가|을|를|에|에서|특히) ') OR starts_with(s, '후에') OR regexp_matches(s, '(예[.]|후에|직|및|또는)$') AS torn FROM s) "
    "SELECT doc_id, pos, torn OR (length(s) > 34 AND NOT ends_with(s, '니다.')) AS bad, torn AS bad_unbounded, contains(lower(s), '문서 id') OR contains(lower(s), '사용자 매뉴얼') OR contains(lower(s), '.pdf') AS meta, length(s) >= 6 AND regexp_matches(s, '[A-Za-z가-힣]') AS meaningful FROM b",
)
def card_filters(spark, sf_dir):
    """Every line of every text, some with what tells bad cards before or after it, some with it after their last 20 characters."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("pos"), "line")
    k, line = F.col("doc_id") + F.col("pos"), F.col("line")
    more = F.coalesce(F.element_at(F.array(*map(F.lit, CARD_TEXTS)), (k % len(CARD_TEXTS) + 1).cast("int")), F.lit(""))
    mixed = F.when(k % 5 == 0, F.concat(more, F.lit(" "), line)).when(k % 5 == 1, F.concat(line, F.lit(" "), more)).when(k % 5 == 2, F.concat(F.expr("right(line, 20)"), more)).otherwise(line)
    t = F.col("t")
    return lines.select("doc_id", "pos", mixed.alias("t")).select("doc_id", "pos", C.bad_card(t).alias("bad"), C.bad_card(t, False).alias("bad_unbounded"), C.meta_item(t).alias("meta"), C.meaningful(t).alias("meaningful"))


def _hits(words: tuple[str, ...]) -> str:
    return "list_sum([" + ",".join(f"contains(lower(t), '{w.lower()}')::INT" for w in words) + "])"


ASKED = ["alpha", "tion", "check", "lens"]


@query(
    "card_scores",
    "WITH r AS (SELECT doc_id, coalesce(text, '') || ' check' AS t, doc_id % 10 AS place, CASE doc_id % 3 WHEN 0 THEN 'incident' WHEN 1 THEN 'public_safety' ELSE 'pdf' END AS grp FROM documents), "
    f"w AS (SELECT *, list_filter(list_transform(regexp_extract_all(lower(t), '[0-9a-z가-힣_-]+'), lambda x: regexp_replace(x, '^[_-]+|[_-]+$', '', 'g')), lambda x: length(x) >= 2) AS words FROM r), "
    f"s AS (SELECT *, 0.5 + len(list_filter({ASKED}, lambda x: list_contains(words, x))) / 4.0 * 0.6 + least({_hits(C.SIGNALS)}, 5) * 0.05 + greatest(0, 0.08 - place * 0.01) - CASE WHEN length(t) <= 90 THEN 0 ELSE 0.08 END AS score FROM w) "
    f"SELECT doc_id, round(score::DOUBLE, 6) AS score, round((score + least({_hits(C.STOP)}, 6) * 0.12 + least({_hits(C.ACTION)}, 4) * 0.06 + CASE grp WHEN 'incident' THEN 0.08 WHEN 'public_safety' THEN 0.04 ELSE 0 END)::DOUBLE, 6) AS card_score FROM s",
)
def card_scores(spark, sf_dir):
    k = F.col("doc_id")
    group = F.when(k % 3 == 0, "incident").when(k % 3 == 1, "public_safety").otherwise("pdf")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" check")).alias("t"), group.alias("grp"))
    score = C.candidate_score(F.col("t"), F.array(*map(F.lit, ASKED)), F.lit(0.5), k % 10)
    return rows.select("doc_id", F.round(score, 6).alias("score"), F.round(C.card_score(F.col("t"), score, F.col("grp"), C.STOP, True), 6).alias("card_score"))


PHRASE_RULES = [(("대향", "병렬"), "대향·병렬 설치 간섭거리 확인"), (("전원", "차단"), "전원 차단 확인"), (("설치",), "설치 조건 확인")]
SAID = ["대향 또는 병렬로 설치하는 경우", " - 설치 전 전원을 차단한다", "설치 조건", "윤활유 상태와 누유 여부를 봅니다", "특히 전원 차단", "작업 방법 합니다", None]
SHOWN = ["대향·병렬 설치 간섭거리 확인", "전원 차단 확인", "설치 조건 확인", "윤활유 상태와 누유", "", "", ""]
DO = ["전원 램프를 확인합니다.", "벨트 장력 점검", "표지 부착하십시오", "기준 적합", "위험요인에 다가가지 않기", "정지/재가동 방지", " . ", None]
DONE = ["전원 램프 확인하기", "벨트 장력 점검하기", "표지 부착 확인하기", "기준 적합 여부 확인하기", "위험요인과 통제조치 공유하기", "정지 및 재가동 방지하기", "", ""]


@query("card_phrases", f"SELECT p_partkey, {sql_pick('p_partkey', SHOWN)} AS phrase, CASE WHEN p_partkey % 9 = 0 THEN '전원 차단 후 잠금·표지 부착 상태 확인하기' ELSE {sql_pick('p_partkey', DONE)} END AS action FROM part")
def card_phrases(spark, sf_dir):
    todo = F.when(F.col("p_partkey") % 9 == 0, "Lockout 상태를 점검합니다").otherwise(pick("p_partkey", DO))
    known = {"전원 차단 후 잠금·표지 부착 상태 확인하기": ("전원 차단", "전원을 차단", "잠금", "lockout")}
    return table(spark, sf_dir, "part").select("p_partkey", C.card_phrase(pick("p_partkey", SAID), PHRASE_RULES).alias("phrase"), C.action_phrase(todo, known).alias("action"))


@query("sentence_candidates", "SELECT s_suppkey AS id, c.content, round((0.25 + c.more)::DOUBLE, 6) AS score FROM (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 2 = 0 THEN [{'content': 'lens cover ' || s_suppkey, 'more': 0.22}, {'content': 'The lens of ' || s_suppkey || ' is dirty.', 'more': 0.6 / 2 + 0.08}, {'content': 'Please verify it.', 'more': 0.05 + 0.07}] ELSE [{'content': s_name || ' case', 'more': 0.18}, {'content': 'The lens of ' || s_suppkey || ' is dirty.', 'more': 0.6 / 2 + 0.08}, {'content': 'Please verify it.', 'more': 0.05 + 0.07}] END) AS c FROM supplier)")
def sentence_candidates(spark, sf_dir):
    k = F.col("s_suppkey")
    excerpt = F.concat(F.lit("The lens of "), k, F.lit(" is dirty.  Please verify it. See a.pdf now! 12 34 56."))
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 2 == 0, "pdf").otherwise("incident").alias("grp"), F.lit(0.25).alias("score"), F.concat("s_name", F.lit("  case")).alias("title"), F.array(F.concat(F.lit("lens cover "), k), F.lit("x"), F.lit(None)).alias("profile"), excerpt.alias("excerpt"))
    return C.sentence_candidates(rows, F.array(F.lit("lens"), F.lit("motor"))).select("id", "content", F.round("score", 6).alias("score"))


@query("alias_candidates", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'GL-' || s_suppkey || 'R 근접 센서|AC 3 선식|GL|GL Series|AC|AC Series|GL-' || s_suppkey || 'R' WHEN 1 THEN '12-24V' ELSE '' END AS names FROM supplier")
def alias_candidates(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("GL-"), k, F.lit("R 근접 센서, AC 3 선식"))).when(k % 3 == 1, F.lit("정격: 12-24V. 장비, the manual")).otherwise(F.lit("제품 문서 manual"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(P.aliases(text), "|").alias("names"))


@query("profile_normalise", "SELECT event_id, [event_type, 'b c', 'n' || (event_id % 7)] AS aliases, ['part ' || (event_id % 3)] AS equipment, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.25 END AS confidence FROM events")
def profile_normalise(spark, sf_dir):
    k = F.col("event_id")
    aliases = F.array(F.concat(F.lit(" - "), "event_type", F.lit(" ")), F.lit("제품"), F.lit(None), F.lit("b  c"), F.col("event_type"), F.repeat(F.lit("x"), F.lit(81)))
    fallback = F.struct(F.array(F.lit("b c"), F.lit("  "), F.concat(F.lit("n"), k % 7)).alias("aliases"))
    many = F.concat(F.array_repeat(F.concat(F.lit("[part "), k % 3, F.lit("]")), F.lit(25)), F.array(F.lit("기계")))
    confidence = F.when(k % 4 == 0, "1.7").when(k % 4 == 1, "-3").when(k % 4 == 2, "0.25").otherwise("high")
    rows = table(spark, sf_dir, "events").select("event_id", aliases.alias("aliases"), many.alias("equipment"), confidence.alias("confidence"), fallback.alias("fallback"))
    return P.normalise(rows).drop("fallback")


@query("field_lookup", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'b' || event_id WHEN 2 THEN NULL ELSE NULL END AS v, CASE WHEN event_id % 5 = 0 THEN true WHEN event_id % 5 < 3 THEN event_id % 5 = 1 ELSE event_id % 5 = 4 END AS yes FROM events")
def field_lookup(spark, sf_dir):
    k = F.col("event_id")
    m = lambda *kv: F.create_map(*(x if not isinstance(x, str) else F.lit(x) for x in kv))
    item = F.when(k % 4 == 0, m("docId", F.col("event_type"), "DOC_ID", "z")).when(k % 4 == 1, m("DOC-ID", "first", "Doc_Id", F.concat(F.lit("b"), k))).when(k % 4 == 2, m("docId", F.lit(None).cast("string"), "document_id", "no")).otherwise(m("other", "o"))
    flag = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, " Yes").when(k % 5 == 2, "maybe").when(k % 5 == 3, "0").otherwise("ON")
    return table(spark, sf_dir, "events").select("event_id", P.field(item, "docId", "document_id").alias("v"), P.safe_bool(flag, True).alias("yes"))


@query(
    "accident_quality",
    "SELECT count(*) AS rows, count(*) FILTER (WHERE k % 7 = 0) AS missing_required_rows, count(*) FILTER (WHERE k % 5 = 0) AS null_literal_rows, count(*) FILTER (WHERE k % 5 = 1) AS html_residue_rows, count(*) FILTER (WHERE k % 5 IN (1, 2)) AS html_or_control_rows, "
    "count(*) FILTER (WHERE k % 6 IN (0, 1)) AS metadata_contamination_rows, count(*) FILTER (WHERE k % 8 IN (0, 1)) AS invalid_iso_date_rows, count(*) FILTER (WHERE k % 7 = 1 AND k % 8 <> 2) AS non_accident_date_rows, count(*) FILTER (WHERE k % 3 = 0) AS location_component_errors, "
    "count(*) FILTER (WHERE k % 5 = 3) AS glued_boundary_rows, count(*) FILTER (WHERE k % 5 = 4) AS double_space_rows, count(*) FILTER (WHERE k % 7 = 2) AS joined_gyeonggi_gwangju_errors, false AS passed FROM (SELECT o_orderkey AS k FROM orders)",
)
def accident_quality(spark, sf_dir):
    k = F.col("k")
    text = F.element_at(F.array(*map(F.lit, [" NULL ", "a <BR> b", "a\x01b", "작업자가넘어짐", "※  위 사고"])), (k % 5 + 1).cast("int"))
    title = F.when(k % 7 == 0, " ").when(k % 7 == 1, "안전 교육 자료").when(k % 7 == 2, "[3/4, 경기 광주시] 추락").otherwise("추락")
    date = F.when(k % 8 == 0, "2021-02-30").when(k % 8 == 1, "2021.2.3").when(k % 8 == 2, F.lit(None)).otherwise("2021-02-03")
    field = F.when(k % 6 == 0, "제조 공 정 : x").when(k % 6 == 1, "a\nb").when(k % 6 == 2, F.lit(None)).otherwise("제조업")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select("k", text.alias("text"), title.alias("title"), date.alias("date"), field.alias("business"), F.lit("서울특별시").alias("sido"), F.when(k % 3 == 1, "강남구").alias("sigungu"), F.when(k % 3 == 0, "서울").when(k % 3 == 1, "서울특별시 강남구").otherwise("서울특별시").alias("place"))
    return Q.counters(rows, Q.accident_rules("k", "title", "text", "date", ["business"], ["sido", "sigungu"], "place"))


L = "length(coalesce(text, ''))"


@query(
    "broken_fonts",
    f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 3 * {L} >= 50 AND {L} >= 5 AND 3 * {L} + length(regexp_replace(coalesce(text, ''), '\\P{{L}}', '', 'g')) >= 100 WHEN 1 THEN length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) <= 950 ELSE false END AS broken FROM documents",
)
def broken_fonts(spark, sf_dir):
    """A third to a half of foreign letters of three scripts, 50 lost characters, 49 of them, foreign letters of two scripts."""
    k, own = F.col("doc_id"), F.coalesce("text", F.lit(""))
    size = F.length(own)
    more = F.when(k % 4 == 0, F.repeat(F.lit("कকક"), size)).when(k % 4 == 1, F.repeat(F.lit("�"), F.lit(50))).when(k % 4 == 2, F.repeat(F.lit("�"), F.lit(49))).otherwise(F.repeat(F.lit("कক"), size))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(own, more).alias("t")).select("doc_id", D.broken_font_mapping(F.col("t")).alias("broken"))
