"""Answer cards: which texts may stand on one, how candidates are scored, and how they are phrased.

All are expressions over one row but `sentence_candidates`, which unfolds sources. NULL text counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.repair import repair_quantities
from tessellar.functions.text import sentences

# What marks an item as no content, signal words of each kind, words without meaning.
META = ("근거를 원문에서 확인", "문서 id", "문서 버전", "사용자 매뉴얼", ".pdf")
BAD_STARTS = ("은 ", "는 ", "이 ", "가 ", "을 ", "를 ", "에 ", "에서 ", "후에", "특히 ")
BAD_ENDS = ("...", "예.", "후에", "직", "및", "또는")
GENERIC_ANSWERS = (
    "검색된 근거를 기준으로 작업 전 확인할 핵심 사항을 요약했습니다.",
    "검색된 문서 근거를 기준으로 유지보수 시 확인할 사항을 정리했습니다.",
    "검색된 문서 근거를 기준으로 확인 가능한 내용을 요약했습니다.",
    "검색된 문서 근거를 기준으로 질문과 관련된 내용을 요약했습니다.",
    "검색된 문서 근거에서 확인되는 부품 정보를 정리했습니다.",
    "검색된 문서 근거를 기준으로 부품 정보를 요약했습니다.",
)
CARD_LENGTH = 34
PRECHECK = tuple("광축,투광부,수광부,투광기,수광기,반응,안전거리,방호구역,방호높이,검출성능,검출거리,검출 거리,설정거리,설정 거리,검출체,검출면,주위금속,주위 금속,대향,병렬,주파수 간섭,정격,고정 브라켓,스패터,급정지기구,OSSD,확인,점검,검사,준비,설정,정상,동작,상태,교육,자격,안전거리,작업 전,before,check,inspect,verify".split(","))
ACTION = tuple("광축 투광부 수광부 반응 안전거리 방호구역 OSSD 설치 교체 점검 검사 청소 세척 조정 설정 정렬 분리 연결 체결 고정 브라켓 배선 제거 보수 정비 install replace inspect check clean adjust set connect remove".split())
HAZARD = tuple("위험 주의 경고 사고 끼임 협착 감전 화재 폭발 추락 낙하 오동작 복귀불량 간섭 노이즈 스패터 무효 손상 부상 위험구역 hazard danger warning caution accident".split())
STOP = tuple("중지 정지 비상정지 즉시 금지 보고 이상 불가 고장 복귀불량 오동작 간섭 해제 위험구역 stop emergency fault abnormal".split())
REFERENCE = tuple("법 기준 규정 지침 대책 사례 사고 예방 보호 조치 standard guide incident".split())
#: A word of several kinds counts once for each.
SIGNALS = PRECHECK + ACTION + HAZARD + STOP + REFERENCE
STOPWORDS = tuple("그거 관련 방법 내용 대해 알려줘 알려줄래 알려주세요 해야 하려고 예정 어떻게 무슨 뭐야 무엇 정의 설명 알려 사용 용도 작업 설비 기계 the and for with".split())
GROUP_BONUS = {"incident": 0.08, "public_safety": 0.04}
#: Endings of an action phrase and what is left of them; then endings that take "하기", and others.
ENDINGS = ((r"\s*(?:을|를)?\s*확인합니다\.?$", " 확인"), (r"\s*(?:을|를)?\s*점검합니다\.?$", " 점검"), (r"\s*(?:을|를)?\s*검사합니다\.?$", " 검사"), (r"(?:하십시오|합니다|하세요|한다|할 것|해야 함|하여야 함)\.?$", ""))
DONE = "(?:하기|않기|말기)$"
TO_DO = "(?:확인|점검|검사|시험|측정|정렬|교육|방지|금지|준수|유지|확보)$"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def bad_card(text: Column, bounded: bool = True) -> Column:
    """Empty, a stock answer, a torn beginning or end, an ellipsis or, if bounded, long without a polite end."""
    t = squeezed(text)
    torn = _any([t.startswith(x) for x in BAD_STARTS] + [t.endswith(x) for x in BAD_ENDS])
    out = (t == "") | t.isin(*GENERIC_ANSWERS) | torn | t.contains("...")
    return out | ((F.length(t) > CARD_LENGTH) & ~t.endswith("니다.")) if bounded else out


def meta_item(text: Column) -> Column:
    low = F.lower(squeezed(text))
    return _any([low.contains(x) for x in META])


def meaningful(text: Column) -> Column:
    """Six characters or more, some letter among them."""
    t = squeezed(text)
    return (F.length(t) >= 6) & t.rlike("[A-Za-z가-힣]")


def relevance_terms(text: Column) -> Column:
    """Distinct lower-case words of two characters or more that mean something."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([0-9a-z가-힣_-]+)"), 1)
    bare = F.transform(words, lambda w: F.regexp_replace(w, "^[_-]+|[_-]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS)))


def hits(words: tuple[str, ...], low: Column) -> Column:
    """How many of the words occur in lower-case text."""
    return sum((F.when(low.contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))


def candidate_score(text: Column, asked: Column, source: Column, place: Column) -> Column:
    """The source's score, the share of asked words, up to five signal words, an early place, less a long text."""
    t = F.coalesce(text, F.lit(""))
    overlap = F.size(F.array_intersect(asked, relevance_terms(t))) / F.greatest(F.size(asked), F.lit(1))
    signals = F.least(hits(SIGNALS, F.lower(t)), F.lit(5)) * 0.05
    early = F.greatest(F.lit(0.0), 0.08 - place * 0.01)
    return source + overlap * 0.6 + signals + early - F.when(F.length(t) <= 90, 0.0).otherwise(0.08)


def card_score(text: Column, score: Column, group: Column, terms: tuple[str, ...], action: bool) -> Column:
    """A candidate's score for one card: up to six of its terms, up to four action words, the kind of source."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bonus = F.lit(0.0)
    for name, value in GROUP_BONUS.items():
        bonus = F.when(group == name, value).otherwise(bonus)
    return score + F.least(hits(terms, low), F.lit(6)) * 0.12 + F.least(hits(ACTION, low), F.lit(4)) * (0.06 if action else 0.025) + bonus


def sentence_candidates(sources: DataFrame, asked: Column) -> DataFrame:
    """(id, grp, content, score): profile values of manuals (+0.22), titles of other kinds (+0.18), sentences.

    sources: id, grp (pdf, public_safety, incident, company, other), score, title, profile (array of
    strings) and excerpt. NULL arrays and texts give nothing; equal candidates all stay; no order.
    """
    given = F.transform(F.when(F.col("grp") == "pdf", F.col("profile")), lambda v: F.struct(v.alias("content"), F.lit(0.22).alias("more"), F.lit(-1).alias("place")))
    title = F.when(F.col("grp").isin("public_safety", "incident", "company"), F.array(F.struct(squeezed(F.col("title")).alias("content"), F.lit(0.18).alias("more"), F.lit(-2).alias("place"))))
    units = F.filter(F.transform(sentences(repair_quantities(squeezed(F.col("excerpt")))), lambda s: F.trim(s)), lambda s: s != "")
    parts = F.transform(units, lambda s, i: F.struct(s.alias("content"), F.lit(0.0).alias("more"), i.alias("place")))
    kept = F.concat(*(F.coalesce(x, F.array().cast("array<struct<content:string,more:double,place:int>>")) for x in (given, title, parts)))
    rows = sources.select("id", "grp", F.col("score").alias("base"), F.explode(kept).alias("c"), asked.alias("asked")).select("id", "grp", "base", "asked", "c.*")
    rows = rows.where(meaningful(F.col("content")) & ((F.col("place") == -1) | ~meta_item(F.col("content"))))
    whole = candidate_score(F.col("content"), F.col("asked"), F.col("base"), F.col("place"))
    return rows.select("id", "grp", "content", F.when(F.col("place") < 0, F.col("base") + F.col("more")).otherwise(whole).alias("score"))


def card_phrase(text: Column, rules: list[tuple[tuple[str, ...], str]]) -> Column:
    """The phrase of the first rule all of whose words occur, else the first three words that mean
    something and are no polite ending; empty for what may not stand on a card."""
    clean = F.regexp_replace(squeezed(text), r"^[ \-•*\[\]()]+|[ \-•*\[\]()]+$", "")

    def phrase(one: Column) -> Column:
        words = F.filter(F.regexp_extract_all(one["text"], F.lit("([0-9A-Za-z가-힣]+)"), 1), lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*STOPWORDS) & ~w.rlike("(?:하십시오|합니다)$"))
        short = F.rtrim(F.substring(F.array_join(F.slice(words, 1, 3), " "), 1, CARD_LENGTH))
        out = F.when(bad_card(short), "").otherwise(short)
        for terms, said in reversed(rules):
            out = F.when(reduce(lambda a, b: a & b, (one["low"].contains(t.lower()) for t in terms)), said).otherwise(out)
        return F.when(bad_card(one["text"], bounded=False), "").otherwise(out)

    # one element, so that every rule shares the cleaned and the lower-case text
    return F.transform(F.array(F.struct(clean.alias("text"), F.lower(clean).alias("low"))), phrase)[0]


def action_phrase(text: Column, known: dict[str, tuple[str, ...]] | None = None) -> Column:
    """What is to be done, ending in "하기": the phrase of the first known kind with a word in the text,
    else its own words without their polite ending; empty for empty text."""
    body = F.regexp_replace(squeezed(text), r"^[ .]+|[ .]+$", "")
    for pattern, rest in ENDINGS:
        body = F.regexp_replace(body, f"(?U){pattern}", rest)
    body = F.regexp_replace(body, r"^[ .]+|[ .]+$", "")
    plain = F.replace(body, F.lit("/재가동 방지"), F.lit(" 및 재가동 방지"))
    done = F.when(body.contains("위험요인") & body.endswith("않기"), "위험요인과 통제조치 공유하기").otherwise(body)
    out = F.when(body.rlike(DONE), done).when(plain.rlike(TO_DO), F.concat(plain, F.lit("하기"))).when(plain.endswith("적합"), F.concat(plain, F.lit(" 여부 확인하기"))).otherwise(F.concat(plain, F.lit(" 확인하기")))
    for said, words in reversed((known or {}).items()):
        out = F.when(_any([F.lower(body).contains(w.lower()) for w in words]), said).otherwise(out)
    return F.when(body == "", "").otherwise(out)
