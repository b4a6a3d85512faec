"""Document profiles: names that a document goes by, and profiles brought into bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nouns that end an alias, words that are none, places of each field.
SUFFIXES = tuple("센서 스위치 장치 모듈 컨트롤러 케이블 커튼 베어링 모터 펌프 밸브 실린더 로봇 컨베이어 프레스 브라켓 커버 기구 부품 컴포넌트 차단기 릴레이 드라이버 인버터 설비 장비 기계".split())
STOPWORDS = tuple(
    "how method please safety work 작업 방법 안전 관련 문서 요약 요약해 요약해줘 정리 정리해 정리해줘 내용 파일 첨부 첨부한 확인 확인해줘 확인해 "
    "교체 교체법 교체작업 교체할 청소 청소법 청소할 점검 점검할 정비 설치 설치법 설치시 설치할 설치하려 설치하려고 설치하기 주의사항 주의 절차 "
    "알려줘 알려주세요 알려 설명 어디에 쓰는 사용 용도 거야 할거야 예정 예정이야 뭐야 무엇 무엇이야 뭔지 뭐하는 정의 해주세요 하려고 합니다 할게 "
    "내부 내부를 어떻게 replacement installation 어디 확인사항 "
    "manual series model version pdf ko kr user guide catalog 제품 매뉴얼 사용설명서 취급설명서 설명서 카탈로그 시리즈 버전".split()
)
TOO_PLAIN = ("제품", "장비", "설비", "기계", "문서", "매뉴얼", "사용 설명서")
PLAIN_VALUES = ("제품", "문서", "매뉴얼", "장비", "기계", "설비")
FIELDS = {"product_names": 12, "model_names": 12, "aliases": 20, "equipment": 20, "components": 30, "supported_tasks": 20, "safety_topics": 20, "summary_points": 8, "document_keywords": 30, "extraction_notes": 8}
WITH_FALLBACK = ("product_names", "model_names", "aliases", "document_keywords")

_WORD = "[0-9A-Za-z가-힣□·/()+_-]+"
PHRASE = rf"(?iU)({_WORD}(?:\s+{_WORD}){{0,4}}\s*(?:{'|'.join(SUFFIXES)}))"
SPEC = r"(?iU)\b((?:(?:AC|DC)?\s*\d+\s*선식|[0-9]+\s*[-~]\s*[0-9]+\s*V|[0-9]+\s*wire))\b"
MODEL = r"(?<![A-Za-z0-9])([A-Za-z]{1,8}[A-Za-z0-9]{0,16})(?![A-Za-z0-9])"
JOINED = r"(?<![A-Za-z0-9])([A-Za-z]{1,8}[A-Za-z0-9_-]{1,24})(?![A-Za-z0-9])"


def _plain(value: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), r"^[ .,:;·\-/\[\]()]+|[ .,:;·\-/\[\]()]+$", "")
    return F.regexp_replace(bare, r"^(?:제품|문서|매뉴얼|시리즈) ", "")


def _useful(values: Column) -> Column:
    """Values as names, the first of equal ones: 2 to 48 characters, not made of words that are none alone."""

    def good(v: Column) -> Column:
        words = F.filter(F.regexp_extract_all(F.lower(v), F.lit("([0-9a-z가-힣□_-]+)"), 1), lambda w: F.length(w) >= 2)
        said = F.exists(words, lambda w: ~w.isin(*STOPWORDS))
        return F.length(v).between(2, 48) & said & ~v.isin(*TOO_PLAIN)

    return F.array_distinct(F.filter(F.transform(values, _plain), good))


def alias_candidates(text: Column) -> Column:
    """Phrases that end in a noun of equipment, then wirings and voltages, as they stand in the text."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(F.regexp_extract_all(t, F.lit(PHRASE), 1), F.regexp_extract_all(t, F.lit(SPEC), 1))


def model_aliases(text: Column) -> Column:
    """Tokens in capitals or with digits, those of 2 to 8 characters also as a series; then joined ones."""
    t = F.coalesce(text, F.lit(""))
    telling = lambda w: ~F.lower(w).isin(*STOPWORDS) & ((F.upper(w) == w) | w.rlike("[0-9]"))
    single = F.filter(F.regexp_extract_all(F.translate(t, "_-", "  "), F.lit(MODEL), 1), telling)
    both = F.flatten(F.transform(single, lambda w: F.when(F.length(w).between(2, 8), F.array(w, F.concat(w, F.lit(" Series")))).otherwise(F.array(w))))
    joined = F.filter(F.regexp_extract_all(t, F.lit(JOINED), 1), lambda w: telling(F.regexp_replace(w, "^[_-]+|[_-]+$", "")))
    return _useful(F.concat(both, joined))


def aliases(text: Column) -> Column:
    """All useful names in a text, the first of equal ones."""
    return F.array_distinct(F.concat(_useful(alias_candidates(text)), model_aliases(text)))


def values(given: Column, most: int) -> Column:
    """Squeezed values without list marks, of at most 80 characters and more than a plain noun, distinct, the first ones."""
    bare = F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, r"(?U)\s+", " ")), r"^[ \-•*\[\]()]+|[ \-•*\[\]()]+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda v: v.isNotNull() & (v != "") & (F.length(v) <= 80) & ~v.isin(*PLAIN_VALUES))), 1, most)


def normalise(rows: DataFrame, fallback: str = "fallback") -> DataFrame:
    """Every field of FIELDS that rows have within its places; some are filled up from `fallback`, a struct
    of like-named arrays; confidence (text or number) between 0 and 1, NULL for anything else."""
    out = rows
    spare = {f.name for f in rows.schema[fallback].dataType.fields} if fallback in rows.columns else set()
    for name, most in FIELDS.items():
        if name not in rows.columns:
            continue
        own = values(F.col(name), most)
        if name in WITH_FALLBACK and name in spare:
            more = F.transform(F.coalesce(F.col(f"{fallback}.{name}"), F.array().cast("array<string>")), lambda v: F.trim(F.regexp_replace(v, r"(?U)\s+", " ")))
            own = F.slice(F.array_distinct(F.concat(own, F.filter(more, lambda v: v != ""))), 1, most)
        out = out.withColumn(name, own)
    if "confidence" in rows.columns:
        number = F.expr("try_cast(confidence as double)")
        out = out.withColumn("confidence", F.when(number.isNotNull() & ~F.isnan(number), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))))
    return out


def field(item: Column, *names: str) -> Column:
    """The value of the first name that a map has, else of the first whose letters and digits a key has; NULL if none."""
    bare = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    exact = loose = F.lit(None)
    for name in reversed(names):
        wanted = "".join(c for c in name.lower() if c.isascii() and c.isalnum())
        found = F.filter(F.map_entries(item), lambda e: bare(e["key"]) == wanted)  # noqa: B023
        loose = F.when(F.size(found) > 0, F.element_at(found, -1)["value"]).otherwise(loose)
        exact = F.when(F.map_contains_key(item, name), F.try_element_at(item, F.lit(name))).otherwise(exact)
    present = F.lit(False)
    for name in names:
        present |= F.map_contains_key(item, name)
    return F.when(present, exact).otherwise(loose)


def safe_bool(value: Column, default: bool = False) -> Column:
    """Whether a text says yes; the default for NULL and empty text."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(F.lower(F.trim(value)).isin("1", "true", "y", "yes", "on"))
