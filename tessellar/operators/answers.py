"""Answer-side operators: intents, sentence scoring, keyed dedupe, bullet collapse, tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.text import sentences
from tessellar.operators.chunking import table_records

# What a question must mention for each flag.
DOCUMENT = r"(?i)(?:이\s*)?(?:pdf|문서|파일|매뉴얼|설명서|도면|카탈로그)"
DOCUMENT_PURPOSE = r"(?i)(?:요약|개요|무슨\s*파일|문서\s*종류|작성일|버전|목차|내용|나와|있어|있는지|포함|언급|찾아|확인\s*가능|가능한\s*작업|몇\s*페이지|어느\s*페이지)"
ACTION = r"(?i)(?:설치|교체|점검|청소|정비|수리|조정|분해|조립|탈거|시운전|작업|보수|윤활|체결|배선|설정|사용|운전|작동|재기동|리셋|해제|install|replace|replacement|inspect|clean|maintenance|repair)"
ACTION_PURPOSE = r"(?i)(?:방법|절차|순서|주의|확인|위험|안전|작업\s*전|작업\s*중|해야|하려|할\s*때|어떻게|체크리스트|tbm|how|procedure|safety|risk)"
COMPONENT_PURPOSE = r"(?i)(?:무슨\s*(?:장비|부품|장치)|뭐야|뭐\s*하는\s*(?:장비|부품|장치)|무엇이야|정의|역할|기능|용도|어디에\s*(?:사용|쓰)|어떤\s*(?:장비|부품|장치)|왜\s*(?:사용|쓰)|what\s+is|what\s+does|where\s+is|purpose|function)"
GENERIC = r"(?i)(?:관련|대해|설명|알려\s*줘|알려\s*주세요|궁금)"
IN_SELECTED = r"(?:요약|내용|찾아|있어|나와|페이지|문서)"
PLAIN_ACTION = r"(?:작업|교체|설치|청소|점검|정비)"
#: Words that name no subject.
NO_SUBJECT = ("관련", "대해", "설명", "알려줘", "알려", "주세요", "주의", "주의사항", "방법", "절차", "안전", "문서", "요약", "내용")


def intents(questions: DataFrame, text: str, selected: Column) -> DataFrame:
    """Adds intent and confidence by fixed precedence; selected: whether documents are chosen. They count as
    a subject only if the question names one: a word of two characters or more that is not in NO_SUBJECT."""
    q = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")))
    flags = {n: q.rlike(p) for n, p in (("doc", DOCUMENT), ("doc_for", DOCUMENT_PURPOSE), ("act", ACTION), ("act_for", ACTION_PURPOSE), ("part_for", COMPONENT_PURPOSE), ("generic", GENERIC))}
    doc, doc_for, act, act_for, part_for, generic = flags.values()
    words = F.regexp_extract_all(q, F.lit("([0-9a-z가-힣_-]+)"), 1)
    subject = selected & F.exists(words, lambda w: (F.length(w) >= 2) & ~w.isin(*NO_SUBJECT))
    ladder = [
        (doc & doc_for, "document_qa", 0.96),
        (doc & selected & q.rlike(IN_SELECTED), "document_qa", 0.94),
        (part_for & ~act_for, "component_info", 0.94),
        (act_for & subject & ~doc, "maintenance_guide", 0.88),
        (act & (act_for | ~doc | q.rlike(PLAIN_ACTION)), "maintenance_guide", 0.92),
        (part_for, "component_info", 0.86),
        (doc, "document_qa", 0.72),
        (generic & subject, "component_info", 0.84),
        (generic | (F.size(F.split(q, " ")) <= 4), "clarification_required", 0.62),
    ]
    intent, confidence = F.lit("clarification_required"), F.lit(0.5)
    for condition, name, value in reversed(ladder):
        intent, confidence = F.when(condition, name).otherwise(intent), F.when(condition, value).otherwise(confidence)
    return questions.withColumn("intent", intent).withColumn("confidence", confidence)


def _scored(documents: DataFrame, key: str, text: str, terms: list[str], signals: list[str]) -> DataFrame:
    units = documents.select(key, F.posexplode(sentences(F.col(text))).alias("pos", "unit"))
    low = F.lower("unit")
    hits = lambda words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    return units.withColumn("term_hits", hits(terms)).withColumn("signal_hits", hits(signals))


def best_sentence(documents: DataFrame, key: str, text: str, terms: list[str], signals: list[str]) -> DataFrame:
    """The unit with the most covered terms, signals and early place; the earliest of equals."""
    rows = _scored(documents, key, text, terms, signals)
    score = F.col("term_hits") / max(len(terms), 1) + F.when(F.col("signal_hits") > 0, 0.3).otherwise(0.0) - 0.02 * F.col("pos")
    best = F.max_by(F.struct("pos", "unit", "score"), F.struct("score", -F.col("pos")))
    return rows.withColumn("score", F.round(score, 6)).groupBy(key).agg(best.alias("b")).select(key, "b.pos", F.trim("b.unit").alias("unit"), "b.score")


def top_sentences(documents: DataFrame, key: str, text: str, terms: list[str], signals: list[str], n: int) -> DataFrame:
    """The n best units of each document, put back in text order and joined."""
    rows = _scored(documents, key, text, terms, signals)
    score = 2 * F.col("term_hits") + F.col("signal_hits") - F.length("unit") / 400
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), "pos"))).where(F.col("rn") <= n)
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.trim("unit").alias("u"))))
    return ranked.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["u"]), " ").alias("summary"))


def distinct_ignoring_case(words: Column) -> Column:
    """Trimmed, non-empty, the first spelling of each."""
    kept = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    low = F.transform(kept, F.lower)
    return F.filter(kept, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def class_key(text: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """The first class with a phrase in the text, else the text itself."""
    out = text
    for name, phrases in reversed(classes.items()):
        hit = F.lit(False)
        for p in phrases:
            hit |= text.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def collapse_bullets(bullets: Column, noun: str) -> Column:
    """Drops "x noun" where the bare noun stands as a bullet of its own."""
    bare = F.exists(bullets, lambda b: F.trim(b) == noun)
    return F.filter(bullets, lambda b: ~(bare & b.endswith(f" {noun}")))


def path_list(value: Column) -> Column:
    """Distinct non-empty paths of a JSON list, a JSON string or a plain path."""
    text = F.trim(value)
    listed = F.from_json(text, "array<string>")
    single = F.array(F.regexp_replace(text, '^"|"$', ""))
    return F.array_distinct(F.filter(F.when(text.startswith("["), listed).otherwise(single), lambda p: p.isNotNull() & (p != "")))


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, record as JSON) of every table record of a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            found = [[json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in table_records(t or "")] for t in own["html"]]
            yield pd.DataFrame({"key": own["key"], "records": found})

    source = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    kind = source.schema["key"].dataType.simpleString()
    rows = source.mapInPandas(run, f"key {kind}, records array<string>")
    return rows.select(F.col("key").alias(key), F.posexplode("records").alias("pos", "record"))


def merge_cards(cards: DataFrame, key: str, most: int | None = None, by_evidence: bool = True) -> DataFrame:
    """Of each answer's cards (key, pos, text, evidence), in order, those that bring something new: key, pos, text, evidence.

    A card goes if all its evidence was seen in cards that stay, or its text (in lower case, with plain spaces) was; with
    `most`, what comes after so many goes too. What stays depends on what stayed before, so an answer's cards are folded
    in order; they are few. Evidence comes out without repeats.
    """
    kind = "struct<pos:int,text:string,evidence:array<string>>"
    ordered = cards.select(key, F.struct(F.col("pos").cast("int").alias("pos"), "text", F.array_distinct(F.coalesce(F.col("evidence").cast("array<string>"), F.expr("cast(array() as array<string>)"))).alias("evidence")).alias("c"))
    none = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("kept"), F.expr("cast(array() as array<string>)").alias("ids"), F.expr("cast(array() as array<string>)").alias("texts"))

    def step(acc: Column, c: Column) -> Column:
        said = F.trim(F.regexp_replace(F.lower(F.coalesce(c["text"], F.lit(""))), r"\s+", " "))
        old = (said != "") & F.array_contains(acc["texts"], said)
        if by_evidence:
            old |= (F.size(c["evidence"]) > 0) & (F.size(F.array_except(c["evidence"], acc["ids"])) == 0)
        if most is not None:
            old |= F.size(acc["kept"]) >= most
        texts = F.when(said == "", acc["texts"]).otherwise(F.concat(acc["texts"], F.array(said)))
        more = F.struct(F.concat(acc["kept"], F.array(c)).alias("kept"), F.array_union(acc["ids"], c["evidence"]).alias("ids"), texts.alias("texts"))
        return F.when(old, acc).otherwise(more)

    folded = ordered.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list("c")), none, step, lambda acc: acc["kept"]).alias("kept"))
    return folded.select(key, F.inline("kept"))


MARK = r"\[\s*(\d+)\s*\]"


def remap_citations(answers: DataFrame, sent: DataFrame, sources: DataFrame, key: str, text: str = "answer") -> DataFrame:
    """answers with each [n] of the n-th sent source as that of the same chunk's place among all sources; others stay.

    sent and sources are (key, pos from 1, chunk_id). The places of marks are rows that are joined to the sources' and put
    together in order again.
    """
    number = sent.select(key, F.col("pos").cast("string").alias("n"), "chunk_id").join(sources.select(key, F.col("pos").alias("to"), "chunk_id"), [key, "chunk_id"]).select(key, "n", "to")
    marks = answers.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(MARK), 1)).alias("place", "given"))
    marks = marks.withColumn("n", F.coalesce(F.nullif(F.ltrim("given", F.lit("0")), F.lit("")), F.lit("0")))
    found = marks.join(number, [key, "n"], "left").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "to"))), lambda x: x["to"]).alias("to"))
    plain, whole = F.split(F.col(text), MARK, -1), F.regexp_extract_all(text, F.lit(MARK), 0)
    new = F.zip_with(whole, "to", lambda m, to: F.coalesce(F.concat(F.lit("["), to.cast("string"), F.lit("]")), m))
    # plain parts and marks alternate, a plain part at either end
    joined = F.array_join(F.flatten(F.zip_with(plain, new, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
    return answers.join(found, key, "left").withColumn(text, F.when(F.col("to").isNull(), F.col(text)).otherwise(joined)).select(answers.columns)
