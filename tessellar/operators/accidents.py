"""Accident reports: labelled values, dates, places, final cleaning; all as expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.text import compact, term_matches

DATE = r"((?:19|20)\d{2})\s*(?:년|[./-])\s*(\d{1,2})\s*(?:월|[./-])\s*(\d{1,2})\s*일?"
#: Words that make a date before which they stand the date of something else; fixed values.
OTHER_DATES = ("등록일", "게시일", "작성일", "설치일", "제정일", "시행일", "행사", "registered", "posted")
#: A second date counts against the first from this place on.
LATE = 350


def _spaced(label: str) -> str:
    return r"\s*".join(label)


def labelled_value(text: Column, label: str, labels: list[str]) -> Column:
    """What follows "label :" up to the next label, white space squeezed; NULL if nothing does."""
    ahead = "|".join(_spaced(x) for x in labels)
    raw = F.regexp_extract(text, rf"(?s)(?:^|\s){_spaced(label)}\s*[:：]\s*(.*?)\s*(?=(?:^|\s)(?:{ahead})\s*[:：]|$)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), r"^[\s:：,-]+|[\s:：,;]+$", ""), F.lit(""))


def _date(text: Column) -> Column:
    part = [F.regexp_extract(text, DATE, i) for i in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")), "yyyy-MM-dd")


def accident_date(text: Column, label: str, labels: list[str], within: int = 1800) -> Column:
    """The labelled date, else the first date that isn't another event's; NULL if a different one
    follows and the first comes late."""
    head = F.substring(text, 1, within)
    given = _date(F.substring(F.coalesce(labelled_value(head, label, labels), F.lit("")), 1, 60))
    behind = "".join(f"(?<!{w}.{{0,8}})" for w in OTHER_DATES)
    found = F.regexp_extract_all(head, F.lit(rf"({behind}{DATE})"), 1)
    dates = F.array_distinct(F.filter(F.transform(found, lambda d: _date(d)), lambda d: d.isNotNull()))
    first = F.get(found, F.lit(0))
    unsure = (F.size(dates) > 1) & (F.instr(head, first) > LATE)
    return F.coalesce(given, F.when(~F.coalesce(unsure, F.lit(False)), F.get(dates, F.lit(0))))


def title_date(title: Column, text: Column, within: int = 600) -> Column:
    """A full date of the title, else its month and day with the text's only year."""
    years = F.array_distinct(F.regexp_extract_all(F.substring(text, 1, within), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1))
    month, day = (F.regexp_extract(title, r"(?<!\d)(\d{1,2})\s*[월./]\s*(\d{1,2})\s*일?(?!\d)", i) for i in (1, 2))
    joined = F.try_to_date(F.concat_ws("-", F.get(years, F.lit(0)), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.coalesce(_date(title), F.when(F.size(years) == 1, joined))


def final_text(text: Column) -> Column:
    """Control characters out, blanks squeezed, empty and lone-dot lines dropped; NULL if nothing is left."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    lines = F.transform(F.split(clean, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.nullif(F.array_join(F.filter(lines, lambda x: ~x.isin("", ".")), "\n"), F.lit(""))


def decide_location(rows: DataFrame) -> DataFrame:
    """Title against body: rows with structs title and body of (province, city, detail, specificity),
    NULL where nothing valid was found, and existing. Adds location_status and location."""
    t, b = F.col("title"), F.col("body")
    same = t["province"].eqNullSafe(b["province"]) & t["city"].eqNullSafe(b["city"])
    td, bd = (F.regexp_replace(x["detail"], r"\s", "") for x in (t, b))
    differ = F.coalesce(td != bd, F.lit(False))
    short = lambda x: F.expr("null") if x is None else F.substring(x, F.lit(1), F.length(x) - 1)
    alike = b["detail"].startswith(F.concat(t["detail"], F.lit(" "))) | t["detail"].startswith(F.concat(b["detail"], F.lit(" "))) | (short(bd) == td) | (short(td) == bd)
    typo = (F.right(td, F.lit(1)) == F.right(bd, F.lit(1))) & one_character_off(td, bd)
    status = (
        F.when(t.isNotNull() & b.isNotNull(), F.when(~same, "true_conflict").when(~differ, "consistent").when(F.coalesce(alike, F.lit(False)), "consistent_detail_normalized").when(F.coalesce(typo, F.lit(False)), "title_detail_typo_corrected").otherwise("true_detail_conflict"))
        .when(b.isNotNull(), "body")
        .when(t.isNotNull(), "title")
        .when(F.col("existing").isNotNull(), "base_preserved")
        .otherwise("none")
    )
    rows = rows.withColumn("location_status", status)
    s = F.col("location_status")
    chosen = F.when(s == "consistent", F.when(b["specificity"] > t["specificity"], b).otherwise(t)).when(s == "consistent_detail_normalized", F.when(b["specificity"] >= t["specificity"], b).otherwise(t)).when(s.isin("title_detail_typo_corrected", "body"), b).when(s == "title", t)
    return rows.withColumn("location", F.when(s == "base_preserved", F.col("existing")).otherwise(F.nullif(F.concat_ws(" ", chosen["province"], chosen["city"], chosen["detail"]), F.lit(""))))


def one_character_off(a: Column, b: Column) -> Column:
    """Equal length and exactly one different character."""
    off = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return (F.length(a) == F.length(b)) & (off == 1)


def best_location(candidates: DataFrame, key: str, least: int = 20) -> DataFrame:
    """Each key's best scored place; NULL below the threshold or where equal scores disagree."""
    k = F.rank().over(Window.partitionBy(key).orderBy(F.desc("score")))
    best = candidates.where(F.col("score") >= least).withColumn("k", k).where("k = 1")
    n = F.countDistinct("location")
    return best.groupBy(key).agg(F.when(n == 1, F.min("location")).alias("location"), F.when(n == 1, "ok").otherwise("conflict").alias("status"))


def profile_score(question: str, aliases: Column, products: Column, metadata: Column, structured: Column, whole: Column, terms: list[str]) -> Column:
    """How well a document's profile answers to a question: aliases and products named in it, terms found in it."""
    q = compact(F.lit(question))
    total = lambda values, base, per, most: F.aggregate(F.filter(F.transform(values, lambda v: compact(v)), lambda v: (v != "") & q.contains(v)), F.lit(0.0), lambda s, v: s + base + F.least(F.length(v), F.lit(most)) * per)
    score = total(products, 4.0, 0.05, 24) + total(aliases, 2.4, 0.04, 20)
    for t in terms:
        score += F.when(term_matches(t, F.lower(metadata)), 1.2).when(term_matches(t, F.lower(structured)), 1.0).when(term_matches(t, F.lower(whole)), 0.55).otherwise(0.0)
    return score + F.when(F.lit("series" in question.lower()) & F.exists(aliases, lambda a: q.contains(compact(a))), 0.7).otherwise(0.0)


def profile_sample(chunks: DataFrame, signals: list[str], document: str = "document_id", index: str = "chunk_index", most: int = 20, size: int = 18_000) -> DataFrame:
    """The first 12 distinct chunks of a document, then ones with a signal word among the first 80,
    20 at most, joined and cut."""
    signal = F.lit(False)
    for w in signals:
        signal |= F.col("content").contains(w)
    head = chunks.where(F.col(index) < 80).withColumn("lead", F.col(index) < 12)
    wanted = head.where(F.col("lead") | signal)
    first = wanted.withColumn("rn", F.row_number().over(Window.partitionBy(document, "content_hash").orderBy(index))).where("rn = 1")
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy(document).orderBy(index))).where(F.col("place") <= most)
    parts = F.sort_array(F.collect_list(F.struct("place", "content")))
    return kept.groupBy(document).agg(F.count("*").alias("n"), F.substring(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n"), 1, size).alias("sample"))


#: Scripts into which broken fonts decode, as ranges of code points; fixed values.
FOREIGN_SCRIPTS = {"DEVANAGARI": "ऀ-ॿ", "BENGALI": "ঀ-৿", "GURMUKHI": "਀-੿", "GUJARATI": "઀-૿", "ORIYA": "଀-୿", "TAMIL": "஀-௿", "TELUGU": "ఀ-౿", "KANNADA": "ಀ-೿", "MALAYALAM": "ഀ-ൿ", "SINHALA": "඀-෿"}


def broken_font_mapping(text: Column) -> Column:
    """Many replacement characters, or letters spread over several unrelated scripts with next to no Hangul."""
    count = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]++", ""))
    visible = F.length(F.regexp_replace(text, r"\s++", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}++", ""))
    own = [F.length(F.regexp_replace(text, rf"[[^{r}]\P{{L}}]++", "")) for r in FOREIGN_SCRIPTS.values()]
    foreign = sum(own, F.lit(0))
    scripts = sum((F.when(c >= 5, 1).otherwise(0) for c in own), F.lit(0))
    lost = count("�")
    mixed = (letters >= 100) & (foreign >= 50) & (foreign >= 0.15 * letters) & (scripts >= 3) & (count("가-힣") < 0.05 * letters)
    return ((lost >= 50) & (lost >= 0.05 * visible)) | mixed
