"""Data-quality counters: named violations of a table in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessellar.functions.repair import glued_left

# Residues of markup, labels of other fields, titles that tell of no accident.
MARKUP = r"(?i)<(?:img|br|p|div|script|style|span|table|tr|td)\b"
LABELS = r"(?i)(?:피\s*해\s*정\s*도|공\s*정|재\s*해\s*유\s*형|사\s*고\s*유\s*형|날\s*짜|공\s*사\s*금\s*액|재\s*해\s*개\s*요|재\s*해\s*원\s*인)\s*[:：]"
NO_ACCIDENT = "(?i)(?:세미나|간담회|교육|행사|공지|안내|자료|압축파일|사례모음|통계|목록|다운로드)"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
JOINED_GWANGJU = r"\[[^\]]*,\s*경기\s*광주(?:시)?\]"


def counters(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: a count of violations by name, and passed."""
    out = rows.agg(F.count("*").alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    clean = F.lit(True)
    for n in rules:
        clean &= F.col(n) == 0
    return out.withColumn("passed", clean)


def observed(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The same rows, which count their violations while they are written or read for anything else: no pass of their own."""
    seen = Observation()
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def write_observed(rows: DataFrame, path: str, rules: dict[str, Column], mode: str = "overwrite") -> dict:
    """Writes the rows and gives their counts and whether all are zero, from the one run of the plan."""
    rows, seen = observed(rows, rules)
    rows.write.mode(mode).parquet(path)
    counts = dict(seen.get)
    return {**counts, "passed": all(counts[n] == 0 for n in rules)}


def regressions(before: DataFrame, after: DataFrame, key: str, protected: list[str], again: DataFrame | None = None) -> DataFrame:
    """One row about two states of a table: rows lost, rows added, keys whose protected columns changed, and, with `again`
    (the same step applied to its own result), keys that a second application still changes; and passed.

    Keys are unique in each state. States are joined by key, columns are compared with nulls equal.
    """
    differs = lambda a, b, names: F.coalesce(~F.struct(*(a[n] for n in names)).eqNullSafe(F.struct(*(b[n] for n in names))), F.lit(False)) if names else F.lit(False)
    a, b = (df.select(F.col(key).alias("k"), F.struct(*df.columns).alias(s)) for df, s in ((before, "a"), (after, "b")))
    both = a.join(b, "k", "full")
    counts = [
        F.count_if(F.col("b").isNull()).alias("lost_rows"),
        F.count_if(F.col("a").isNull()).alias("added_rows"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & differs(F.col("a"), F.col("b"), protected)).alias("protected_column_regressions"),
    ]
    if again is not None:
        both = both.join(again.select(F.col(key).alias("k"), F.struct(*after.columns).alias("c")), "k", "left")
        counts.append(F.count_if(F.col("b").isNotNull() & (F.col("c").isNull() | differs(F.col("b"), F.col("c"), after.columns))).alias("idempotence_errors"))
    out = both.agg(*counts)
    clean = F.lit(True)
    for n in out.columns:
        clean &= F.col(n) == 0
    return out.withColumn("passed", clean)


def accident_rules(key: str, title: str, text: str, date: str, fields: list[str], parts: list[str], place: str) -> dict[str, Column]:
    """The named violations of an accident table that one row shows: date is text, fields are short metadata,
    parts the components that make up place, in order."""
    c = F.col
    empty = lambda n: F.trim(F.coalesce(c(n).cast("string"), F.lit(""))) == ""
    soiled = F.lit(False)
    for n in fields:
        soiled |= F.coalesce(c(n).rlike(LABELS) | c(n).contains("\n") | (F.length(n) > 120), F.lit(False))
    whole = F.nullif(F.concat_ws(" ", *(F.nullif(F.trim(c(n)), F.lit("")) for n in parts)), F.lit(""))
    return {
        "missing_required_rows": empty(key) | empty(title),
        "null_literal_rows": F.lower(F.trim(text)).isin("null", "none", "nan"),
        "html_residue_rows": c(text).rlike(MARKUP),
        "html_or_control_rows": c(text).rlike(MARKUP) | c(text).rlike(CONTROL),
        "metadata_contamination_rows": soiled,
        "invalid_iso_date_rows": c(date).isNotNull() & (~c(date).rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(c(date), "yyyy-MM-dd").isNull()),
        "non_accident_date_rows": ~empty(date) & c(title).rlike(NO_ACCIDENT),
        "location_component_errors": ~c(place).eqNullSafe(whole),
        "glued_boundary_rows": F.size(glued_left(c(text))) > 0,
        "double_space_rows": c(text).rlike(r"※[^\S\r\n]{2,}위"),
        "joined_gyeonggi_gwangju_errors": c(title).rlike(JOINED_GWANGJU),
    }


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, surplus rows and empty keys."""
    return rows.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("distinct_keys"), (F.count(key) - F.countDistinct(key)).alias("surplus"), F.count_if(F.col(key).isNull() | (F.col(key).cast("string") == "")).alias("empty"))


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Fails if a column is missing; else the rows that lack a value in any."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    lacks = F.lit(False)
    for c in columns:
        lacks |= F.col(c).isNull()
    return rows.where(lacks)


def scanned_documents(pages: DataFrame, document: str, text: str, short: int = 10) -> DataFrame:
    """Documents most of whose pages hold next to no text."""
    share = F.avg(F.when(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < short, 1.0).otherwise(0.0))
    return pages.groupBy(document).agg(share.alias("share")).withColumn("scanned", F.col("share") > 0.5)


def package_violations(documents: DataFrame, chunks: DataFrame, dimension: int) -> DataFrame:
    """A signed package's content rules as counts: kinds, orphans, documents without chunks, vectors."""
    one = documents.agg(F.count_if(~F.col("source_type").startswith("public_")).alias("not_public"))
    orphans = chunks.join(documents, "document_id", "left_anti").agg(F.count("*").alias("orphans"))
    bare = documents.join(chunks, "document_id", "left_anti").agg(F.count("*").alias("without_chunks"))
    wrong = chunks.agg(F.count_if(F.size("embedding") != dimension).alias("wrong_dimension"), F.countDistinct(F.size("embedding")).alias("dimensions"))
    parts = one
    for part in (orphans, bare, wrong):  # one row each, folded into one
        parts = parts.unionByName(part, allowMissingColumns=True)
    return parts.agg(*(F.max(c).alias(c) for c in parts.columns))
