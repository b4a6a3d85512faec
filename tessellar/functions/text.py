"""Text scalars as Column builders: everything here stays inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Korean particles that a token may end with, longest first, and one spelling that
# older material uses for another.
PARTICLES = ("으로는", "에서는", "에게", "에서", "으로", "까지", "부터", "보다", "처럼", "이나", "은", "는", "이", "가", "을", "를", "에", "의", "로", "와", "과", "도", "만")
SPELLINGS = (("콘베이어", "컨베이어"),)
NULL_WORDS = ("", "null", "none", "nan", "n/a")


def ordered_distinct(values: Column) -> Column:
    """Keeps the first of equal elements, in order."""
    return F.array_distinct(values)


def tokenize(text: Column) -> Column:
    """Ordered distinct lower-case tokens of two characters or more, without one trailing particle."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([0-9a-z가-힣_-]+)"), 1)
    trimmed = F.transform(found, lambda t: F.regexp_replace(t, r"^[_-]+|[_-]+$", ""))
    kept = F.filter(trimmed, lambda t: F.length(t) >= 2)
    bare = F.transform(kept, lambda t: F.when(t.rlike("[가-힣]") & t.rlike(f"^.{{2,}}?({'|'.join(PARTICLES)})$"), F.regexp_extract(t, f"^(.{{2,}}?)({'|'.join(PARTICLES)})$", 1)).otherwise(t))
    return ordered_distinct(bare)


def compact(text: Column) -> Column:
    """Lower case without white space, underscores and hyphens, in today's spelling."""
    out = F.lower(text)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"[\s_-]+", "")


def term_matches(term: str, text: Column) -> Column:
    """Whether a lower-case term occurs: short Latin terms as words, others as substrings or, from
    four characters, as substrings of the compact text or with a token of four or more inside them."""
    return _matches(term, text, compact(text), _spelled(tokenize(text)))


def _matches(term: str, text: Column, squeezed: Column | None, tokens: Column | None) -> Column:
    """Terms of ASCII alone are matched by patterns that need neither the compact text nor its tokens."""
    if term.isascii() and term.isalpha() and len(term) <= 3:
        return text.rlike(rf"(^|[^a-z0-9]){term}([^a-z0-9]|$)")
    latin = term.isascii()
    if not latin:
        for old, new in SPELLINGS:
            term, text = term.replace(old, new), F.replace(text, F.lit(old), F.lit(new))
    out = text.contains(term)
    bare = "".join(c for c in term if not c.isspace() and c not in "_-")
    if len(bare) >= 4:
        out = out | (text.rlike(r"[\s_-]*".join(map(re.escape, bare))) if latin else squeezed.contains(bare))
    # a token around the term is found by the text's substring already; those within it are few
    within = sorted({term[i : i + n] for n in range(4, len(term)) for i in range(len(term) - n + 1)})
    if within and latin:
        edge, whole = "[^0-9a-z가-힣_-]", [w for w in within if re.fullmatch("[0-9a-z](?:[0-9a-z_-]*[0-9a-z])?", w)]
        if whole:
            out = out | text.rlike(rf"(?:^|{edge})[_-]*(?:{'|'.join(whole)})(?:{'|'.join(PARTICLES)})?[_-]*(?:$|{edge})")
    elif within:
        out = out | F.arrays_overlap(tokens, F.array(*map(F.lit, within)))
    return out


def lexical_score(terms: list[str], text: Column) -> Column:
    """Share of the terms that match; 0 without terms.

    Lower case and, where a term needs them, compact text and tokens are the one element of an array, so
    that all terms share them.
    """
    if not terms:
        return F.lit(0.0)
    low = F.lower(text)
    given = [low.alias("low")]
    if not all(t.isascii() for t in terms):
        given += [compact(low).alias("compact"), _spelled(tokenize(low)).alias("tokens")]

    def share(one: Column) -> Column:
        rest = [one[n] for n in ("compact", "tokens")] if len(given) > 1 else [None, None]
        found = (F.when(_matches(t, one["low"], *rest), 1.0).otherwise(0.0) for t in terms)
        return sum(found, F.lit(0.0)) / len(terms)

    return F.transform(F.array(F.struct(*given)), share)[0]


def _spelled(tokens: Column) -> Column:
    """Tokens in today's spelling."""

    def today(token: Column) -> Column:
        for old, new in SPELLINGS:
            token = F.replace(token, F.lit(old), F.lit(new))
        return token

    return F.transform(tokens, today)


def signal_score(words: list[str], text: Column, enough: int = 3) -> Column:
    """min(1, words found / enough)."""
    low = F.lower(text)
    return F.least(F.lit(1.0), sum((F.when(low.contains(w), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / enough)


def topic_threshold(n: Column) -> Column:
    """All of one or two terms, else at least 60 % and two."""
    return F.when(n <= 2, n).otherwise(F.greatest(F.lit(2), F.ceil(n * 3 / 5)).cast("int"))


def null_words(text: Column) -> Column:
    """Trimmed text with Unix newlines; NULL for the words that stand for nothing."""
    clean = F.trim(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    return F.when(F.lower(clean).isin(*NULL_WORDS), F.lit(None)).otherwise(clean)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trim_lines(text: Column) -> Column:
    """Lines trimmed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def clean_text(text: Column) -> Column:
    """Extraction debris of page texts: form feeds, private-use icons, leaders, table rules, lone page numbers."""
    out = F.regexp_replace(text, "[\f﻿-ᜀ-ᝓ]", "")
    out = F.regexp_replace(out, r"©\s*Copyright Reserved[^\n]*", "")
    out = F.regexp_replace(out, r"\.{5,}", " ")
    out = F.regexp_replace(out, r"([^0-9A-Za-z가-힣\s])\1{4,}", " ")
    out = F.regexp_replace(out, r"(?m)^\|?[\s\-:|]+\|[\s\-:|]*$\n?", "")
    out = F.array_join(F.filter(F.split(out, "\n"), lambda x: ~x.rlike(r"^\s*\d{1,4}\s*$")), "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_to_text(html: Column) -> Column:
    """Markup removed with built-in functions: raw elements, comments, block ends as newlines, tags, basic entities."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return trim_lines(F.regexp_replace(out, r"[ \t\r\f]+", " "))


def useful_sentence(s: Column) -> Column:
    """Long enough, not only numbers, few cells and labels, some letters."""
    labels = F.size(F.regexp_extract_all(s, F.lit(r"(\S+:\s)"), 1))
    bars = F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
    return (F.length(s) >= 10) & ~s.rlike(r"^[\d\s.,-]+$") & (bars < 2) & (labels < 3) & s.rlike("[A-Za-z가-힣]")


def sentences(text: Column) -> Column:
    """Units that end after . ! or ? not after a digit, or at newlines; joined, they are the text."""
    return F.filter(F.split(text, r"(?<=\n)(?!\n)|(?<=[.!?]\s)(?<!\d[.!?]\s)(?!\s)"), lambda x: x != "")


def excerpt(text: Column, size: int = 700) -> Column:
    return F.substring(text, 1, size)


def focused_excerpt(text: Column, word: str, before: int = 40, size: int = 160) -> Column:
    """A window that starts `before` characters ahead of the word's first place, else the head."""
    at = F.locate(word, F.lower(text))
    return F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(size))


def keywords(text: Column, most: int = 30) -> Column:
    return F.slice(tokenize(text), 1, most)


def to_int(text: Column) -> Column:
    return F.expr(f"try_cast(replace({_name(text)}, ',', '') as int)")


def to_double(text: Column, default: float | None = None) -> Column:
    """Comma-stripped number; the default for anything else, NaN and infinities included."""
    value = F.expr(f"try_cast(replace({_name(text)}, ',', '') as double)")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(default)).otherwise(value)


def _name(column: Column) -> str:
    return f"`{column._jc.toString().strip('`')}`"


def parse_date(text: Column) -> Column:
    """The first Y-M-D, Y.M.D or Y/M/D, if it is a calendar date."""
    parts = [F.regexp_extract(text, r"(\d{4})[./-](\d{1,2})[./-](\d{1,2})", i) for i in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")


def only_year(text: Column, within: int = 600) -> Column:
    """The one four-digit year of the text's head; NULL if there are several or none."""
    years = F.array_distinct(F.regexp_extract_all(F.substring(text, 1, within), F.lit(r"\b((?:19|20)\d{2})\b"), 1))
    return F.when(F.size(years) == 1, years[0].cast("int"))
