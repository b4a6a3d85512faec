"""The term patterns against the rule said in plain Python over tokens."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellar.functions import text as X


def tokens(text):
    out = []
    for t in re.findall(r"[0-9a-z가-힣_-]+", text):
        t = re.sub(r"^[_-]+|[_-]+$", "", t)
        if len(t) < 2:
            continue
        m = re.search("[가-힣]", t) and re.fullmatch(f"(.{{2,}}?)({'|'.join(X.PARTICLES)})", t)
        out.append(m[1] if m else t)
    return out


def matches(term, text):
    term, text = (x.replace("콘베이어", "컨베이어") for x in (term, text))
    if term.isascii() and term.isalpha() and len(term) <= 3:
        return re.search(rf"(?:^|[^a-z0-9]){term}(?:[^a-z0-9]|$)", text) is not None
    bare = re.sub(r"[\s_-]+", "", term)
    if term in text or len(bare) >= 4 and bare in re.sub(r"[ \t\n\x0b\f\r_-]+", "", text):
        return True
    return len(term) >= 4 and any(len(t) >= 4 and (term in t or t in term) for t in tokens(text))


PART = st.sampled_from(["than", "thando", "handor", "thandor", "t h-a_n", "belt", "belts", "-", "_", " ", "\n", "은", "으로는", "이가", "컨베이어", "콘베이어", "어벨트", "벨트", "a", "9", "."])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PART, max_size=8).map("".join), min_size=1, max_size=60))
def test_terms_by_tokens(spark, texts):
    terms = ["thandor", "belt", "the", "th-andor", "컨베이어벨트", "벨트", "콘베이어", "belt 9"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1)
    rows = df.select("i", *(X.term_matches(t, F.col("s")).alias(f"t{k}") for k, t in enumerate(terms)), X.lexical_score(terms, F.col("s")).alias("all"), X.lexical_score(terms[:4], F.col("s")).alias("latin")).collect()
    for r in rows:
        hit = [matches(t, texts[r.i]) for t in terms]
        assert [r[f"t{k}"] for k in range(len(terms))] == hit, texts[r.i]
        assert abs(r["all"] - sum(hit) / len(terms)) < 1e-12 and abs(r["latin"] - sum(hit[:4]) / 4) < 1e-12
