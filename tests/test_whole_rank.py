"""The rank of a keyword query against brute force."""

import re

from tessellar.plans import retrieval

TERMS = {"the", "is", "for"}


def brute_rank(text):
    words = re.findall("[0-9a-zÀ-ɏ가-힣]+", (text or "").lower())
    full = {(i, j) for i in range(len(words)) for j in range(i, len(words)) if set(words[i : j + 1]) >= TERMS}
    least = [(i, j) for i, j in full if (i + 1, j) not in full and (i, j - 1) not in full]
    return bool(full), round(sum(len(TERMS) / (j - i + 1) for i, j in least) / 10, 9)


def test_keyword_rank_against_brute_force(spark, tmp_path):
    texts = ["the is for", "For it IS the one, the only. Is it for the is for", "the is", "the x is y for z the w is", "", None, "for-the-is is is the for"]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.chunk_id: (r.all_terms, round(r.rank, 9)) for r in retrieval.keyword_cover_rank(spark, str(tmp_path)).collect()}
    assert got == {i: brute_rank(t) for i, t in enumerate(texts)} and got[1][1] > got[0][1] == 0.1
