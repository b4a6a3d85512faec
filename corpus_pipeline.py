"""Corpus pipeline: quality classifier, language ID, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of the documents they were given. run() writes each stage's rows to the shared folder and reads them
back as the next stage's documents.

Quality drops low quality and toxic documents; language ID drops those that are in none of the
languages it learned from the others: without a letter, undecided between languages, or unlike all of
them (another language, gibberish); of each group of near copies (5-word shingles, Jaccard similarity
of 0.8 or more, by links) the row with the smallest id stays; packing places what is left in sequences.

Defined cases, besides those of each operator: null or blank texts go at the first stage; very long texts
are handled whole and cut by packing only; of near copies with equal ids one stays, of those without
id, which come after all others, likewise, and rows without words are no copies of each other; repeated
rows are copies; columns named like a result of an operator pass through unchanged; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.common import forget, scratch, table, written
from tessellar.llm.components import looked_up
from tessellar.llm.op1_best_fit_packing import best_fit_packing
from tessellar.llm.op4_language_id import UNKNOWN, language_id, train
from tessellar.llm.op6_ngram_jaccard_join import jaccard_components
from tessellar.llm.op9_quality_classifier import quality_scores

#: Language ID keeps a document whose best language has at least this posterior.
LEAST_LANGUAGE_SCORE = 0.5
#: And so much log probability a gram: texts of a learned language have -5 to -8, other languages and
#: gibberish -9 to -15.
LEAST_LANGUAGE_FIT = -9.0
#: Names a row while near copies are removed.
ROW_KEY = "__near_row"


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that clash with no result column, and the name of each column there."""
    names = {c: f"doc_{i}_" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, of = _plain(docs)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", of["doc_id"])
    scores = quality_scores(plain, labels, of["doc_id"], of["text"], of["source"], of["lang"], carry=plain.columns)
    return scores.where("kept").select(*(F.col(n).alias(c) for c, n in of.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, of = _plain(docs)
    found = language_id(plain, train(plain, of["doc_id"], of["text"], of["lang"]), of["doc_id"], of["text"], carry=plain.columns)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE) & (F.col("fit") >= LEAST_LANGUAGE_FIT))
    return kept.select(*(F.col(n).alias(c) for c, n in of.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row, that of the smallest id, rows without id last; rows without words are alone."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        # ids don't tell rows apart: id and text do, but for copies; a row without id comes after all others
        key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
        rows = docs.withColumn(ROW_KEY, key)
    else:
        rows = docs.withColumn(ROW_KEY, F.col("doc_id"))
    found = written(spark, jaccard_components(rows, ROW_KEY, width=5, percent=80), "near")
    gone = found.where(~F.col(ROW_KEY).eqNullSafe(F.col("component_id"))).select(ROW_KEY).dropDuplicates()
    kept = looked_up(rows, written(spark, gone, "gone"), ROW_KEY, "left_anti")
    again = found.where(F.col(ROW_KEY).eqNullSafe(F.col("component_id")) & (F.col("n_shingles") > 0)).groupBy(ROW_KEY).count().where("count > 1").select(ROW_KEY)
    if again.limit(1).count():  # copies of the row that stays
        kept = kept.join(again, ROW_KEY, "left_anti").unionByName(kept.join(again, ROW_KEY, "left_semi").dropDuplicates([ROW_KEY]))
    return kept.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [("quality_classifier", quality), ("language_id", language), ("ngram_jaccard_join", near_duplicates), ("best_fit_packing", packing)]

#: The fitted models can't be expressed in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as made:  # what a stage wrote on its way goes once its rows are written
            docs = written(spark, stage(spark, before, sf_dir), name)
            made[:] = [x for x in made if x is not docs]
        if hasattr(before, "written_at"):
            forget(spark, before)
    return docs
