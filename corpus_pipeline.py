"""The corpus pipeline: from raw documents to packed training sequences.

Stages, in order: the quality classifier drops what it predicts to be bad; language identification drops texts without
a language and texts that contradict their `lang`; one document of each near-duplicate group stays; personal data is
replaced by marks such as [EMAIL]; what is left is packed into token windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm import langid, neardup, packing, pii, quality
from gatewright.llm.common import Scratch, prepare
from gatewright.llm.queries import TOKENIZER


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labelled rows still present, predicts to be good.

    Null text counts as empty; rows come out as often as they came in; all columns stay as they are.
    """
    prepare(spark)
    rate = quality.score(quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    judged = docs.select(F.struct(*docs.columns).alias("row"), rate(F.col("text")).alias("judged"))
    return judged.where("judged.predicted = 1").select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language (a letter, and a learned language near it) that its `lang` does not contradict.

    A null `lang` contradicts nothing; null text has no language.
    """
    prepare(spark)
    guess = langid.predict(langid.learn_profiles(langid.training_rows(docs)))
    judged = docs.select(F.struct(*docs.columns).alias("row"), guess(F.col("text")).alias("judged"))
    found = F.col("judged.lang_pred")
    fits = (found != langid.UNKNOWN) & (F.col("row.lang").isNull() | (F.col("row.lang") == found))
    return judged.where(fits).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every near-duplicate group; rows without doc_id all stay.

    Of rows that repeat both doc_id and text one stays.
    """
    first = neardup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    known = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every personal-data span of the text replaced by its kind and n_chars counted anew."""
    prepare(spark)
    clean = docs.withColumn("text", pii.redacted(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents kept so far, as token pieces in windows of 1024."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", good_quality),
    ("language_id", known_language),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written and read again as the next one's input."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Trained classifiers, language profiles and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
