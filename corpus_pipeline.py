"""A training corpus from documents: language, near duplicates, personal data, mixture, sequences.

Every stage takes all rows that the one before it kept, and its decisions take effect: rejected documents go, of each
group of near duplicates one stays, personal data are replaced, documents are repeated or left out to meet the
targets of their sources, and what remains is packed. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import jaccard, language, mixing, packing, pii
from pathloom.llm.common import small_batches, written

#: Documents without letters go, and those whose words are of no one language for the most part.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; rows stay as they are.

    Null texts, texts without letters and tables without any language label have no language and go. Repeated rows are
    judged alike and all stay; texts of any length are read whole; an empty table stays empty. Extra columns stay, also
    those named ``lang_pred`` or ``score``.
    """
    small_batches(spark)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")  # columns of any name keep their place
    named = language.identify(rows, language.learn(docs))
    return named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near duplicates; rows stay as they are.

    Rows without an id, and documents without words, are near to none and stay. Of rows that repeat an id one stays.
    Texts of any length are compared whole; an empty table stays empty; extra columns stay.
    """
    small_batches(spark)
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by their kind; ``n_chars`` follows where there is a text.

    Every row stays. Null and empty texts stay as they are, texts of any length are read whole, repeated rows are
    changed alike, an empty table stays empty, and extra columns stay.
    """
    small_batches(spark)
    clean = pii.redact(docs, pii.learn(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents, so that sources come near their targets; rows stay as they are.

    Documents without words go. Null is a source of its own. Rows that repeat an id count each, ties go by a hash of
    the text. Texts of any length count whole; an empty table stays empty; extra columns stay.
    """
    small_batches(spark)
    return mixing.repeated(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 1,024 tokens; a row for each piece, with its token ids.

    Null and empty texts are the end id alone; rows that repeat an id are packed each; texts of any length are cut into
    as many pieces as needed; ties of length go by id and place; extra columns are left behind; an empty table gives
    no rows.
    """
    small_batches(spark)
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: The stages learn models and draw by hashes of Spark, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
