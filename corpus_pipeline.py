"""Corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
each result as Parquet in the shared folder and rereads it for the next stage.
All but the last return the columns of ``documents``.

Edge cases, in every stage: null, empty and blank texts go with language ID
(no language) and are documents without words later on; a null lang or source
stays null; a null doc_id is kept by the first four stages, whose decisions
can't name it, and left out by mixing; rows that repeat a doc_id go together when near-dedup or
decontamination drops that id; very long texts are processed whole; extra
columns are dropped; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm import decontamination, language_id, minhash_dedup, mixing, substring_dedup
from trustlake.llm._session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least score with which a language counts as recognised.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all texts with a language; documents without a recognisable language go."""
    model = language_id.fit(docs)
    found = language_id.predict(docs, model, F.col("text").alias("own_text"), "lang", "source", "n_chars")
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).withColumnRenamed("own_text", "text").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    gone = minhash_dedup.minhash_dedup(docs).filter("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has go; documents that lose all words go."""
    cut = substring_dedup.substring_dedup(docs, text_out=True, keep=("lang", "source", "n_chars"))
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies and the words these have."""
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").alias("copies"), F.max("taken").alias("taken"), F.max("target").alias("target")).filter("copies > 0")
    return docs.join(taken, "doc_id").select(*COLUMNS, "copies", "taken", "target")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Language ID and near-dedup can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
