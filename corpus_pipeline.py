"""The corpus pipeline: documents in, a mixed training corpus out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, langid, lines, minhash, mixing
from tidegrid.llm.common import settle

#: Two languages whose shares are closer than this are one text's in equal parts; it is rejected as neither.
UNDECIDED = 0.02
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model can tell stay; lang is what it says.

    The model learns from the documents' own labels (crc32(doc_id) modulo 4 other than
    2, a bounded sample).  Texts without letters go, and texts that are as much in one language as in another.
    """
    model = langid.train(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(True))))
    told = docs.select(*COLUMNS).withColumn("told", langid.predictor(model, UNDECIDED)("text"))
    kept = told.where((F.col("told.lang") != langid.UNKNOWN) & ~F.col("told.ambiguous"))
    return kept.withColumn("lang", F.col("told.lang")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than a tenth of their source's different texts hold go; every document stays.

    Near-dedup comes later, so equal texts count as one page here: copies don't make their own lines frequent.
    """
    return lines.drop_boilerplate(docs.select(*COLUMNS), contents=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of 5 words, similarity 0.8 or more.

    Documents are known by doc_id: rows that repeat the id that stays all stay, and rows without an id are no one's copies.
    """
    found = minhash.near_duplicates(docs)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with how often the mix takes it (copies, 0 to 2; 0 leaves it out) and the words that makes."""
    return mixing.mix(docs, carry=("text", "lang", "n_chars"))


STAGES = [("language ID", language), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing", mix)]
#: SQL has neither the sketches nor the trained model nor the hash order; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES in order to documents, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage{k}")
    return docs
