"""A training-data pipeline over `documents`: quality, near duplicates, benchmark decontamination, personal data, packing.

Each stage is written as Parquet and read again before the next one. Stages key documents by doc_id; every stage but the last returns the columns of
documents. Toxic or personal content alone does not drop a document; a document goes only when its quality is rejected, when it is a near copy of
one that stays, or when it holds a benchmark passage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.llm import decontam, near_dup, packing, pii, quality
from isoline.llm.common import counted, fresh_path, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model (fitted on labels outside its held-out part) does not reject.

    Null texts score as empty ones; null ids and repeated rows are judged row by row; without labels every score is 0.5, which is rejected; an empty
    table gives no rows; all columns stay, whatever their names.
    """
    model = quality.fit_labelled(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(model, F.col("text")) >= quality.THRESHOLD)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group with similarity 0.8 or more on shingles of five words.

    A document is what shares a doc_id: rows that repeat an id with other texts stay or go together. Of rows that repeat an id and its text one stays, the
    least by all columns. Rows without an id cannot be named by a group and stay. Null and empty texts are near nothing and stay; an empty table gives no
    rows; all columns stay, whatever their names.
    """
    found = written(near_dup.near_duplicates(docs, width=5, percent=80).where("doc_id is not null").select("doc_id", "kept"), "near-dup-kept")
    gone = written(found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-dup-gone")
    again = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    stay = docs.join(counted(gone), F.col("doc_id") == F.col("__gone"), "left_anti")
    if again.isEmpty():
        return stay
    repeated, every = F.col("doc_id") == F.col("__again"), F.struct(*docs.columns)
    least = stay.join(again, repeated, "left_semi").groupBy("doc_id", "text").agg(F.min_by(every, F.to_json(every)).alias("__row"))
    return stay.join(again, repeated, "left_anti").unionByName(least.select("__row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.

    Null and empty texts overlap nothing and stay; rows are judged by id and text, so rows that repeat an id with another text are told apart, as are null
    ids; an empty benchmark removes nothing; an empty table gives no rows; all columns stay, whatever their names.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by the kind's name; n_chars follows the text.

    Every row stays, repeated ones too; null texts stay null (and n_chars null); an empty table gives no rows; all columns stay, whatever their names.
    """
    text = pii.redact_column(pii.fit_pii(docs), F.col("text"))
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, packed into sequences of at most 2048 tokens; `packing.sequences` joins the pieces of each.

    Null texts are empty: the end id alone; null ids and repeated rows are packed like any other row; an empty table gives no rows; other columns are not read.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_dup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("best-fit packing", packing_stage),
]

#: A fitted classifier and tokenizers have no SQL form; tests/llm/test_pipeline.py holds every stage and run() against plain brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), fresh_path(spark, f"pipeline-{uuid.uuid4().hex[:6]}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
