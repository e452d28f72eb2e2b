"""Documents to packed training sequences: language, lines, near duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of documents.
``run`` writes what a stage returns as Parquet in the shared folder and rereads it for the next. Stages lower the session's rows of an
Arrow batch, since executors keep what the stages before them took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featforge.llm.decontaminate import decontaminate
from featforge.llm.language import UNKNOWN, fit_language, held_out, predict_language
from featforge.llm.line_dedup import dedup_lines
from featforge.llm.near_dup import near_duplicates
from featforge.llm.packing import pack
from featforge.llm.queries import tokenizer
from featforge.session import scratch_path, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose likeliest language has less than this share of its letters is rejected.
MIN_SCORE = 0.4
CAPACITY = 2048
#: Documents whose five-word shingles are this similar are near duplicates.
SIMILARITY = 0.8


def _same(left: DataFrame, right: DataFrame) -> list:
    """Equal documents: the same id, null being a value, and the same hash of the text."""
    return [left["doc_id"].eqNullSafe(right["doc_id"]) & (left["_hash"] == right["_hash"])]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters or without a main language; a null lang is filled with the prediction."""
    small_batches(spark)
    model = fit_language(docs, ~held_out())
    out = predict_language(docs.select(*COLUMNS), model, prefix="_")
    out = out.filter((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= MIN_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "_lang_pred")).select(*COLUMNS)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of recurring templates but in their first document; a document that loses all its words goes."""
    small_batches(spark)
    out = dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("lines_dropped") > 0) & (F.translate("text", "\t\n\u000b\f\r ", "") == "")
    return out.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates; equal rows are one document."""
    small_batches(spark)
    kept = near_duplicates(docs, SIMILARITY).filter("kept").select("doc_id", F.col("row_key").alias("_hash")).distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_hash"))
    first = F.row_number().over(Window.partitionBy("_hash", "doc_id").orderBy("_hash"))
    out = rows.join(kept, _same(rows, kept), "left_semi")
    return out.withColumn("_row", first).filter("_row = 1").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs; null and empty texts stay, repeated rows go or stay together."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, items).filter("contaminated").select("doc_id", F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))
    return rows.join(found, _same(rows, found), "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of ``CAPACITY`` tokens; null and empty texts have their end id alone, repeated rows are packed each."""
    small_batches(spark)
    return pack(docs, tokenizer(), CAPACITY)


STAGES = [("language_id", identify_language), ("line_dedup", drop_template_lines), ("near_dedup", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: A trained field decides the first stage and a tokenizer's ids the last, so SQL can't give run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
