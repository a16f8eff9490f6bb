"""Corpus cleaning as five stages; each is an operator of scoutframe.llm over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutframe.llm.common import crc_mod, with_row
from scoutframe.llm.decontam import decontaminate
from scoutframe.llm.langid import UNDETERMINED, fit_profiles, has_letter, identify
from scoutframe.llm.packing import pack
from scoutframe.llm.queries import table, vocabulary
from scoutframe.llm.simhash import near_duplicates
from scoutframe.llm.substring_dedup import substring_dedup
from scoutframe.session import scratch_path, small_side

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without any letter go.

    Where no labelled row gives a profile (``lang`` all NULL, or no labelled row to train on) no language can be
    told, and every document with a letter stays.
    """
    profiles = fit_profiles(docs, crc_mod("doc_id", 3) != 1)
    if not profiles:
        return docs.where(has_letter(F.col("text"))).select(*COLUMNS)
    found = identify(docs, profiles, lang_pred="_lang_pred", score="_score")
    return found.where(F.col("_lang_pred") != UNDETERMINED).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates: that with the smallest id, whatever ids repeat or are NULL.

    NULL ids come last; of rows with the same id the first stored one stays.
    """
    rows = with_row(docs)
    groups = near_duplicates(rows.select("doc_id", "text", "_file", "_at"), carry=("_file", "_at"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_file", "_at")
    first = groups.groupBy("component").agg(F.min_by(F.struct("_file", "_at"), order).alias("row")).select("row.*")
    return rows.join(first, ["_file", "_at"], "left_semi").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; one of which nothing is left goes."""
    out = substring_dedup(docs, carry=("lang", "source"), untouched_as_is=True)
    left = out.where((F.col("n_removed") == 0) | (F.col("kept") != "")).withColumnRenamed("kept", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; rows that share an id, also NULL, are told apart by their text."""
    found = decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    hit = small_side(hit, 100_000)  # of 16 bytes; beyond, the rows meet by shuffle
    same = docs["doc_id"].cast("long").eqNullSafe(hit["_id"]) & (F.xxhash64(docs["text"]) == hit["_hash"])
    return docs.join(hit, same, "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", language), ("near_duplicate", near_duplicate), ("substrings", substrings),
    ("decontamination", decontamination), ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
