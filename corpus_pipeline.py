"""A corpus pipeline of the operators in ``cohortlab.llm``: toxicity, quality, near duplicates, repeated passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``.  ``run`` writes each stage's result as Parquet under the shared folder and rereads it for the next.

Nulls, empties, repeated rows and empty tables follow the operators: a null or empty text fails the quality rules; a row
with a null id is judged by its text, is no near duplicate and loses no passage; columns beyond those of ``documents`` come through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import few_files, read_table, save
from cohortlab.llm.minhash_dedup import near_duplicates
from cohortlab.llm.packing import pack
from cohortlab.llm.quality import keep_sound
from cohortlab.llm.substring import remove_repeats
from cohortlab.llm.toxicity import fit, score_of


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half; the lexicon is learned from the labelled documents."""
    lexicon = fit(docs, read_table(spark, sf_dir, "labels"))
    return few_files(docs.where(score_of(F.col("text").cast("string"), lexicon) < 0.5))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence rules keep."""
    return few_files(keep_sound(docs))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return few_files(docs.join(gone, "doc_id", "left_anti").select(*docs.columns))


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words or more that an earlier one has; untouched texts stay as they are."""
    tag = F.xxhash64("doc_id", "text")  # rows alike in both have one result, whatever their other columns
    found = remove_repeats(docs, tag=tag).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "kept_text")
    found = found.dropDuplicates(["_id", "_tag"])  # rows that repeat have one result
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), tag.alias("_tag"))
    joined = rows.join(found, ["_id", "_tag"], "left")
    new = {"text": F.coalesce("kept_text", F.col("_row.text")), "n_chars": F.coalesce(F.length("kept_text").cast("long"), F.col("_row.n_chars"))}
    return few_files(joined.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences with their token ids."""
    return few_files(pack(docs, with_ids=True))


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicate_removal),
    ("substrings", substring_removal),
    ("packing", packing),
]

#: Scores, sketches and token ids are not to be had in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
