"""A corpus pipeline: quality rules, MinHash near-dedup, suffix-array dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's documents. All but the last return the columns of documents.

In every stage: a null text is empty; rows without id are kept where their text is; no rows give no rows; columns beyond those of
documents are dropped, whatever their names. Repeated rows are judged each by the quality rules, go or stay together by
their id in the MinHash stage, lose nothing for each other's sake in the suffix stage, are drawn together by their id in the mixing
stage, and are packed each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import minhash, mixing, packing, quality, spread, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.quality(docs, keep=COLUMNS, only_kept=True).select(*COLUMNS)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more), and all others."""
    gone = minhash.near_duplicates(docs, words=5).where("NOT kept").select("doc_id")
    # as the ids grow with the corpus, one plan for every size: sorted and merged, never broadcast, so that both sides can spill
    return docs.join(gone.distinct().hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that an earlier document has; documents of which nothing is left go."""
    out = suffix_dedup.remove_repeated_bytes(docs, keep=("lang", "source", "n_chars"), keep_text=True)
    left = F.length("kept_text").cast("long")
    return out.where("n_removed = 0 OR kept_text <> ''").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, left).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities: shares of sources, languages and topics drawn together a little, nine tokens of ten kept."""
    return mixing.mix(docs, power=0.9, fraction=0.9, keep_all=False, carry=("text", "n_chars")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("minhash", minhash_stage), ("suffix", suffix_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't express the near-duplicate, suffix and packing stages; tests hold the pipeline against plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{spread.shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with spread.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:  # the next stage is written, so nothing reads this one any more
            spread.remove(spark, last)
        last = path
    return docs
