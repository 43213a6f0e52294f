"""From raw documents to token ids, each stage on all that the one before kept.

Defined results: null and empty texts are scored by the classifier like any
other and stay after it (they are no one's copies, have no words to lose and
contain no item) with no tokens; rows with a null ``doc_id`` stay and are
compared with nothing; rows that repeat a ``doc_id`` stay or go as the
operators say of each; an empty table stays empty; other columns stay up to
the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import bpe, contamination, ngram_join, quality, substring_dedup
from ledgerscope.llm.common import materialize

#: What near copies are in this pipeline; the query op7_ngram_jaccard has a contract of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking doesn't reject."""
    ranking = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, ranking).where("predicted = 1").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that links of ``NEAR_WORDS``-word n-grams connect."""
    return ngram_join.one_of_each(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has too; texts that lose nothing stay as they are."""
    cut = substring_dedup.remove_repeats(docs).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, checked by decoding them again."""
    coded = bpe.round_trip(docs.select("doc_id", "text"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding", as_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
