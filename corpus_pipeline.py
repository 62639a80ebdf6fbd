"""The corpus pipeline: what of documents goes into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import materialize, table
from postlens.llm.mixing import lay_out, mix
from postlens.llm.packing import pack_documents
from postlens.llm.paragraphs import remove_passages
from postlens.llm.quality import keep_good
from postlens.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest doc_id."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds too."""
    return remove_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix's shards draw them, shard by shard and shuffled inside; where one takes a part, that part's words."""
    taken = mix(docs).where("_whole or _words > 0")
    words = F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), "")
    size = F.when(F.col("_whole"), F.col("n_chars")).otherwise(F.length(part).cast("long"))
    taken = taken.withColumns({"n_chars": size, "text": F.when(F.col("_whole"), F.col("text")).otherwise(part)})
    return lay_out(taken).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents as pieces of sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
