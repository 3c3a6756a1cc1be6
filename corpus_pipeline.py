"""Cleaning of a training corpus: each stage reads what the one before kept.

quality classifier, near duplicates, benchmark decontamination, secret scans,
byte-level BPE.  A stage takes (spark, docs, sf_dir), is written as Parquet
and read again; all but the last return the columns of ``documents``."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, line_crf, lsh_forest, secrets
from tessera.llm.common import ship, table, written
from tessera.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold.  The fit takes labelled
    rows of this stage's own input."""
    ship(spark)
    return line_crf.keep_good(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id (a null id
    after all others) and digest, and of repeated rows of that id and text one.
    What goes back to the texts is the list of rows to drop or to thin out,
    which is empty for most documents."""
    ship(spark)
    found = lsh_forest.near_duplicates(docs)
    # rows of one id and text are one row more often than needed; those without shingles have a group each
    per_key = found.groupBy("doc_id", "digest").agg(F.min("group").alias("group"), F.count("*").alias("drop_n"))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    per_group = per_key.groupBy("group").agg(F.min(place).alias("first"))
    per_group = written(per_group, "groups")    # a side of its own, so that a large group can be split in the join
    judged = per_key.join(per_group, "group").select(
        F.col("doc_id").alias("drop_id"), F.col("digest").alias("drop_digest"), "drop_n",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("drop_stays"))
    drop = judged.where(~F.col("drop_stays") | (F.col("drop_n") > 1))
    keyed = docs.withColumn("drop_text", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("drop_text") == F.col("drop_digest"))
    joined = keyed.join(drop, same, "left")
    whole = joined.where(F.col("drop_id").isNull() & F.col("drop_n").isNull()).select(*docs.columns)
    thinned = joined.where("drop_stays and drop_n > 1").dropDuplicates(["doc_id", "drop_text"]).select(*docs.columns)
    return whole.unionByName(thinned)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    ship(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that are not widely copied are masked."""
    ship(spark)
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    ship(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination),
          ("secret scan", secret_scan), ("byte-level BPE", encoding)]

# No stage but the scans can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
