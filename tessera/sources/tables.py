"""S01/S22 — scans of the driver tables and the engine contracts built
from them (FIXTURES §3).  Everything is a lazy DataFrame; column
selection and filters reach the Parquet scan."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, spread

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def corpus_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus(repo, path, content, doc_id): repo = language, one file per
    document."""
    d = read_table(spark, sf_dir, "documents")
    return spread(d).select(
        F.col("lang").alias("repo"),
        F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"),
                 F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
        F.col("doc_id"),
    )


def corpus_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus(repo, path, content): repo = host of the url, path = url."""
    p = read_table(spark, sf_dir, "pages")
    return spread(p).select(
        F.expr("try_parse_url(url, 'HOST')").alias("repo"),
        F.col("url").alias("path"),
        F.col("html").alias("content"),
        F.col("page_id"),
    )


def with_file_stats(corpus: DataFrame) -> DataFrame:
    """Adds size (bytes), n_lines (newlines + 1) and sha256 of content."""
    return corpus.select(
        "*",
        F.octet_length("content").cast("long").alias("size"),
        (F.size(F.split("content", "\n", -1))).cast("long").alias("n_lines"),
        F.sha2("content", 256).alias("sha256"),
    )


def queries_from_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query batch: one question per benchmark item, whole text."""
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text"))


def symbols_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbols contract: name=p_name, kind=p_type, file=p_brand,
    start_line=p_size, end_line=p_size+10, signature=type+' '+name,
    id = first 16 hex chars of sha256(name|kind|file|line)."""
    p = read_table(spark, sf_dir, "part")
    # a symbol is upserted by its id: rows that repeat name, kind, file and line are one symbol
    p = p.groupBy("p_name", "p_type", "p_brand", "p_size").agg(F.min("p_partkey").alias("p_partkey"))
    out = p.select(
        F.lit("x").alias("repo"),
        F.col("p_partkey").alias("part_key"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("kind"),
        F.lit("x").alias("language"),
        F.col("p_brand").alias("file"),
        F.col("p_size").alias("start_line"),
        (F.col("p_size") + 10).alias("end_line"),
        F.concat_ws(" ", "p_type", "p_name").alias("signature"),
    )
    return out.withColumn(
        "id",
        F.substring(F.sha2(F.concat_ws("|", "name", "kind", "file",
                                       F.col("start_line").cast("string")), 256), 1, 16))


def call_edges_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_edges contract: caller=s<suppkey>, callee=p<partkey>,
    file=o<orderkey>, line=l_linenumber."""
    l = read_table(spark, sf_dir, "lineitem")
    return l.select(
        F.lit("x").alias("repo"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("caller_name"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("caller_file"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("callee_name"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"),
        F.col("l_linenumber").alias("line"),
        F.lit("x").alias("language"),
    )


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges (src, dst, relation) of the flow graph:
    nation->region, supplier->nation, customer->nation."""
    n = read_table(spark, sf_dir, "nation")
    s = read_table(spark, sf_dir, "supplier")
    c = read_table(spark, sf_dir, "customer")
    e1 = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"),
                  F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    e2 = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"),
                  F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    e3 = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"),
                  F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    return e1.unionByName(e2).unionByName(e3)


def retrieval_benchmarks_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """retrieval_benchmarks contract over events."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("retriever"),
        F.concat(F.lit("repo"), (F.col("user_id") % 5).cast("string")).alias("repository"),
        F.col("user_id"),
        (F.col("value") * 10).cast("long").alias("latency_ms"),
        (F.get_json_object("props", "$.k").cast("int") * 10).alias("tokens"),
        (F.col("event_id") % 3 == 0).alias("correct"),
        F.col("value"),
        F.col("ts").alias("timestamp"),
    )


def documents_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored full-text postings of the documents corpus: built on the first
    call, brought up to date by file hashes on later ones.  It lies in the
    shared checkpoint folder, under a name made of the tables' path."""
    from ..operators.textindex import stored_postings, update_index
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fulltext-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    update_index(corpus_from_documents(spark, sf_dir), path)
    return stored_postings(spark, path)
