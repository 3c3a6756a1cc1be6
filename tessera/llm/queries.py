"""The operators bound to the driver tables: name -> (query, DuckDB SQL or
None).  A query gets its rows through its operator and only derives the
digest columns which its contract names."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, divergence, grid_join, licenses, line_crf, lsh_forest, mixing, resample, secrets, sentence_spans,
               suffix_spans, token_files)
from .common import held_out, ship, table

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = (query, sql)
        return query
    return deco


@register("op1_license_scan", licenses.ORACLE_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents"))


@register("op2_lm_score")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.score_texts(table(spark, sf, "documents"))


@register("op3_secret_scan")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == list(secrets.KINDS).index(kind))).cast("long")

    def standing(name: str):
        return F.size(F.filter("spans", lambda s: s["standing"] == name)).cast("long")

    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), count("general").alias("n_general"),
                        F.sha2(secrets.span_names(secrets.base_spans("spans")), 256).alias("base_sha256"),
                        secrets.span_names(F.col("spans")).alias("spans"),
                        standing("live").alias("n_live"), standing("copied").alias("n_copied"))


@register("op4_byte_bpe")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@register("op5_token_files")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, path)


@register("op6_grid_join")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return grid_join.near_vectors(table(spark, sf, "embeddings"))


@register("op7_sentence_spans")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    found = sentence_spans.repeated_sentences(table(spark, sf, "documents"), both_ends=True)
    covered = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    places = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_sentences", covered.alias("n_removed"), places.alias("removed"), "first_docs")


@register("op8_lsh_forest")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf, "documents")).drop("digest", "group")


@register("op9_decontamination")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       decontaminate.contaminated().alias("contaminated"))


@register("op10_quality")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = line_crf.score_quality(docs, line_crf.train(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", held_out("doc_id", line_crf.MODULUS).alias("held_out"), "score",
                         (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted"))


@register("op11_source_divergence", divergence.ORACLE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergence(table(spark, sf, "documents"))


@register("op12_importance_draw", resample.ORACLE_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@register("op13_suffix_spans")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_spans.remove_repeats(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
