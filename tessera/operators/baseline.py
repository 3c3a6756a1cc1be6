"""R21 static baseline: README 1.0, docs files 0.8, other top-level
non-dot files 0.5; question-independent, so computed once per corpus
(never multiplied by the question batch); README kept once (Q7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import DOCS_DIRS, README_NAMES


def static_baseline(corpus: DataFrame, max_docs_bytes: int | None = None) -> DataFrame:
    """``max_docs_bytes`` leaves out docs files of that size and more."""
    p = F.col("path")
    top = F.element_at(F.split(p, "/"), 1)
    small = F.lit(True) if max_docs_bytes is None else F.octet_length("content") < max_docs_bytes
    score = (F.when(p.isin(*README_NAMES), 1.0)
             .when(top.isin(*DOCS_DIRS) & p.contains("/") & small, 0.8)
             .when(~p.contains("/") & ~p.startswith("."), 0.5))
    return (corpus.select("repo", F.col("path").alias("file"), score.alias("score"), F.col("content").alias("snippet"))
            .where(F.col("score").isNotNull())
            .withColumn("tokens", (F.octet_length("snippet") / 4).cast("long"))
            .withColumn("retriever", F.lit("baseline")))
