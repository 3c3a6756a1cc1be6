"""Tool-shaped entry points — thin functions over the batch
operators, each with the reference's default token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import repository_summary
from ..operators.incremental import index_update_counts, manifest_diff
from .routing import IndexTables, run_retriever, search_code

# FIXED VALUES: default budgets per tool.
BUDGETS = {"find_symbol": 500, "find_references": 1500, "find_callers": 1500, "grep": 1500}


def _with_budget(df: DataFrame, tool: str) -> DataFrame:
    return df.withColumn("budget", F.lit(BUDGETS[tool]))


def find_symbol(questions: DataFrame, idx: IndexTables) -> DataFrame:
    return _with_budget(run_retriever("symbol", questions, idx), "find_symbol")


def find_references(questions: DataFrame, idx: IndexTables) -> DataFrame:
    return _with_budget(run_retriever("reference", questions, idx), "find_references")


def find_callers(questions: DataFrame, idx: IndexTables) -> DataFrame:
    return _with_budget(run_retriever("callgraph", questions, idx), "find_callers")


def grep(questions: DataFrame, idx: IndexTables) -> DataFrame:
    return _with_budget(run_retriever("grep", questions, idx), "grep")


def summary(symbols: DataFrame, corpus: DataFrame) -> DataFrame:
    return repository_summary(symbols, corpus)


def index(old_manifest: DataFrame, new_manifest: DataFrame) -> DataFrame:
    return index_update_counts(manifest_diff(old_manifest, new_manifest))


__all__ = ["find_symbol", "find_references", "find_callers", "grep", "summary", "index", "search_code"]
