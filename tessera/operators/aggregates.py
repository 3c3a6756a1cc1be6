"""File summaries, module rollups, repository summaries and
table counts over a symbol index ``(repo, file, kind, name, line,
language)``.  Each is a grouped aggregate on file / directory / repo
keys; per-file lists are bounded by one file's symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import is_entry_point, is_test_file

FUNCTION_KINDS = ["function", "method"]
CLASS_KINDS = ["class", "struct", "interface"]


def _names(kinds):
    srt = F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("line", "name"))))
    return F.concat_ws("|", F.transform(srt, lambda s: s["name"]))


def file_summary(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """A01 for every file (repo, path, content): lines, symbol count, first
    language by line, functions and classes in line order, import count."""
    s = symbols.groupBy("repo", "file").agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.min_by("language", F.struct("line", "name")).alias("language"),
        _names(FUNCTION_KINDS).alias("functions"), _names(CLASS_KINDS).alias("classes"))
    i = refs.where(F.col("ref_type") == "import").groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n_imports"))
    f = files.select("repo", F.col("path").alias("file"), F.size(F.split("content", "\n", -1)).cast("long").alias("lines"))
    return f.join(s, ["repo", "file"], "left").join(i, ["repo", "file"], "left").fillna({"n_symbols": 0, "n_imports": 0})


def directory_of(file_col):
    return F.regexp_extract(file_col, r"^(.*)/[^/]*$", 1)


def module_rollup(symbols: DataFrame) -> DataFrame:
    """A02 per directory: basename, files, symbols, majority language
    (ties -> greatest language name, deterministic)."""
    per_file = symbols.groupBy("repo", "file", "language").agg(F.count(F.lit(1)).alias("n"))
    per_lang = per_file.groupBy("repo", directory_of(F.col("file")).alias("dir"), "language").agg(
        F.count(F.lit(1)).alias("lang_files"), F.sum("n").alias("lang_symbols"))
    return per_lang.groupBy("repo", "dir").agg(
        F.element_at(F.split("dir", "/"), -1).alias("name"),
        F.sum("lang_files").alias("files"), F.sum("lang_symbols").alias("n_symbols"),
        F.max_by("language", F.struct("lang_files", "language")).alias("language"))


def repository_summary(symbols: DataFrame, corpus: DataFrame) -> DataFrame:
    """A03 per repository: modules, top module by symbol count, files,
    symbols, test files, layers (distinct dirs), entry points."""
    mods = module_rollup(symbols)
    m = mods.groupBy("repo").agg(F.count(F.lit(1)).alias("modules"),
                                 F.max_by("dir", F.struct("n_symbols", F.col("dir"))).alias("top_module"),
                                 F.sum("n_symbols").alias("n_symbols"))
    c = corpus.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"), F.sum(is_test_file(F.col("path")).cast("long")).alias("tests"),
        F.countDistinct(directory_of(F.col("path"))).alias("layers"),
        F.sum(is_entry_point(F.col("path")).cast("long")).alias("entry_points"))
    return c.join(m, "repo", "left").fillna({"modules": 0, "n_symbols": 0})


def table_counts(symbols: DataFrame, refs: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols, references and call edges per repository."""
    parts = [symbols.select("repo", F.lit("symbols").alias("t")), refs.select("repo", F.lit("references").alias("t")),
             edges.select("repo", F.lit("edges").alias("t"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("repo").agg(*[F.sum((F.col("t") == t).cast("long")).alias(t) for t in ["symbols", "references", "edges"]])
