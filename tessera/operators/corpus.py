"""Corpus-level filters, profiles and repository
rollups.  All are per-row expressions or one grouped aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import PRUNED_DIRS
from ..functions.text import short_path

# FIXED VALUES: extension -> language (S06); everything else is ''.
EXT_LANG = {".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
            ".ts": "typescript", ".tsx": "typescript"}
# FIXED VALUES: entry-point basenames.
ENTRY_BASENAMES = ["main.go", "main.py", "index.js", "app.go", "cmd.go"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_pruned(path: Column) -> Column:
    """Any path segment is a pruned directory."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in PRUNED_DIRS]))


def is_binary(content: Column) -> Column:
    """A NUL character within the first 1024 characters."""
    return F.instr(F.substring(content, 1, 1024), "\u0000") > 0


def language(path: Column) -> Column:
    """Language by lower-cased extension, '' when unsupported."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    m = F.create_map(*[x for kv in EXT_LANG.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(m, ext), F.lit(""))


def is_test_file(path: Column) -> Column:
    """P05 on the lower-cased basename."""
    b = F.lower(basename(path))
    return (b.endswith("_test.go") | b.endswith("_test.py") | b.endswith("_test.js") | b.endswith("_test.ts")
            | b.endswith("test.java") | b.endswith("spec.rb") | b.contains("test_") | b.contains("_spec."))


def is_entry_point(path: Column) -> Column:
    """P06."""
    b = F.lower(basename(path))
    return b.isin(*ENTRY_BASENAMES) | b.startswith("main.")


def is_minified(path: Column) -> Column:
    """P04."""
    return path.contains("min.js") | path.contains(".min.")


def profile(corpus: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """S04–S06, S12, P04–P06, T09 per file; ``indexable`` = S05 (not
    empty, not all whitespace, no larger than ``max_file_bytes`` where that is
    given) and not pruned / binary."""
    c, p = F.col("content"), F.col("path")
    size = F.octet_length(c).cast("long")
    fits = F.lit(True) if max_file_bytes is None else size <= max_file_bytes
    keep = ((size >= 1) & fits & (F.regexp_replace(c, r"\s", "") != "")
            & ~is_pruned(p) & ~is_binary(c))
    return corpus.select(
        "repo", "path", size.alias("size"), F.size(F.split(c, "\n", -1)).cast("long").alias("n_lines"),
        F.sha2(c, 256).alias("sha256"), F.substring(F.sha2(c, 256), 1, 32).alias("summary_hash"),
        is_binary(c).alias("is_binary"), keep.alias("indexable"), language(p).alias("language"),
        is_test_file(p).alias("is_test"), is_entry_point(p).alias("is_entry"), is_minified(p).alias("is_minified"),
        short_path(p).alias("short_path"))


def repository_status(corpus: DataFrame) -> DataFrame:
    """Files, directories, bytes per repository after pruning."""
    c = corpus.where(~is_pruned(F.col("path")))
    d = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return c.groupBy("repo").agg(F.count(F.lit(1)).alias("files"),
                                 F.countDistinct(F.when(d != "", d)).alias("dirs"),
                                 F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def repository_metadata(corpus: DataFrame) -> DataFrame:
    """Sorted non-dot top-level entries, total files, total lines
    (newlines + 1 over non-binary files; the line pass is unpruned)."""
    top = F.element_at(F.split("path", "/"), 1)
    lines = F.when(~is_binary(F.col("content")), F.size(F.split("content", "\n", -1)))
    return corpus.groupBy("repo").agg(
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(~top.startswith("."), top)))).alias("top_level"),
        F.count(F.lit(1)).alias("total_files"), F.sum(lines).cast("long").alias("total_lines"))


def directory_rollup(corpus: DataFrame) -> DataFrame:
    """rollup(repo, dir) of file counts and bytes."""
    d = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return corpus.select("repo", d.alias("dir"), F.octet_length("content").alias("bytes")).rollup("repo", "dir") \
        .agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("long").alias("bytes"))


# FIXED VALUES: binary extensions (S03, case-sensitive) and the wider
# indexable-extension list of the state check (P10).
BINARY_EXTS = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".zip",
               ".tar", ".gz", ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".pyc", ".class"]
INDEXABLE_EXTS = [".go", ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".rs", ".rb", ".java", ".c", ".cpp", ".h", ".hpp",
                  ".cs", ".php", ".swift", ".kt", ".scala", ".sh", ".sql", ".html", ".css", ".json", ".yaml", ".yml",
                  ".md", ".toml", ".lua", ".zig"]


def _ext(path: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\.[^.]*)$", 1)


def has_binary_extension(path: Column) -> Column:
    """S03."""
    return _ext(path).isin(*BINARY_EXTS)


def is_indexable_extension(path: Column) -> Column:
    """P10."""
    return _ext(path).isin(*INDEXABLE_EXTS)


def file_listing(corpus: DataFrame) -> DataFrame:
    """Relative paths ascending per repository (a global sort)."""
    return corpus.select("repo", "path").orderBy("repo", "path")
