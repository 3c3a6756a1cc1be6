"""Code line rules (no parser library).

Everything runs per corpus row on the file's line array: definitions are
matched by per-language line patterns, a definition's scope ends before
the next non-blank line indented at most as deep (Python-style blocks;
brace languages use the same rule on their indentation), the innermost
enclosing function owns each call.  Output tables are exploded from
bounded per-file arrays, so no shuffle is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import language

SIGNATURE_CAP = 200
# FIXED VALUES: definition line rules per language: (pattern, kind); the
# first matching rule of a line wins; group 1 is the name.
RULES = {
    "python": [(r"^\s*class\s+(\w+)", "class"), (r"^\s*def\s+(\w+)\s*\(\s*self\b", "method"),
               (r"^\s*(?:async\s+)?def\s+(\w+)", "function")],
    "go": [(r"^func\s+\([^)]*\)\s*(\w+)", "method"), (r"^func\s+(\w+)", "function"),
           (r"^type\s+(\w+)\s+struct\b", "struct"), (r"^type\s+(\w+)\s+interface\b", "interface"),
           (r"^type\s+(\w+)", "class")],
    "javascript": [(r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)", "class"),
                   (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", "function"),
                   (r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)", "function"),
                   (r"^\s+(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{", "method")],
}
RULES["typescript"] = [(r"^\s*(?:export\s+)?interface\s+(\w+)", "interface")] + RULES["javascript"]
CALL_RE = r"([A-Za-z_][\w.]*)\s*\("
KEYWORDS = ["if", "for", "while", "return", "def", "class", "func", "function", "switch", "catch", "elif", "print",
            "not", "and", "or", "in", "with", "lambda"]


def _def_of(line: Column, lang: Column) -> Column:
    """struct(kind, name) of the first matching rule, or null."""
    out = F.lit(None).cast("struct<kind:string,name:string>")
    for lg, rules in RULES.items():
        for pattern, kind in reversed(rules):
            hit = (lang == lg) & line.rlike(pattern)
            out = F.when(hit, F.struct(F.lit(kind).alias("kind"),
                                       F.regexp_extract(line, pattern, 1).alias("name"))).otherwise(out)
    return out


def with_lines(corpus: DataFrame) -> DataFrame:
    """Per file: lines, indentation, non-blank flags, language."""
    c = corpus.select("repo", "path", F.split("content", "\n", -1).alias("lines"), language(F.col("path")).alias("lang"))
    c = c.withColumn("indent", F.transform("lines", lambda l: F.length(l) - F.length(F.ltrim(l))))
    return c.withColumn("blank", F.transform("lines", lambda l: F.regexp_replace(l, r"\s", "") == ""))


def definitions(corpus: DataFrame) -> DataFrame:
    """(repo, path, kind, name, start_line, end_line, signature)."""
    c = with_lines(corpus)
    c = c.withColumn("defs", F.filter(F.transform("lines", lambda l, i: F.struct(
        (i + 1).alias("line"), _def_of(l, F.col("lang")).alias("d"))), lambda x: x["d"].isNotNull()))
    n = F.size("lines")

    def end_of(x):
        ind = F.element_at(F.col("indent"), x["line"])
        nxt = F.filter(F.sequence(x["line"] + 1, F.greatest(n, x["line"] + 1)),
                       lambda j: (j <= n) & ~F.element_at(F.col("blank"), j) & (F.element_at(F.col("indent"), j) <= ind))
        last_nb = F.filter(F.sequence(x["line"], n), lambda j: ~F.element_at(F.col("blank"), j))
        return F.coalesce(F.try_element_at(nxt, F.lit(1)) - 1, F.try_element_at(last_nb, F.lit(-1)), x["line"])

    c = c.withColumn("defs", F.transform("defs", lambda x: F.struct(
        x["line"].alias("start_line"), x["d"]["kind"].alias("kind"), x["d"]["name"].alias("name"),
        end_of(x).alias("end_line"))))
    d = c.select("repo", "path", "lang", "lines", F.explode("defs").alias("d"))
    # end_line may stop on trailing blank lines: trim them back
    sig_full = F.regexp_replace(F.element_at(F.col("lines"), F.col("d.start_line")), r"^\s+|\s+$", "")
    sig = F.when(F.length(sig_full) > SIGNATURE_CAP,
                 F.concat(sig_full.substr(F.lit(1), F.lit(SIGNATURE_CAP)), F.lit("..."))).otherwise(sig_full)
    return d.select("repo", "path", F.col("lang").alias("language"), "d.kind", "d.name", "d.start_line", "d.end_line",
                    sig.alias("signature"))


def python_imports(corpus: DataFrame) -> DataFrame:
    """X06 (Python): ``import a.b as c`` -> a; ``from m import x as y`` -> x."""
    c = with_lines(corpus).where(F.col("lang") == "python")
    rows = c.select("repo", "path", F.posexplode("lines").alias("i", "l"))
    imp = F.regexp_extract("l", r"^\s*import\s+(.+)$", 1)
    frm = F.regexp_extract("l", r"^\s*from\s+\S+\s+import\s+(.+)$", 1)
    a = rows.where(imp != "").select("repo", "path", (F.col("i") + 1).alias("line"),
                                     F.explode(F.split(imp, r"\s*,\s*")).alias("item")) \
        .select("repo", "path", "line", F.split(F.regexp_replace("item", r"\s+as\s+\w+$", ""), r"\.")[0].alias("name"))
    b = rows.where(frm != "").select("repo", "path", (F.col("i") + 1).alias("line"),
                                     F.explode(F.split(frm, r"\s*,\s*")).alias("item")) \
        .select("repo", "path", "line", F.regexp_replace(F.regexp_replace("item", r"\s+as\s+\w+$", ""), r"[()\s]", "")
                .alias("name"))
    return a.unionByName(b).where(F.col("name") != "").withColumn("ref_type", F.lit("import"))


def call_edges(corpus: DataFrame) -> DataFrame:
    """Innermost enclosing named function -> callee (last identifier
    of the call target) per call on a body line; top-level calls are
    dropped."""
    defs = definitions(corpus).where(F.col("kind").isin("function", "method"))
    scopes = defs.groupBy("repo", "path").agg(F.collect_list(F.struct("start_line", "end_line", "name")).alias("scopes"))
    c = with_lines(corpus).join(scopes, ["repo", "path"])
    rows = c.select("repo", "path", "scopes", F.posexplode("lines").alias("i", "l")).withColumn("line", F.col("i") + 1)
    kw = F.array(*[F.lit(k) for k in KEYWORDS])
    calls = rows.select("repo", "path", "scopes", "line",
                        F.explode(F.regexp_extract_all("l", F.lit(CALL_RE), F.lit(1))).alias("target"))
    calls = calls.withColumn("callee", F.element_at(F.split("target", r"\."), -1)).where(~F.array_contains(kw, F.col("callee")))
    owner = F.filter("scopes", lambda s: (s["start_line"] < F.col("line")) & (s["end_line"] >= F.col("line")))
    inner = F.aggregate(owner, F.lit(None).cast("struct<start_line:int,end_line:int,name:string>"),
                        lambda acc, s: F.when(acc.isNull() | (s["start_line"] > acc["start_line"]), s).otherwise(acc))
    out = calls.select("repo", "path", "line", "callee", inner["name"].alias("caller"))
    return out.where(F.col("caller").isNotNull()).select(
        "repo", F.col("caller").alias("caller_name"), F.col("path").alias("caller_file"),
        F.col("callee").alias("callee_name"), F.col("path").alias("file"), "line")


# FIXED VALUES: identifiers always taken as references (X05, Python/JS).
REF_WORDS = ["self", "cls", "this", "it", "err", "nil", "true", "false", "None", "True", "False"]


def references(corpus: DataFrame, top_level_only: bool = False) -> DataFrame:
    """Identifier tokens of >= 2 chars that start upper-case or are
    one of REF_WORDS, one row per (line, identifier); context = trimmed
    line, at most 120 chars + '...'.  Definition lines are skipped; with
    ``top_level_only`` lines inside function/class bodies are skipped too
    (the reference's behaviour, decision Q3)."""
    defs = definitions(corpus)
    c = with_lines(corpus)
    rows = c.select("repo", "path", "indent", F.posexplode("lines").alias("i", "l")).withColumn("line", F.col("i") + 1)
    deflines = defs.select("repo", "path", F.col("start_line").alias("line"))
    rows = rows.join(deflines, ["repo", "path", "line"], "left_anti")
    if top_level_only:
        spans = defs.select("repo", "path", "start_line", "end_line")
        inside = rows.join(spans, ["repo", "path"]).where(
            (F.col("line") > F.col("start_line")) & (F.col("line") <= F.col("end_line"))).select("repo", "path", "line")
        rows = rows.join(inside.distinct(), ["repo", "path", "line"], "left_anti")
    words = F.array(*[F.lit(w) for w in REF_WORDS])
    toks = rows.select("repo", "path", "line", "l", F.explode(F.regexp_extract_all("l", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)))
                       .alias("symbol_name"))
    toks = toks.where((F.length("symbol_name") >= 2) & (F.col("symbol_name").rlike("^[A-Z]")
                                                        | F.array_contains(words, F.col("symbol_name"))))
    t = F.regexp_replace("l", r"^\s+|\s+$", "")
    ctx = F.when(F.length(t) > 120, F.concat(t.substr(F.lit(1), F.lit(120)), F.lit("..."))).otherwise(t)
    return toks.select("repo", "symbol_name", F.col("path").alias("file"), "line",
                       F.lit("reference").alias("ref_type"), ctx.alias("context"))
