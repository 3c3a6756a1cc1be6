"""Answer-shaped compression of ranked results into context
text.  Each question's results are already cut to a small top-k, so the
per-question list is bounded; rendering is array HOFs over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_path

NL = "\n"


def clean_snippet(snippet: Column) -> Column:
    """Collapse repeated blank lines, drop generated-code headers,
    keep 3 lines of an import block then a marker, truncate single
    imports after the 4th — a fold over the snippet's lines."""
    lines = F.split(snippet, NL, -1)
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("cnt"), F.lit(False).alias("blk"))

    def step(acc, line):
        t = F.regexp_replace(line, r"^\s+|\s+$", "")
        out, cnt, blk = acc["out"], acc["cnt"], acc["blk"]
        last_blank = (F.size(out) > 0) & (F.element_at(F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("x"))), -1) == "")
        app = lambda *xs: F.concat(out, F.array(*xs))
        S = lambda o, c, b: F.struct(o.alias("out"), c.alias("cnt"), b.alias("blk"))
        starts_blk = t.startswith("import (") | line.startswith("import {")
        ends_blk = t.isin(")", "}", "];", "};")
        single = t.startswith("import ") & ~t.contains("(")
        return (
            F.when((t == "") & last_blank, acc)
            .when(t.startswith("// Code generated by") | t.startswith("// DO NOT EDIT"), acc)
            .when(starts_blk, S(F.when(cnt + 1 <= 3, app(line)).otherwise(out), cnt + 1, F.lit(True)))
            .when(blk & ends_blk, S(F.when(cnt + 1 > 3, app(F.lit("  // ... imports truncated ..."), line))
                                    .otherwise(app(line)), cnt + 1, F.lit(False)))
            .when(blk, S(F.when(cnt + 1 <= 3, app(line)).otherwise(out), cnt + 1, F.lit(True)))
            .when(single & (cnt + 1 > 5), S(out, cnt + 1, blk))
            .when(single & (cnt + 1 == 5), S(app(F.lit("// ... more imports truncated ...")), cnt + 1, blk))
            .when(single, S(app(line), cnt + 1, blk))
            .otherwise(S(app(line), cnt, blk)))

    return F.concat_ws(NL, F.aggregate(lines, zero, step)["out"])


def _head(file: Column, line_from: Column) -> Column:
    return F.when(line_from > 0, F.concat(short_path(file), F.lit(":"), line_from.cast("string"))).otherwise(short_path(file))


def compress(results: DataFrame, questions: DataFrame) -> DataFrame:
    """C08 dispatcher per question over ``results(query_id, rank, file,
    snippet, line_from, line_to)`` and ``questions(query_id, answer_type,
    budget)``.  Output (query_id, answer_type, context, tokens, passed)."""
    r = results.select("query_id", "rank", "file", F.coalesce("snippet", F.lit("")).alias("snippet"),
                       F.coalesce("line_from", F.lit(0)).alias("line_from"),
                       F.coalesce("line_to", F.lit(0)).alias("line_to"))
    r = r.withColumn("clean", clean_snippet(F.col("snippet")))
    per_q = r.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "file", "snippet", "line_from", "line_to", "clean"))).alias("rows"))
    j = questions.select("query_id", "answer_type", "budget").join(per_q, "query_id")
    rows = F.col("rows")

    yes_no = F.concat_ws("", F.transform(rows, lambda x: F.concat(
        _head(x["file"], x["line_from"]), F.lit(NL),
        F.when(x["snippet"] != "", F.concat_ws("", F.transform(F.slice(F.split(x["snippet"], NL, -1), 1, 3),
                                                              lambda l: F.concat(F.lit("  "), l, F.lit(NL)))))
        .otherwise(F.lit("")))))
    location = F.concat_ws("", F.transform(F.slice(rows, 1, 3), lambda x: F.concat(
        _head(x["file"], x["line_from"]),
        F.when((x["line_from"] > 0) & (x["line_to"] > x["line_from"]),
               F.concat(F.lit("-"), x["line_to"].cast("string"))).otherwise(F.lit("")), F.lit(NL))))

    def listing(header):
        items = F.flatten(F.transform(rows, lambda x: F.when(
            x["snippet"] != "",
            F.filter(F.transform(F.split(x["snippet"], NL, -1), lambda l: F.regexp_replace(l, r"^\s+|\s+$", "")),
                     lambda t: t != "")).otherwise(F.array(short_path(x["file"])))))
        return F.concat(F.lit(header), F.concat_ws("", F.transform(F.array_distinct(items),
                                                                  lambda t: F.concat(F.lit("  "), t, F.lit(NL)))))

    def blocks(n, cap, fmt_with, fmt_without):
        parts = F.transform(F.slice(rows, 1, n), lambda x: F.when(
            x["snippet"] != "", fmt_with(short_path(x["file"]), F.when(F.length(x["clean"]) > cap, F.concat(
                x["clean"].substr(F.lit(1), F.lit(cap)), F.lit("..."))).otherwise(x["clean"])))
            .otherwise(fmt_without(short_path(x["file"]))))
        # keep blocks while the text before them is under the budget
        # (the block that reaches the budget is kept, later ones are not)
        lens = F.transform(parts, lambda p: F.octet_length(p))
        cum_before = F.transform(F.sequence(F.lit(0), F.size(parts) - 1),
                                 lambda i: F.aggregate(F.slice(lens, 1, i), F.lit(0), lambda a, b: a + b))
        keep = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.floor(F.element_at(cum_before, i) / 4) < F.col("budget"))
        kept = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.element_at(keep, i))
        return F.concat_ws("", F.transform(kept, lambda i: F.element_at(parts, i)))

    overview = blocks(8, 500, lambda p, s: F.concat(F.lit("File: "), p, F.lit(NL), s, F.lit(NL + NL)),
                      lambda p: F.concat(F.lit("File: "), p, F.lit(NL)))
    default = blocks(10, 1000, lambda p, s: F.concat(F.lit("=== "), p, F.lit(" ===" + NL), s, F.lit(NL + NL)),
                     lambda p: F.concat(F.lit("=== "), p, F.lit(" ===" + NL)))
    at = F.col("answer_type")
    ctx = (F.when(at == "yes_no", yes_no).when(at == "location", location)
           .when(at == "caller", listing("Callers:" + NL)).when(at == "reference", listing("References:" + NL))
           .when(at == "overview", overview).otherwise(default))
    out = j.select("query_id", "answer_type", ctx.alias("context"))
    return out.select("*", (F.octet_length("context") / 4).cast("long").alias("tokens"),
                      F.lit(True).alias("passed"))
