"""Catalog entry: C06–C08 compression of full-text results by answer type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.classify import answer_type, limits
from ..functions import classify_rules as R
from ..operators.compress import compress
from ..operators.fulltext import fulltext_search
from ..oracle.classify_sql import answer_type_sql
from ..oracle.fulltext import fulltext_sql
from ..sources import tables as T
from .catalog import register


def compress_sql():
    typ, _ = answer_type_sql("text")
    bud = " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in R.LIMITS.items())
    sp = "CASE WHEN instr(f, '/internal/') > 0 THEN substr(f, instr(f, '/internal/') + 1) " \
         "WHEN instr(f, '/cmd/') > 0 THEN substr(f, instr(f, '/cmd/') + 1) " \
         "WHEN instr(f, '/pkg/') > 0 THEN substr(f, instr(f, '/pkg/') + 1) ELSE string_split(f, '/')[-1] END"

    def short(x):
        return sp.replace("f", x) if False else sp.replace("(f,", f"({x},").replace("substr(f,", f"substr({x},").replace("split(f,", f"split({x},")

    parts = (f"list_transform(rows[1:10], lambda x: CASE WHEN x.snippet <> '' THEN '=== ' || {short('x.file')} || ' ===' || chr(10) || "
             f"(CASE WHEN length(x.snippet) > 1000 THEN left(x.snippet, 1000) || '...' ELSE x.snippet END) || chr(10) || chr(10) "
             f"ELSE '=== ' || {short('x.file')} || ' ===' || chr(10) END)")
    return f"""
WITH res AS ({fulltext_sql()}),
rk AS (SELECT query_id, file, snippet, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25 DESC, file, repo) AS rank
       FROM res),
q AS (SELECT item_id AS query_id, {typ} AS answer_type FROM benchmark),
qb AS (SELECT query_id, answer_type, CASE answer_type {bud} ELSE {R.DEFAULT_LIMITS[1]} END AS budget FROM q),
pq AS (SELECT query_id, list(struct_pack(rank := rank, file := file, snippet := coalesce(snippet, '')) ORDER BY rank) AS rows
       FROM rk WHERE rank <= 10 GROUP BY query_id),
j AS (SELECT qb.*, {parts} AS parts FROM qb JOIN pq USING (query_id)),
k AS (SELECT *, list_transform(range(1, len(parts) + 1),
          lambda i: (list_sum(list_transform(parts[1:i - 1], lambda p: strlen(p))) IS NULL
                     OR coalesce(list_sum(list_transform(parts[1:i - 1], lambda p: strlen(p))), 0) // 4 < budget)) AS keep FROM j)
SELECT query_id, answer_type,
       array_to_string(list_filter(parts, lambda p, i: keep[i]), '') AS context,
       CAST(strlen(array_to_string(list_filter(parts, lambda p, i: keep[i]), '')) // 4 AS BIGINT) AS tokens,
       true AS passed
FROM k"""


@register("c08_compress_fulltext", compress_sql)
def q_c08(spark, sf):
    qs = T.queries_from_benchmark(spark, sf)
    res = fulltext_search(T.corpus_from_documents(spark, sf), qs, index=T.documents_index(spark, sf))
    # same cross-repository order as the oracle (scores compared at 6 places)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), F.round("bm25", 6).desc(), "file", "repo")
    top = (res.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10)
           .select("query_id", "rank", "file", "snippet", F.lit(0).alias("line_from"), F.lit(0).alias("line_to")))
    typ, _ = answer_type(F.col("text"))
    q = qs.select("query_id", typ.alias("answer_type"))
    _, bud, _ = limits(F.col("answer_type"))
    return compress(top, q.select("*", bud.alias("budget")))
