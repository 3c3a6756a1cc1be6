"""Catalog entries: HTML extraction (X rules on pages), packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as Cx
from ..operators import html as H
from ..operators.fulltext import fulltext_search
from ..sources import tables as T
from .catalog import register
from .util import round_doubles, sql_round

PAGES = "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS repo, url AS path, html AS content FROM pages"


def _x(pattern):
    return "'" + pattern.replace("'", "''") + "'"


@register("x_html_symbols", lambda: f"""
WITH p AS ({PAGES}),
t AS (SELECT repo, path, 'class' AS kind, regexp_extract_all(content, {_x(H.TITLE_RE.replace('(?is)', '(?is)'))}, 1) AS xs FROM p
      UNION ALL
      SELECT repo, path, 'function' AS kind, regexp_extract_all(content, {_x(H.H1_RE)}, 1) AS xs FROM p)
SELECT repo, path, kind, CAST(generate_subscripts(xs, 1) - 1 AS INTEGER) AS ordinal, unnest(xs) AS name FROM t""")
def q_xsym(spark, sf):
    return H.html_symbols(T.corpus_from_pages(spark, sf))


@register("x_html_references", lambda: f"""
WITH p AS ({PAGES}), t AS (SELECT repo, path, regexp_extract_all(content, {_x(H.HREF_RE)}, 1) AS xs FROM p)
SELECT repo, path, CAST(generate_subscripts(xs, 1) - 1 AS INTEGER) AS ordinal, unnest(xs) AS target, 'import' AS ref_type FROM t""")
def q_xref(spark, sf):
    return H.html_references(T.corpus_from_pages(spark, sf))


@register("a11_reference_breakdown", lambda: f"""
WITH p AS ({PAGES}), t AS (SELECT path, unnest(regexp_extract_all(content, {_x(H.HREF_RE)}, 1)) AS target FROM p)
SELECT target, count(*) AS refs, count(DISTINCT path) AS files FROM t GROUP BY target""")
def q_a11(spark, sf):
    return H.reference_breakdown(H.html_references(T.corpus_from_pages(spark, sf)))


def packing_sql(budget: int = 300) -> str:
    from ..oracle.fulltext import fulltext_sql
    return sql_round(f"""
WITH res AS ({fulltext_sql()}),
pq AS (SELECT CAST(query_id AS VARCHAR) || ':' || repo AS query_id,
              list(struct_pack(rank := rank, file := file, score := score, tokens := tokens) ORDER BY rank) AS items
       FROM res GROUP BY 1),
f AS (SELECT query_id, items, list_reduce(items, lambda acc, x: CASE WHEN acc.used + x.tokens <= {budget}
          THEN {{'used': acc.used + x.tokens, 'kept': list_append(acc.kept, x.file), 'dropped': acc.dropped}}
          ELSE {{'used': acc.used, 'kept': acc.kept, 'dropped': acc.dropped + 1}} END,
          {{'used': CAST(0 AS BIGINT), 'kept': []::VARCHAR[], 'dropped': CAST(0 AS BIGINT)}}) AS p FROM pq)
SELECT query_id, p.used AS tokens, CAST(len(p.kept) AS INTEGER) AS selected, p.dropped AS dropped,
       array_to_string(p.kept, '|') AS kept_files,
       len(list_filter(items, lambda x: x.score > 0)) / len(items) AS precision, p.used / {budget} AS efficiency
FROM f""", ["precision", "efficiency"])


@register("c01_greedy_packing", packing_sql)
def q_c01(spark, sf):
    """Full-text top-5 per (query, repo) packed into a 300-token budget
    per query (rows-only in the driver; exact in pytest)."""
    res = fulltext_search(T.corpus_from_documents(spark, sf), T.queries_from_benchmark(spark, sf),
                          index=T.documents_index(spark, sf))
    ranked = res.select(F.concat_ws(":", F.col("query_id").cast("string"), "repo").alias("query_id"),
                        "rank", "file", "score", "tokens")
    return round_doubles(Cx.greedy_pack(ranked, budget=300))
