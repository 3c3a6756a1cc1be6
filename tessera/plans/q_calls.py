"""Catalog entries: caller search (R07, G04, A04) over lineitem call edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as C
from ..sources import tables as T
from .catalog import register
from .util import round_doubles


def caller_questions(spark, sf):
    p = T.read_table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("query_id"),
                    F.concat(F.lit("Who calls p"), F.col("p_partkey").cast("string"), F.lit("?")).alias("text"))


def caller_sql():
    return """
WITH q AS (SELECT p_partkey AS query_id, 'p' || CAST(p_partkey AS VARCHAR) AS symbol FROM part),
e AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS caller_name, 'p' || CAST(l_partkey AS VARCHAR) AS callee_name,
             'o' || CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS line FROM lineitem),
exact AS (SELECT q.query_id, q.symbol, e.* FROM q JOIN e ON e.callee_name = q.symbol),
miss AS (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM exact)),
fuzzy AS (SELECT m.query_id, m.symbol, e.* FROM miss m JOIN e ON contains(lower(e.callee_name), lower(m.symbol))),
hits AS (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy),
g AS (SELECT query_id, symbol, file, caller_name AS caller, count(*) AS calls,
             array_to_string(list_transform(list_sort(list(line)), lambda x: CAST(x AS VARCHAR)), ',') AS lines
      FROM hits GROUP BY query_id, symbol, file, caller_name),
t AS (SELECT *, sum(calls) OVER (PARTITION BY query_id) AS n_calls, count(*) OVER (PARTITION BY query_id) AS n_callers,
             count(DISTINCT file) OVER (PARTITION BY query_id) AS n_files FROM g)
SELECT query_id, symbol, file, caller, calls, lines, CAST(n_calls AS BIGINT) AS n_calls, n_callers,
       CAST(n_files AS INTEGER) AS n_files,
       round(least(0.60, 0.35 + 0.25 * least(n_calls, 10) / 10), 6) AS confidence,
       'callers=' || n_callers || ',calls=' || n_calls || ',files=' || n_files AS reason,
       'callgraph:' || symbol AS summary_file
FROM t"""


@register("r07_caller_search", caller_sql)
def q_r07(spark, sf):
    hits = C.find_callers(caller_questions(spark, sf), T.call_edges_from_lineitem(spark, sf))
    return round_doubles(C.caller_groups(hits).drop("repo"))
