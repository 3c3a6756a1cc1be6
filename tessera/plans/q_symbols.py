"""Catalog entries: symbol search (R01–R04) and symbol aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import symbol as S
from ..oracle.sqltext import fields, lit_list, stem, trim_word
from ..sources import tables as T
from .catalog import register
from .util import round_doubles, sql_round


def symbol_questions(spark, sf):
    """Question batch for symbol search: one per distinct part name,
    phrased 'where is <Name Words>' (capitalised), id = min partkey."""
    p = T.read_table(spark, sf, "part")
    g = p.groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
    return g.select("query_id", F.concat(F.lit("where is "), F.initcap("p_name")).alias("text"))


SYM_SQL = """sym AS (SELECT DISTINCT substr(sha256(p_name || '|' || p_type || '|' || p_brand || '|' || CAST(p_size AS VARCHAR)), 1, 16) AS id,
       p_name AS name, p_type AS kind, p_brand AS file, p_size AS start_line, p_size + 10 AS end_line,
       p_type || ' ' || p_name AS signature FROM part),
qs AS (SELECT min(p_partkey) AS query_id, 'where is ' || (SELECT string_agg(upper(left(w, 1)) || lower(substr(w, 2)), ' ')
        FROM (SELECT unnest(string_split(p_name, ' ')) AS w)) AS text FROM part GROUP BY p_name)"""


def _camel(x):
    return f"list_filter(regexp_extract_all({x}, '[A-Z]?[^A-Z]*'), lambda cp: cp <> '')"


def _base(c, n):
    ratio = (f"(len(list_filter({_camel(c)}, lambda qp: list_contains(list_transform({_camel(n)}, lambda np: lower(np)), lower(qp))))"
             f" / len({_camel(c)}))")
    return (f"(CASE WHEN lower({n}) = lower({c}) THEN 1.0 WHEN contains(lower({n}), lower({c})) THEN 0.8 + 0.2 * {ratio} "
            f"ELSE 0.7 * {ratio} END)")


def _adjust(b, q, n):
    words = fields(f"lower({q})")
    ratio = f"(len(list_filter({words}, lambda aw: contains(lower({n}), aw))) / len({words}))"
    return (f"(CASE WHEN lower({n}) = lower({q}) THEN 1.0 "
            f"WHEN contains(lower({n}), lower({q})) OR contains(lower({q}), lower({n})) THEN 0.9 + 0.1 * {b} "
            f"WHEN len({words}) > 0 AND {ratio} > 0.5 THEN 0.7 + 0.3 * {ratio} ELSE {b} END)")


def _cands_sql():
    words = f"list_transform({fields('text')}, lambda w: {trim_word('w')})"
    kept = f"list_filter({words}, lambda w: strlen(w) >= 2 AND NOT list_contains({lit_list(S.SYMBOL_STOP_WORDS)}, lower(w)))"
    pairs = f"flatten(list_transform({kept}, lambda w: [w, {stem('w')}]))"
    upper = f"list_filter({words}, lambda w: strlen(w) >= 2 AND regexp_matches(w, '^[A-Z]'))"
    return f"list_filter(list_concat({pairs}, {upper}), lambda w: strlen(w) >= 2)"


def symbol_search_sql():
    match = """(lower(s.name) = lower(c.candidate) OR starts_with(lower(s.name), lower(c.candidate))
               OR contains(lower(s.signature), lower(c.candidate)))"""
    tier = """(CASE WHEN lower(s.name) = lower(c.candidate) THEN 0 WHEN starts_with(lower(s.name), lower(c.candidate)) THEN 1 ELSE 2 END)"""
    return f"""
WITH {SYM_SQL},
c0 AS (SELECT query_id, unnest({_cands_sql()}) AS candidate, generate_subscripts({_cands_sql()}, 1) - 1 AS cand_pos FROM qs),
cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(candidate) ORDER BY cand_pos) AS rn FROM c0) WHERE rn = 1),
m0 AS (SELECT c.query_id, c.cand_pos, c.candidate, s.*,
              row_number() OVER (PARTITION BY c.query_id, c.cand_pos ORDER BY {tier}, s.start_line, s.file, s.name, s.id) AS w01
       FROM cands c JOIN sym s ON {match}),
m1 AS (SELECT m0.*, q.text FROM m0 JOIN qs q USING (query_id) WHERE w01 <= 20),
m2 AS (SELECT *, {_adjust(_base('candidate', 'name'), 'text', 'name')} AS score FROM m1),
m3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, name, file, start_line ORDER BY cand_pos, w01) AS dup FROM m2)
       WHERE dup = 1),
miss AS (SELECT q.query_id, 0 AS cand_pos, q.text AS candidate, q.text FROM qs q WHERE q.query_id NOT IN (SELECT query_id FROM m3)),
f0 AS (SELECT c.query_id, c.cand_pos, c.candidate, c.text, s.*,
              row_number() OVER (PARTITION BY c.query_id, c.cand_pos ORDER BY {tier}, s.start_line, s.file, s.name, s.id) AS w01
       FROM miss c JOIN sym s ON {match}),
f1 AS (SELECT *, {_base('candidate', 'name')} AS score FROM f0 WHERE w01 <= 10),
allm AS (SELECT query_id, id, name, kind, file, start_line, end_line, signature, score, cand_pos, w01 FROM m3
         UNION ALL SELECT query_id, id, name, kind, file, start_line, end_line, signature, score, cand_pos, w01 FROM f1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, cand_pos, w01) AS rank
                       FROM allm) WHERE rank <= 10)
SELECT query_id, CAST(rank AS INTEGER) AS rank, file, name, kind, start_line, end_line, round(score, 6) AS score,
       '[' || kind || '] ' || name || ' (' || file || ':' || CAST(start_line AS VARCHAR) || ')' || chr(10) || signature AS snippet,
       CAST(strlen('[' || kind || '] ' || name || ' (' || file || ':' || CAST(start_line AS VARCHAR) || ')' || chr(10) || signature) // 4 AS BIGINT) AS tokens,
       'symbol' AS retriever
FROM top"""


@register("r01_symbol_search", symbol_search_sql)
def q_r01(spark, sf):
    res = S.symbol_search(symbol_questions(spark, sf), T.symbols_from_part(spark, sf)).drop("repo")
    return round_doubles(res)
