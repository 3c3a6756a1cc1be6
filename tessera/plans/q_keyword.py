"""Catalog entries: keyword scan (R09) and its confidence."""

from __future__ import annotations

from ..operators import keyword as K
from ..oracle.sqltext import CORPUS_DOCUMENTS, keywords as kw_sql
from ..sources import tables as T
from .catalog import register
from .util import round_doubles, sql_round


def _base_sql():
    return f"""
corpus AS ({CORPUS_DOCUMENTS}),
qs AS (SELECT item_id AS query_id, text FROM benchmark),
k0 AS (SELECT query_id, text, list_filter({kw_sql('text')}, lambda e: e <> '') AS kl FROM qs),
k1 AS (SELECT query_id, text, list_filter(kl, lambda x, i: list_position(kl, x) = i) AS kws FROM k0),
k2 AS (SELECT query_id, CASE WHEN len(kws) > 0 THEN kws ELSE [text] END AS kws FROM k1),
kw AS (SELECT query_id, len(kws) AS n_kw, generate_subscripts(kws, 1) - 1 AS kw_idx, lower(unnest(kws)) AS kw FROM k2),
lines AS (SELECT repo, path, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no,
                 lower(unnest(string_split(content, chr(10)))) AS lline FROM corpus),
hits AS (SELECT k.query_id, l.repo, l.path, l.line_no, k.kw_idx FROM lines l JOIN kw k ON contains(l.lline, k.kw)),
pf AS (SELECT query_id, repo, path, count(DISTINCT line_no) AS m, count(DISTINCT kw_idx) AS matched,
              count(*) AS grep_lines, min(line_no) AS first_line FROM hits GROUP BY query_id, repo, path)"""


def keyword_sql():
    return sql_round(f"""
WITH {_base_sql()},
qi AS (SELECT query_id, min(n_kw) AS n_kw, max(CASE WHEN kw_idx = 0 THEN kw END) AS kw0 FROM kw GROUP BY query_id),
f0 AS (SELECT pf.*, qi.n_kw, qi.kw0, len(string_split(c.content, chr(10))) AS n_lines,
              string_split(c.content, chr(10)) AS lines, c.path AS p
       FROM pf JOIN qi USING (query_id) JOIN corpus c ON c.repo = pf.repo AND c.path = pf.path),
f1 AS (SELECT *, CAST(CASE WHEN p IN ('README.md', 'README.txt', 'README', 'Readme.md', 'readme.md') THEN 3.0
                      WHEN string_split(p, '/')[1] IN ('docs', 'doc', 'documentation') AND contains(p, '/') THEN 2.0
                      ELSE 1.0 END AS DOUBLE) AS weight,
              m / greatest(n_lines, 1) AS density, matched / greatest(n_kw, 1) AS unique_ratio,
              CAST(CASE WHEN first_line / n_lines <= 0.2 THEN 1.0 WHEN first_line / n_lines <= 0.5 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS recency
       FROM f0),
f2 AS (SELECT *, m * weight * (1.0 + density * 2.0 + unique_ratio * 2.0 + recency)
                 + (grep_lines - CASE WHEN weight = 1.0 THEN 1 ELSE 0 END)
                 + CASE WHEN len(string_split(path, '/')) <= 3 AND contains(lower(string_split(path, '/')[-1]), kw0)
                        THEN 1.5 ELSE 0.0 END AS raw_score FROM f1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repo ORDER BY round(raw_score, 9) DESC, path) AS rank
                       FROM f2) WHERE rank <= 5),
t2 AS (SELECT t.*, t.raw_score / greatest(max(t.raw_score) OVER (PARTITION BY t.query_id, t.repo), 1.0) AS score,
              k.kws FROM top t JOIN (SELECT query_id, list(kw ORDER BY kw_idx) AS kws FROM kw GROUP BY query_id) k USING (query_id)),
t3 AS (SELECT *, list_transform(lines, lambda l: len(list_filter(kws, lambda w: contains(lower(l), w))) > 0) AS flags FROM t2),
t4 AS (SELECT *, list_filter(range(0, len(lines)),
                     lambda i: len(list_filter(range(greatest(0, i - 3), least(len(lines) - 1, i + 3) + 1),
                                               lambda j: flags[j + 1])) > 0) AS keep FROM t3),
t5 AS (SELECT *, array_to_string(flatten(list_transform(keep, lambda i, k:
             list_concat(CASE WHEN k = 1 OR keep[k - 1] <> i - 1 THEN ['...'] ELSE []::VARCHAR[] END,
                         [(CASE WHEN flags[i + 1] THEN '>' ELSE ' ' END) || CAST(i + 1 AS VARCHAR) || ': ' || lines[i + 1]]))),
             chr(10)) AS snippet FROM t4)
SELECT query_id, repo, CAST(rank AS INTEGER) AS rank, path AS file, score, m AS match_hits,
       CAST(strlen(snippet) // 4 AS BIGINT) AS tokens, density, unique_ratio, recency, weight,
       'matches=' || m || ',weight=' || printf('%.1f', weight) AS reason, snippet, 'grep' AS retriever
FROM t5""", ["score", "density", "unique_ratio", "recency", "weight"])


@register("r09_keyword_scan", keyword_sql)
def q_r09(spark, sf):
    return round_doubles(K.keyword_scan(T.corpus_from_documents(spark, sf), T.queries_from_benchmark(spark, sf)))


def confidence_sql():
    return sql_round(f"""
WITH {_base_sql()},
res AS ({keyword_sql()}),
n AS (SELECT query_id, repo, count(*) AS n_results FROM res GROUP BY query_id, repo),
seen AS (SELECT r.query_id, r.repo, count(DISTINCT k.kw_idx) AS seen FROM res r JOIN kw k
         ON k.query_id = r.query_id AND contains(lower(r.snippet), k.kw) GROUP BY r.query_id, r.repo),
tot AS (SELECT query_id, repo, sum(m) AS total_matches FROM pf GROUP BY query_id, repo),
nkw AS (SELECT query_id, min(n_kw) AS n_kw FROM kw GROUP BY query_id)
SELECT n.query_id, n.repo, n.n_results, CAST(tot.total_matches AS BIGINT) AS total_matches,
       least(0.8 * coalesce(seen.seen, 0) / nkw.n_kw
             + 0.2 * least(tot.total_matches, 500) / (least(tot.total_matches, 500) + n.n_results), 0.92) AS confidence
FROM n JOIN tot ON tot.query_id = n.query_id AND tot.repo = n.repo JOIN nkw ON nkw.query_id = n.query_id
LEFT JOIN seen ON seen.query_id = n.query_id AND seen.repo = n.repo""", ["confidence"])


@register("r10_keyword_confidence", confidence_sql)
def q_r10(spark, sf):
    corpus = T.corpus_from_documents(spark, sf)
    qs = T.queries_from_benchmark(spark, sf)
    return round_doubles(K.keyword_confidence(K.keyword_scan(corpus, qs), corpus, qs))
