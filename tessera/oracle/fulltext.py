"""DuckDB oracle for R11–R15 over the documents corpus and benchmark queries."""

from __future__ import annotations

from .sqltext import (CORPUS_DOCUMENTS, NON_ALNUM, fields, fulltext_words, q, query_words,
                      stem, strip_ws, tokenize, trim_word)

K1, B = 1.2, 0.75


def _idf(n, N):
    v = f"ln(({N} - {n} + 0.5) / ({n} + 0.5))"
    return f"(CASE WHEN {v} <= 0 THEN 1e-6 ELSE {v} END)"


def _bm(tf, dl, avgdl):
    return f"({tf} * {K1 + 1} / ({tf} + {K1} * (1 - {B} + {B} * {dl} / {avgdl})))"


def indexed_docs_sql() -> str:
    """CTEs up to docs(repo, path, tokens): header and content of each file."""
    line_fields = fields(strip_ws("line"))
    tw = trim_word("w", "#")
    return f"""lines_k AS (
  SELECT repo, path, unnest(string_split(content, chr(10))) AS line,
         generate_subscripts(string_split(content, chr(10)), 1) AS ln
  FROM corpus),
tag_words AS (
  SELECT repo, path, ln, unnest({line_fields}) AS w, generate_subscripts({line_fields}, 1) AS wn
  FROM lines_k WHERE {strip_ws('line')} <> '' AND NOT starts_with({strip_ws('line')}, '//')),
tags AS (
  SELECT repo, path, lower({tw}) AS tag, min(ln * 10000000 + wn) AS ord
  FROM tag_words WHERE strlen({tw}) >= 3 AND length(lower({tw})) >= 2
  GROUP BY repo, path, lower({tw})),
hdr AS (
  SELECT repo, path, '__SUMMARY__:' || string_agg(' ' || tag, '' ORDER BY ord) || ' __END__' || chr(10) AS header
  FROM tags GROUP BY repo, path),
docs AS (
  SELECT c.repo, c.path,
         {tokenize("coalesce(h.header, '__SUMMARY__: __END__' || chr(10)) || c.content")} AS tokens
  FROM corpus c LEFT JOIN hdr h ON h.repo = c.repo AND h.path = c.path)"""


def index_sql() -> str:
    """What the stored index holds, by repository."""
    return f"""
WITH corpus AS ({CORPUS_DOCUMENTS}),
{indexed_docs_sql()},
t AS (SELECT repo, path, unnest(tokens) AS term FROM docs),
w AS (SELECT repo, count(DISTINCT term) AS n_terms, count(DISTINCT (path, term)) AS n_postings, count(*) AS n_positions FROM t GROUP BY repo)
SELECT d.repo, count(*) AS n_files, CAST(sum(len(tokens)) AS BIGINT) AS total_length, any_value(n_terms) AS n_terms,
       any_value(n_postings) AS n_postings, any_value(n_positions) AS n_positions
FROM docs d JOIN w USING (repo) GROUP BY d.repo"""


def fulltext_sql(first_cut: int = 50, top_k: int = 5) -> str:
    return f"""
WITH corpus AS ({CORPUS_DOCUMENTS}),
qs AS (SELECT item_id AS query_id, text FROM benchmark),
{indexed_docs_sql()},
stats AS (SELECT repo, count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM docs GROUP BY repo),
qwl AS (SELECT query_id, {fulltext_words('text')} AS words FROM qs),
qtl AS (
  SELECT query_id, len(words) AS n_words,
         list_transform(list_filter(flatten(list_transform(words, lambda w: regexp_split_to_array(w, {q(NON_ALNUM)}))),
                                    lambda t: t <> ''), lambda t: {stem('t')}) AS terms
  FROM qwl),
qterms AS (
  SELECT query_id, n_words, len(terms) AS n_terms, unnest(terms) AS term,
         generate_subscripts(terms, 1) - 1 AS term_pos
  FROM qtl WHERE len(terms) > 0),
toks0 AS (
  SELECT repo, path, len(tokens) AS dl, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos
  FROM docs),
toks AS (SELECT * FROM toks0 WHERE term IN (SELECT term FROM qterms)),
tf AS (SELECT repo, path, dl, term, count(*) AS tf FROM toks GROUP BY repo, path, dl, term),
dfs AS (SELECT repo, term, count(*) AS df FROM tf GROUP BY repo, term),
term_part AS (
  SELECT qt.query_id, t.repo, t.path,
         {_idf('d.df', 's.n_docs')} * {_bm('t.tf', 't.dl', 's.avgdl')} AS part
  FROM qterms qt JOIN tf t ON t.term = qt.term
  JOIN dfs d ON d.repo = t.repo AND d.term = t.term JOIN stats s ON s.repo = t.repo),
starts AS (
  SELECT qt.query_id, t.repo, t.path, t.dl, t.pos - qt.term_pos AS start, count(*) AS k, min(qt.n_terms) AS n_terms
  FROM toks t JOIN qterms qt ON qt.term = t.term WHERE qt.n_words >= 2
  GROUP BY qt.query_id, t.repo, t.path, t.dl, t.pos - qt.term_pos),
hits AS (
  SELECT query_id, repo, path, dl, count(*) AS ptf FROM starts WHERE k = n_terms
  GROUP BY query_id, repo, path, dl),
pdf AS (SELECT query_id, repo, count(*) AS pdf FROM hits GROUP BY query_id, repo),
phrase_part AS (
  SELECT h.query_id, h.repo, h.path, {_idf('p.pdf', 's.n_docs')} * {_bm('h.ptf', 'h.dl', 's.avgdl')} AS part
  FROM hits h JOIN pdf p ON p.query_id = h.query_id AND p.repo = h.repo JOIN stats s ON s.repo = h.repo),
scores AS (
  SELECT query_id, repo, path, sum(part) AS bm25
  FROM (SELECT * FROM term_part UNION ALL SELECT * FROM phrase_part)
  GROUP BY query_id, repo, path),
cand AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repo ORDER BY round(bm25, 9) DESC, path) AS r1 FROM scores)
  WHERE r1 <= {first_cut}),
qw AS (SELECT query_id, {query_words('text')} AS qwords FROM qs),
rows0 AS (
  SELECT c.query_id, c.repo, c.path, c.bm25, qw.qwords, b.content, string_split(b.content, chr(10)) AS lines
  FROM cand c JOIN qw ON qw.query_id = c.query_id JOIN corpus b ON b.repo = c.repo AND b.path = c.path),
rows1 AS (
  SELECT *, list_transform(lines, lambda l: len(list_filter(qwords, lambda w: contains(lower(l), w))) > 0) AS flags
  FROM rows0),
rows2 AS (
  SELECT *, len(list_filter(flags, lambda x: x)) AS match_hits,
         list_filter(range(0, len(lines)),
                     lambda i: len(list_filter(range(greatest(0, i - 4), least(len(lines) - 1, i + 4) + 1),
                                               lambda j: flags[j + 1])) > 0) AS keep
  FROM rows1),
rows3 AS (
  SELECT *, array_to_string(flatten(list_transform(keep, lambda i, k:
             list_concat(CASE WHEN k = 1 OR keep[k - 1] <> i - 1 THEN ['...'] ELSE []::VARCHAR[] END,
                         [(CASE WHEN flags[i + 1] THEN '>' ELSE ' ' END) || CAST(i + 1 AS VARCHAR) || ': ' || lines[i + 1]])
             ))[1:10], chr(10)) AS snippet
  FROM rows2),
rows4 AS (
  SELECT *, lower(string_split(path, '/')[-1]) AS base, lower(path) AS rel FROM rows3),
rows5 AS (
  SELECT query_id, repo, path AS file, snippet, match_hits, bm25,
    (CASE WHEN len(list_filter(qwords, lambda w: contains(base, w))) > 0 THEN 1.5 ELSE 1.0 END)
    * (CASE WHEN starts_with(rel, 'readme') OR path = 'README.md' OR path = 'README' THEN 2.0 ELSE 1.0 END)
    * (CASE WHEN contains(rel, 'doc') THEN 1.5 ELSE 1.0 END)
    * (CASE WHEN contains(content, 'func ') OR contains(content, 'def ') THEN 1.3 ELSE 1.0 END)
    * (CASE WHEN contains(content, 'class ') OR contains(content, 'interface ') THEN 1.3 ELSE 1.0 END)
    * (CASE WHEN contains(content, '// ') OR contains(content, '# ') OR contains(content, '/* ')
             OR contains(content, '///') THEN 1.2 ELSE 1.0 END) AS boost,
    concat_ws(',',
      CASE WHEN len(list_filter(qwords, lambda w: contains(base, w))) > 0 THEN 'filename_match' END,
      CASE WHEN starts_with(rel, 'readme') OR path = 'README.md' OR path = 'README' THEN 'readme' END,
      CASE WHEN contains(rel, 'doc') THEN 'docs' END,
      CASE WHEN contains(content, 'func ') OR contains(content, 'def ') THEN 'has_functions' END,
      CASE WHEN contains(content, 'class ') OR contains(content, 'interface ') THEN 'has_classes' END,
      CASE WHEN contains(content, '// ') OR contains(content, '# ') OR contains(content, '/* ')
             OR contains(content, '///') THEN 'has_comments' END) AS reasons
  FROM rows4),
rows6 AS (
  SELECT *, least(1.0 / (1.0 + bm25 / 2.0) * (0.12 + (CASE WHEN length(snippet) > 0 THEN 0.15 ELSE 0 END)
                 + (CASE WHEN match_hits > 3 THEN 0.05 ELSE 0 END) + (CASE WHEN match_hits > 10 THEN 0.05 ELSE 0 END)),
               0.40) AS conf
  FROM rows5),
ranked AS (
  SELECT query_id, repo, file, snippet, match_hits, bm25, least(conf * boost, 1.0) AS score,
         CAST(strlen(snippet) // 4 AS BIGINT) AS tokens,
         CASE WHEN reasons = '' THEN 'base' ELSE reasons END AS reason
  FROM rows6)
SELECT query_id, repo, CAST(rank AS INTEGER) AS rank, file, snippet, round(score, 6) AS score, tokens,
       CAST(match_hits AS INTEGER) AS match_hits, reason, round(bm25, 6) AS bm25, 'fts' AS retriever
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repo ORDER BY round(score, 9) DESC, round(bm25, 9) DESC, file) AS rank FROM ranked)
WHERE rank <= {top_k}
"""
