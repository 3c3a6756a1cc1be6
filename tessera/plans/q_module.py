"""Catalog entries: module summaries (X14, S16, S17) and module search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import topic_rules as TR
from ..operators.module import module_search, module_summaries, stored_summaries, update_summaries
from ..oracle.sqltext import CORPUS_DOCUMENTS, fields, q
from ..session import ensure_checkpoint_dir
from ..sources import tables as T
from .catalog import register
from .q_classify import OWN_QUESTIONS
from .util import round_doubles, sql_round

CUT = ".,!?;:'\\\"()[]{}/\\\\"


def module_questions(spark, sf):
    b = T.read_table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"),
                                                    "text")
    own = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(OWN_QUESTIONS)], "query_id string, text string")
    return b.unionByName(own)


def _values(rows, cols):
    body = ", ".join("(" + ", ".join(q(str(x)) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(cols)})"


def _module_parts():
    """SQL up to the topics of each module, and the search behind it."""
    tmap = [(k, t.lower()) for k, v in TR.TOPIC_MAP.items() for t in v]
    trig = [(k, t.lower()) for keys, ts in TR.TOPIC_TRIGGERS for k in keys for t in ts]
    expn = [(k.lower(), t.lower()) for k, v in TR.TOPIC_EXPANSION.items() for t in v]
    hints = [(k, t.lower()) for k, v in TR.QUERY_TOPIC_HINTS.items() for t in v]
    syn = list(TR.FILENAME_SYNONYMS.items())
    own = ", ".join(f"('q{i}', {q(t)})" for i, t in enumerate(OWN_QUESTIONS))
    stops = "[" + ", ".join(q(s) for s in TR.MODULE_QUERY_STOP_WORDS) + "]"
    cleaned = f"trim(w, {q(chr(46) + ',!?;:' + chr(39) + chr(34) + '()[]{}/' + chr(92))})"
    syn_cond = " OR ".join(f"(w = {q(p)} AND contains(combined, {q(r)})) OR (w = {q(r)} AND contains(combined, {q(p)}))"
                           for r, p in syn)
    rel = "(n = w OR contains(n, w) OR contains(w, n))"
    return f"""
WITH corpus AS ({CORPUS_DOCUMENTS}),
words AS (SELECT repo, path, list_filter(list_transform({fields('content')}, lambda w: {cleaned}), lambda w: strlen(w) >= 2) AS ws,
                 list_filter(list_transform(string_split(content, chr(10)),
                     lambda l: trim(coalesce(({fields('l')})[1], ''), {q(chr(46) + ',!?;:' + chr(39) + chr(34) + '()[]{}/' + chr(92))})),
                     lambda w: strlen(w) >= 2) AS fs FROM corpus),
mods0 AS (SELECT repo, path, list_distinct(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z]'))) AS classes,
                 list_distinct(fs) AS functions FROM words),
pk AS (SELECT repo, path, unnest(list_filter(string_split(path, '/'), lambda p: p <> '' AND p <> '.')) AS part FROM corpus),
pkw AS (SELECT repo, path, regexp_replace(part, '\\.[^.]*$', '') AS b FROM pk),
allw AS (SELECT repo, path, unnest(list_concat(classes, functions)) AS w FROM mods0
         UNION ALL SELECT repo, path, b FROM pkw WHERE b <> ''
         UNION ALL SELECT repo, path, lower(unnest(list_filter(regexp_extract_all(b, '\\p{{Lu}}?[^\\p{{Lu}}]*'), lambda x: x <> ''))) FROM pkw),
base_t AS (SELECT DISTINCT a.repo, a.path, v.t FROM allw a JOIN {_values(tmap, ['k', 't'])} ON lower(a.w) = v.k
           UNION SELECT DISTINCT a.repo, a.path, v.t FROM allw a JOIN {_values(trig, ['k', 't'])} ON contains(lower(a.w), v.k)),
topics AS (SELECT repo, path, t FROM base_t UNION SELECT b.repo, b.path, v.t FROM base_t b JOIN {_values(expn, ['k', 't'])} ON b.t = v.k)""", f""",
mods AS (SELECT m.repo, m.path, m.classes, m.functions, coalesce(tl.topics, []) AS topics,
                lower(regexp_replace(string_split(m.path, '/')[-1], '\\.[^.]*$', '')) || ' ' ||
                coalesce(nullif(lower(regexp_extract(m.path, '^(.*)/[^/]*$', 1)), ''), '.') AS combined,
                list_concat(list_transform(m.classes, lambda c: 'c:' || lower(c)), list_transform(m.functions, lambda c: 'f:' || lower(c))) AS tagged
         FROM mods0 m LEFT JOIN (SELECT repo, path, list(t) AS topics FROM topics GROUP BY repo, path) tl
              ON tl.repo = m.repo AND tl.path = m.path),
qs AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark
       UNION ALL SELECT * FROM (VALUES {own}) AS o(query_id, text)),
qt AS (SELECT qs.query_id, coalesce(list_distinct(list(v.t) FILTER (WHERE v.t IS NOT NULL)), []) AS qtopics
       FROM qs LEFT JOIN {_values(hints, ['k', 't'])} ON contains(lower(qs.text), v.k) GROUP BY qs.query_id),
qq AS (SELECT qs.query_id, qt.qtopics,
              list_filter(regexp_split_to_array(lower(qs.text), '[^a-z0-9]+'), lambda w: w <> '') AS awords
       FROM qs JOIN qt ON qt.query_id = qs.query_id),
qw AS (SELECT *, list_filter(awords, lambda w: NOT list_contains({stops}, w) AND length(w) > 1) AS qwords FROM qq),
pairs AS (SELECT * FROM qw CROSS JOIN mods),
sc AS (SELECT query_id, repo, path,
   CASE WHEN len(qtopics) = 0 THEN 0.0 ELSE len(list_filter(topics, lambda t: list_contains(qtopics, t))) / len(qtopics) END AS topic_score,
   len(list_distinct(list_filter(list_transform(tagged, lambda tg: list_min(list_filter(range(1, len(qwords) + 1),
        lambda i: strlen(qwords[i]) >= 3 AND (substr(tg, 3) = qwords[i] OR contains(substr(tg, 3), qwords[i])
                  OR contains(qwords[i], substr(tg, 3)))))), lambda x: x IS NOT NULL))) AS sym_hits,
   len(qwords) AS nq,
   len(list_filter(awords, lambda w: length(w) > 2 AND contains(combined, w))) AS direct,
   len(list_filter(awords, lambda w: length(w) > 2 AND NOT contains(combined, w) AND ({syn_cond}))) AS synonym,
   len(classes) + len(functions) AS match_hits
 FROM pairs),
sc2 AS (SELECT *, CASE WHEN nq = 0 OR sym_hits = 0 THEN 0.0 ELSE sym_hits / nq END AS symbol_score,
               CAST(CASE WHEN direct = 0 AND synonym = 0 THEN 0.0 ELSE 0.5 * direct + 0.7 * synonym END AS DOUBLE) AS filename_score,
               CAST(0.0 AS DOUBLE) AS import_score, CAST(0.0 AS DOUBLE) AS description_score FROM sc),
sc3 AS (SELECT *, least(1.0, 0.30 * topic_score + 0.20 * symbol_score + 0.30 * filename_score) AS score FROM sc2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, repo, path) AS rank
                       FROM sc3 WHERE score >= 0.05) WHERE rank <= 10)
SELECT query_id, CAST(rank AS INTEGER) AS rank, repo, path AS file, score, topic_score, symbol_score, filename_score,
       import_score, description_score, CAST(match_hits AS INTEGER) AS match_hits,
       CAST(CASE WHEN max(score) OVER (PARTITION BY query_id) <= 0 THEN 0.0 WHEN max(score) OVER (PARTITION BY query_id) < 0.10 THEN 0.2
            WHEN max(score) OVER (PARTITION BY query_id) >= 0.80 THEN 0.95 WHEN max(score) OVER (PARTITION BY query_id) >= 0.50 THEN 0.80
            WHEN max(score) OVER (PARTITION BY query_id) >= 0.30 THEN 0.65 ELSE 0.45 END AS DOUBLE) AS confidence,
       'architecture' AS retriever
FROM top"""


def module_sql():
    return sql_round("".join(_module_parts()), ["score", "topic_score", "symbol_score", "filename_score", "import_score",
                                                "description_score", "confidence"])


def summaries_sql():
    return _module_parts()[0] + """,
tl AS (SELECT repo, path, array_to_string(list_sort(list(t)), '|') AS topics FROM topics GROUP BY repo, path)
SELECT m.repo, m.path AS file_path, array_to_string(list_sort(m.classes), '|') AS classes,
       array_to_string(list_sort(m.functions), '|') AS functions, coalesce(tl.topics, '') AS topics, sha256(c.content) AS content_hash
FROM mods0 m JOIN corpus c ON c.repo = m.repo AND c.path = m.path LEFT JOIN tl ON tl.repo = m.repo AND tl.path = m.path"""


@register("s16_module_summaries", summaries_sql)
def q_s16(spark, sf):
    """Stored module summaries, brought from an older corpus to the present
    one and read back (S16, S17, S19)."""
    now = T.corpus_from_documents(spark, sf)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/summaries-{uuid.uuid4().hex}"
    kind = F.col("doc_id") % 50
    older = F.when(kind == 1, F.concat(F.lit("Older text "), "content")).otherwise(F.col("content"))
    update_summaries(now.where(kind != 0).select("repo", "path", older.alias("content")), path)
    update_summaries(now, path)
    lists = [F.array_join(F.array_sort(c), "|").alias(c) for c in ("classes", "functions", "topics")]
    return stored_summaries(spark, path).select("repo", "file_path", *lists, "content_hash")


@register("r16_module_search", module_sql)
def q_r16(spark, sf):
    mods = module_summaries(T.corpus_from_documents(spark, sf))
    res = module_search(module_questions(spark, sf), mods)
    return round_doubles(res.drop("snippet"))
