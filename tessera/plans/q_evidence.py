"""Catalog entries: ground truth from benchmark passages, E01 evidence
of the full-text retriever, E16 dataset report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import answer_type
from ..operators import evaluate as E
from ..operators.fulltext import fulltext_search
from ..oracle.fulltext import fulltext_sql
from ..oracle.sqltext import CORPUS_DOCUMENTS
from ..oracle.classify_sql import answer_type_sql
from ..sources import tables as T
from .catalog import register
from .util import round_doubles, sql_round

TRUTH_SQL = f"""corpus AS ({CORPUS_DOCUMENTS}),
truth AS (SELECT DISTINCT b.item_id AS query_id, c.repo, c.path FROM benchmark b JOIN corpus c ON contains(c.content, b.text))"""


@register("s22_passage_ground_truth", lambda: f"WITH {TRUTH_SQL} SELECT * FROM truth")
def q_s22(spark, sf):
    return E.passage_ground_truth(T.corpus_from_documents(spark, sf), T.queries_from_benchmark(spark, sf))


def evidence_sql():
    ft = fulltext_sql()
    return sql_round(f"""
WITH {TRUTH_SQL},
res AS ({ft}),
r AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, rank, repo, file) AS rank,
                        file AS path FROM res) WHERE rank <= 5),
exp AS (SELECT query_id, count(*) AS n_expected FROM truth GROUP BY query_id),
hq AS (SELECT r.query_id, count(*) AS n_hit, min(r.rank) AS first_rank FROM r JOIN (SELECT DISTINCT query_id, path FROM truth) t
       ON t.query_id = r.query_id AND t.path = r.path GROUP BY r.query_id),
nr AS (SELECT query_id, count(*) AS n_results FROM r GROUP BY query_id)
SELECT e.query_id, e.n_expected, coalesce(nr.n_results, 0) AS n_results, coalesce(hq.n_hit, 0) AS n_hit,
       coalesce(hq.n_hit, 0) > 0 AS hit,
       CASE WHEN hq.first_rank IS NOT NULL THEN 1.0 / hq.first_rank ELSE 0.0 END AS rr,
       CASE WHEN coalesce(nr.n_results, 0) > 0 THEN coalesce(hq.n_hit, 0) / nr.n_results ELSE 0.0 END AS precision,
       coalesce(hq.n_hit, 0) / e.n_expected AS recall
FROM exp e LEFT JOIN nr ON nr.query_id = e.query_id LEFT JOIN hq ON hq.query_id = e.query_id""",
        ["rr", "precision", "recall"])


@register("e01_fulltext_evidence", evidence_sql)
def q_e01(spark, sf):
    corpus = T.corpus_from_documents(spark, sf)
    qs = T.queries_from_benchmark(spark, sf)
    truth = E.passage_ground_truth(corpus, qs)
    res = fulltext_search(corpus, qs, index=T.documents_index(spark, sf))
    return round_doubles(E.retrieval_evidence(res, truth))


def report_sql():
    typ, _ = answer_type_sql("text")
    return f"""
WITH {TRUTH_SQL},
q AS (SELECT item_id AS query_id, {typ} AS category FROM benchmark),
j AS (SELECT q.query_id, q.category, t.path FROM q LEFT JOIN truth t ON t.query_id = q.query_id)
SELECT category, count(DISTINCT query_id) AS cases,
       count(DISTINCT CASE WHEN path IS NOT NULL THEN query_id END) AS with_expected,
       count(DISTINCT path) AS distinct_files
FROM j GROUP BY ROLLUP (category)"""


@register("e16_dataset_report", report_sql)
def q_e16(spark, sf):
    corpus = T.corpus_from_documents(spark, sf)
    qs = T.queries_from_benchmark(spark, sf)
    typ, _ = answer_type(F.col("text"))
    cats = qs.select("query_id", typ.alias("category"))
    return E.dataset_report(E.passage_ground_truth(corpus, qs), cats, "category")
