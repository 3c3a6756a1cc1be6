"""Catalog entries: evaluation family (E03–E13) over the benchmark log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..sources import tables as T
from .catalog import register
from .util import round_doubles, sql_round

CATS = "[" + ", ".join(f"'{c}'" for c in E.CATEGORIES) + "]"
LOG_SQL = f"""log AS (
  SELECT event_id AS id, event_type AS retriever, 'repo' || CAST(user_id % 5 AS VARCHAR) AS repository,
         {CATS}[CAST(user_id % 7 + 1 AS INTEGER)] AS category,
         CAST(trunc(value * 10) AS BIGINT) AS latency_ms,
         CAST(json_extract_string(props, '$.k') AS INTEGER) * 10 AS tokens,
         event_id % 3 = 0 AS correct,
         CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 AS covered,
         least(1.0, value / 50.0) AS confidence, ts AS timestamp
  FROM events)"""
ROWS_SQL = """rows AS (
  SELECT *, 100 * (0.40 * accuracy + 0.25 * coverage + 0.20 * accuracy * 100 / avg_tokens
                   + 0.10 * least(1.0, accuracy / (avg_latency_ms / 1000.0) / 100) + 0.05 * pass_rate) AS score
  FROM (SELECT repository, retriever, avg(CAST(correct AS DOUBLE)) AS accuracy,
               avg(CAST(covered AS DOUBLE)) AS coverage, avg(tokens) AS avg_tokens,
               avg(latency_ms) AS avg_latency_ms, avg(CASE WHEN tokens IS NOT NULL THEN 1.0 ELSE 0.0 END) AS pass_rate,
               count(*) AS n
        FROM log GROUP BY repository, retriever))"""


def _log(spark, sf):
    return E.benchmark_log(T.read_table(spark, sf, "events"))


@register("e03_research_score", lambda: sql_round(
    f"WITH {LOG_SQL}, {ROWS_SQL} SELECT * FROM rows",
    ["accuracy", "coverage", "avg_tokens", "avg_latency_ms", "pass_rate", "score"]))
def q_e03(spark, sf):
    return round_doubles(E.per_repo_retriever(_log(spark, sf)))


@register("e04_global_leaderboard", lambda: sql_round(f"""
WITH {LOG_SQL}, {ROWS_SQL},
g AS (SELECT retriever, avg(score) AS score, avg(accuracy) AS accuracy, avg(avg_tokens) AS avg_tokens,
             avg(avg_latency_ms) AS avg_latency_ms, avg(coverage) AS coverage, stddev_pop(accuracy) AS accuracy_std
      FROM rows GROUP BY retriever)
SELECT *, CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS rank FROM g""",
    ["score", "accuracy", "avg_tokens", "avg_latency_ms", "coverage", "accuracy_std"]))
def q_e04(spark, sf):
    return round_doubles(E.global_leaderboard(E.per_repo_retriever(_log(spark, sf))))


@register("e06_efficiency", lambda: sql_round(f"""
WITH {LOG_SQL}, {ROWS_SQL}
SELECT retriever, avg(accuracy * 100 / (avg_tokens / 100)) AS acc_per_100_tokens,
       avg(accuracy / (avg_tokens * 5.0 / 1e6)) AS correct_per_dollar,
       avg(accuracy / (avg_latency_ms / 1000.0)) AS correct_per_second
FROM rows GROUP BY retriever""", ["acc_per_100_tokens", "correct_per_dollar", "correct_per_second"]))
def q_e06(spark, sf):
    return round_doubles(E.efficiency(E.per_repo_retriever(_log(spark, sf))))


@register("e07_repository_breakdown", lambda: sql_round(f"""
WITH {LOG_SQL}, {ROWS_SQL}
SELECT repository, arg_max(retriever, (score, retriever)) AS best_retriever,
       arg_min(retriever, (score, retriever)) AS worst_retriever,
       max(accuracy) AS best_accuracy, min(avg_tokens) AS min_tokens, min(avg_latency_ms) AS min_latency_ms
FROM rows GROUP BY repository""", ["best_accuracy", "min_tokens", "min_latency_ms"]))
def q_e07(spark, sf):
    return round_doubles(E.repository_breakdown(E.per_repo_retriever(_log(spark, sf))))


@register("e08_category_leaderboard", lambda: sql_round(f"""
WITH {LOG_SQL}
SELECT category, retriever, avg(CAST(correct AS DOUBLE)) AS accuracy, count(*) AS n
FROM log GROUP BY CUBE (category, retriever)""", ["accuracy"]))
def q_e08(spark, sf):
    return round_doubles(E.category_leaderboard(_log(spark, sf)))


@register("e09_router_audit", lambda: sql_round(f"""
WITH {LOG_SQL},
cell AS (SELECT category, repository, retriever, avg(CAST(correct AS DOUBLE)) AS acc FROM log
         GROUP BY category, repository, retriever),
o AS (SELECT avg(best) AS oracle_accuracy FROM (SELECT max(acc) AS best FROM cell GROUP BY category, repository)),
s AS (SELECT max(acc) AS best_static_accuracy FROM (SELECT avg(CAST(correct AS DOUBLE)) AS acc FROM log GROUP BY retriever))
SELECT oracle_accuracy, best_static_accuracy, oracle_accuracy - best_static_accuracy AS oracle_gap FROM o, s""",
    ["oracle_accuracy", "best_static_accuracy", "oracle_gap"]))
def q_e09(spark, sf):
    return round_doubles(E.router_audit(_log(spark, sf)))


@register("e10_failure_analysis", lambda: sql_round(f"""
WITH {LOG_SQL},
g AS (SELECT CASE WHEN correct THEN 'ok' WHEN tokens = 0 THEN 'no_result' WHEN latency_ms >= 400 THEN 'slow'
                  WHEN NOT covered THEN 'wrong_routing' ELSE 'wrong_file' END AS reason, count(*) AS n
      FROM log GROUP BY 1)
SELECT reason, n, n / sum(n) OVER () AS share FROM g""", ["share"]))
def q_e10(spark, sf):
    return round_doubles(E.failure_analysis(_log(spark, sf)))


@register("e11_calibration_utility", lambda: sql_round(f"""
WITH {LOG_SQL},
g AS (SELECT retriever, avg(CAST(correct AS DOUBLE)) AS accuracy, avg(confidence) AS avg_confidence,
             avg(tokens) AS avg_tokens, avg(latency_ms) AS avg_latency_ms FROM log GROUP BY retriever)
SELECT *, abs(avg_confidence - accuracy) AS calibration_error,
       0.5 * accuracy + 0.2 * (1 - avg_tokens / 3000) + 0.15 * (1 - avg_latency_ms / 1000)
       + 0.15 * (1 - abs(avg_confidence - accuracy)) AS utility
FROM g""", ["accuracy", "avg_confidence", "avg_tokens", "avg_latency_ms", "calibration_error", "utility"]))
def q_e11(spark, sf):
    return round_doubles(E.calibration(_log(spark, sf)))


@register("e11_winner_pick", lambda: sql_round(f"""
WITH {LOG_SQL},
q AS (SELECT *, repository || ':' || strftime(timestamp, '%Y%m%d%H%M') AS query,
             0.5 * CAST(correct AS DOUBLE) + 0.2 * (1 - least(1.0, tokens / 3000.0)) + 0.15 * confidence
             + 0.1 * (1 - least(1.0, latency_ms / 1000.0)) + 0.05 * CAST(covered AS DOUBLE) AS util
      FROM log WHERE correct)
SELECT query, retriever AS winner, util FROM
  (SELECT *, row_number() OVER (PARTITION BY query ORDER BY util DESC, id) AS rn FROM q) WHERE rn = 1""",
    ["util"]))
def q_e11w(spark, sf):
    return round_doubles(E.winner_pick(_log(spark, sf)))


def _improvements(spark, sf):
    e = T.read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return e.select(
        F.col("user_id").alias("grp"), F.col("event_id").alias("ord"),
        F.when(F.col("value") >= 30, "High").when(F.col("value") >= 15, "Medium").otherwise("Low").alias("impact"),
        F.when(k >= 66, "High").when(k >= 33, "Medium").otherwise("Low").alias("effort"),
        F.least(F.lit(1.0), F.col("value") / 50.0).alias("confidence"))


@register("e12_improvement_ranking", lambda: sql_round("""
WITH items AS (
  SELECT user_id AS grp, event_id AS ord,
         CASE WHEN value >= 30 THEN 'High' WHEN value >= 15 THEN 'Medium' ELSE 'Low' END AS impact,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 66 THEN 'High'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 33 THEN 'Medium' ELSE 'Low' END AS effort,
         least(1.0, value / 50.0) AS confidence FROM events),
p AS (SELECT *, (2 * (CASE impact WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END)
                 + 1.5 * (2 - (CASE effort WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END))) * confidence AS priority
      FROM items)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY priority DESC, ord) AS INTEGER) AS rank FROM p)
WHERE rank <= 5""", ["confidence", "priority"]))
def q_e12(spark, sf):
    return round_doubles(E.improvement_ranking(_improvements(spark, sf)))
