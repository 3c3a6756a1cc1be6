"""Catalog entries: change-feed bursts (I03) and hourly counters (I05),
batch form of the streaming operators (stream == batch is tested)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..session import ensure_checkpoint_dir
from ..sources import tables as T
from ..streaming import bursts as B
from ..streaming import changefeed as S
from ..streaming import knowledge as K
from .catalog import register
from .q_memory import _knowledge_log, knowledge_state_sql
from .util import round_doubles


def change_feed(spark, sf):
    """Change feed contract over events: repo=user_id,
    path=event_type/props, ts."""
    e = T.read_table(spark, sf, "events")
    return e.select(F.col("user_id").alias("repo"), F.concat_ws("/", "event_type", "props").alias("path"), "ts")


def bursts_sql():
    return """
WITH c AS (SELECT user_id AS repo, event_type || '/' || props AS path, ts FROM events),
g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY repo ORDER BY ts) IS NULL
                      OR ts - lag(ts) OVER (PARTITION BY repo ORDER BY ts) >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS brk FROM c),
s AS (SELECT *, sum(brk) OVER (PARTITION BY repo ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)
SELECT repo, min(ts) AS burst_start, max(ts) + INTERVAL 10 MINUTE AS burst_end, count(*) AS events,
       count(DISTINCT path) AS paths
FROM s GROUP BY repo, sid"""


@register("i03_change_bursts", bursts_sql)
def q_i03(spark, sf):
    return S.change_bursts(change_feed(spark, sf), gap="10 minutes")


@register("i05_hourly_counters", lambda: """
WITH log AS (SELECT event_type AS retriever, CAST(trunc(value * 10) AS BIGINT) AS latency_ms,
                    CAST(json_extract_string(props, '$.k') AS INTEGER) * 10 AS tokens, event_id % 3 = 0 AS correct,
                    ts AS timestamp FROM events)
SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, retriever, count(*) AS n,
       CAST(sum(CAST(correct AS BIGINT)) AS BIGINT) AS correct, CAST(sum(tokens) AS BIGINT) AS tokens,
       CAST(sum(latency_ms) AS BIGINT) AS latency_ms
FROM log GROUP BY 1, 2""")
def q_i05(spark, sf):
    return S.hourly_counters(E.benchmark_log(T.read_table(spark, sf, "events")))


@register("g01_flow_trace")
def q_g01(spark, sf):
    """Flow trace from every nation node over the nation/region/supplier/
    customer graph (rows-only in the driver; brute force in pytest)."""
    from ..operators.graph import flow_confidence, flow_trace
    edges = T.flow_edges(spark, sf)
    n = T.read_table(spark, sf, "nation")
    seeds = n.select(F.col("n_nationkey").alias("query_id"),
                     F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.lit(0).alias("seed_ord"))
    tr = flow_trace(seeds, edges)
    return tr.join(tr.groupBy("query_id").agg(flow_confidence(F.count(F.lit(1))).alias("confidence")), "query_id")


PARTS = 3


def _in_parts(log, order, name, run):
    """Let ``log`` come as a stream: in parts by time, rows of some ``order``
    up to forty minutes late, with a run of the stream after each part.
    Returns the folder of the state."""
    spark = log.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    late = F.unix_micros(F.col("ts").cast("timestamp")) + F.col(order) % 5 * 600_000_000
    cuts = log.agg(F.percentile_approx(late, [k / PARTS for k in range(1, PARTS)], 10_000).alias("c")).first().c or []
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        part = log if low is None else log.where(late > low)
        part = part if high is None else part.where(late <= high)
        part.write.mode("append").parquet(f"{base}/events")
        run(spark.readStream.schema(log.schema).parquet(f"{base}/events"), f"{base}/state")
    return f"{base}/state"


@register("i03_streaming_bursts", bursts_sql)
def q_i03_stream(spark, sf):
    """The bursts of the change feed as a stream finds them."""
    e = T.read_table(spark, sf, "events").select("event_id", F.col("user_id").alias("repo"),
                                                 F.concat_ws("/", "event_type", "props").alias("path"), "ts")
    state = _in_parts(e, "event_id", "bursts", lambda feed, path: B.run(feed, path, gap="10 minutes", delay="1 hour"))
    return B.bursts(spark, state, gap="10 minutes")


@register("i06_streaming_knowledge", knowledge_state_sql)
def q_i06(spark, sf):
    """Knowledge after a stream of all events."""
    log = _knowledge_log(spark, sf).withColumn("type", F.lit("user"))
    path = _in_parts(log, "ord", "knowledge", K.run)
    state = K.knowledge(spark, path).drop("type")
    kind = log.schema["ts"].dataType
    return round_doubles(state.withColumns({c: F.col(c).cast(kind) for c in ("created_at", "last_used_at")}))
