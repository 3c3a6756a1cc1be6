"""Catalog entries: memory (M01/M02/M04/M06/M10) and incremental."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import keywords
from ..operators import incremental as I
from ..operators import memory as M
from ..sources import tables as T
from .catalog import register
from .util import round_doubles, sql_round


def _knowledge_log(spark, sf):
    e = T.read_table(spark, sf, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
                    F.when(F.col("event_type") == "purchase", "store").otherwise("lookup").alias("kind"),
                    "ts", F.col("event_id").alias("ord"), F.col("props").alias("value"),
                    F.col("value").alias("confidence"))


KLOG = """log AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS key,
  CASE WHEN event_type = 'purchase' THEN 'store' ELSE 'lookup' END AS kind, ts, event_id AS ord,
  props AS value, value AS confidence FROM events)"""


def knowledge_state_sql():
    return sql_round(f"""
WITH {KLOG},
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, ord DESC) AS rn
                          FROM log WHERE kind = 'store') WHERE rn = 1),
hits AS (SELECT l.key, count(*) AS hits, max(l.ts) AS last_hit FROM log l JOIN latest s
         ON l.key = s.key AND l.kind = 'lookup' AND (l.ts > s.ts OR (l.ts = s.ts AND l.ord > s.ord)) GROUP BY l.key)
SELECT s.key, s.value, s.confidence, s.ts AS created_at, coalesce(h.last_hit, s.ts) AS last_used_at,
       1 + coalesce(h.hits, 0) AS hit_count
FROM latest s LEFT JOIN hits h ON h.key = s.key""", ["confidence"])


@register("m02_knowledge_state", knowledge_state_sql)
def q_m02(spark, sf):
    return round_doubles(M.knowledge_state(_knowledge_log(spark, sf)))


@register("m04_lru_cache_replay", lambda: sql_round("""
WITH a AS (SELECT user_id AS cache, event_type AS key, ts, event_id AS ord,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT *, lag(i) OVER (PARTITION BY cache, key ORDER BY i) AS p FROM a),
c AS (SELECT b.cache, b.p, (SELECT count(DISTINCT x.key) FROM a x WHERE x.cache = b.cache AND x.i > b.p AND x.i < b.i) AS d
      FROM b),
g AS (SELECT cache, CAST(sum(CASE WHEN p IS NOT NULL AND d < 2 THEN 1 ELSE 0 END) AS BIGINT) AS hits,
             CAST(sum(CASE WHEN p IS NOT NULL AND d < 2 THEN 0 ELSE 1 END) AS BIGINT) AS misses FROM c GROUP BY cache)
SELECT *, CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 0.0 END AS hit_rate FROM g""", ["hit_rate"]))
def q_m04(spark, sf):
    e = T.read_table(spark, sf, "events")
    acc = e.select(F.col("user_id").alias("cache"), F.col("event_type").alias("key"), "ts",
                   F.col("event_id").alias("ord"))
    return round_doubles(M.lru_replay(acc, capacity=2))


@register("m06_discovery_ttl_lookup", lambda: sql_round("""
WITH s AS (SELECT user_id AS key, ts, event_id AS ord, value AS confidence FROM events WHERE event_type = 'view'),
l AS (SELECT user_id AS key, ts, event_id AS ord FROM events WHERE event_type = 'click'),
j AS (SELECT l.key, l.ts, l.ord, s.ts AS sts, s.confidence AS sconf,
             epoch_us(l.ts) // 1000000 - epoch_us(s.ts) // 1000000 AS age
      FROM l ASOF LEFT JOIN s ON l.key = s.key AND l.ts >= s.ts)
SELECT key, ts, ord, CASE WHEN age <= 3600 THEN sts END AS store_ts, CASE WHEN age <= 3600 THEN sconf END AS store_conf,
       CASE WHEN age <= 3600 THEN age END AS age_s, coalesce(age <= 3600, false) AS hit
FROM j""", ["store_conf"]))
def q_m06(spark, sf):
    e = T.read_table(spark, sf, "events")
    s = e.where(F.col("event_type") == "view").select(F.col("user_id").alias("key"), "ts",
                                                      F.col("event_id").alias("ord"), F.col("value").alias("confidence"))
    lk = e.where(F.col("event_type") == "click").select(F.col("user_id").alias("key"), "ts",
                                                        F.col("event_id").alias("ord"))
    return round_doubles(M.asof_discovery(s, lk, ttl_seconds=3600))


def _entity_sql():
    words = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
    first = (f"list_filter(list_transform({words}, lambda w: rtrim(w, '?,.:;!')), "
             f"lambda w: strlen(w) >= 2 AND regexp_matches(w, '^[A-Z].*[A-Z_]'))[1]")
    last = (f"list_filter(list_transform({words}, lambda w: regexp_replace(w, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g')), "
            f"lambda w: strlen(w) >= 2 AND regexp_matches(w, '^[A-Z]'))[-1]")
    return f"coalesce({first}, nullif({last}, ''))"


def _pronoun_sql():
    pat = "'(^|[^A-Za-z0-9_])(it|this)([^A-Za-z0-9_]|$)'"
    one = f"regexp_replace(text, {pat}, '\\1' || last_resolved || '\\3', 'g')"
    return f"regexp_replace({one}, {pat}, '\\1' || last_resolved || '\\3', 'g')"


@register("m10_pronoun_resolution", lambda: f"""
WITH u AS (SELECT conv_id, turn, text, nullif({_entity_sql()}, '') AS entity FROM conversations WHERE role = 'user'),
r AS (SELECT *, last_value(entity IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_resolved FROM u)
SELECT conv_id, turn, entity, last_resolved,
       CASE WHEN last_resolved IS NOT NULL THEN {_pronoun_sql()} ELSE text END AS resolved FROM r""")
def q_m10(spark, sf):
    return M.resolve_pronouns(T.read_table(spark, sf, "conversations"))


# --- incremental indexing over a documents manifest -------------------------
def _manifests(spark, sf):
    d = T.read_table(spark, sf, "documents")
    base = d.select(F.col("lang").alias("repo"),
                    F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
                    "doc_id", "text")
    old = base.where(F.col("doc_id") % 10 != 0).withColumn("file_hash", F.sha2("text", 256))
    new_text = F.when(F.col("doc_id") % 10 == 2, F.concat(F.col("text"), F.lit(" [edited]"))).otherwise(F.col("text"))
    new = base.where(F.col("doc_id") % 10 != 1).withColumn("text", new_text).withColumn("file_hash", F.sha2("text", 256))
    return old, new


MANIFEST_SQL = """base AS (SELECT lang AS repo, source || '/doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS path, doc_id, text
                FROM documents),
old AS (SELECT *, sha256(text) AS file_hash FROM base WHERE doc_id % 10 <> 0),
new AS (SELECT repo, path, doc_id, t AS text, sha256(t) AS file_hash FROM
        (SELECT *, CASE WHEN doc_id % 10 = 2 THEN text || ' [edited]' ELSE text END AS t FROM base WHERE doc_id % 10 <> 1)),
diff AS (SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path, o.file_hash AS old_hash,
                n.file_hash AS new_hash,
                CASE WHEN o.file_hash IS NULL THEN 'added' WHEN n.file_hash IS NULL THEN 'deleted'
                     WHEN o.file_hash <> n.file_hash THEN 'changed' ELSE 'skipped' END AS status
         FROM old o FULL OUTER JOIN new n ON o.repo = n.repo AND o.path = n.path)"""


@register("i01_incremental_counts", lambda: f"""
WITH {MANIFEST_SQL}
SELECT repo, CAST(sum(CASE WHEN status IN ('changed', 'added') THEN 1 ELSE 0 END) AS BIGINT) AS changed,
       CAST(sum(CASE WHEN status = 'added' THEN 1 ELSE 0 END) AS BIGINT) AS added,
       CAST(sum(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
       CAST(sum(CASE WHEN status = 'deleted' THEN 1 ELSE 0 END) AS BIGINT) AS deleted,
       CAST(sum(CASE WHEN status <> 'deleted' THEN 1 ELSE 0 END) AS BIGINT) AS total
FROM diff GROUP BY repo""")
def q_i01(spark, sf):
    old, new = _manifests(spark, sf)
    return I.index_update_counts(I.manifest_diff(old, new))


@register("i02_index_state", lambda: f"""
WITH {MANIFEST_SQL},
g AS (SELECT repo, CAST(sum(CASE WHEN old_hash IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS indexed,
             CAST(sum(CASE WHEN status = 'changed' THEN 1 ELSE 0 END) AS BIGINT) AS changed,
             CAST(sum(CASE WHEN status = 'deleted' THEN 1 ELSE 0 END) AS BIGINT) AS deleted,
             CAST(sum(CASE WHEN new_hash IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS total FROM diff GROUP BY repo)
SELECT *, CASE WHEN indexed = 0 THEN 'unindexed' WHEN changed + deleted > 0 THEN 'stale' ELSE 'ready' END AS state FROM g""")
def q_i02(spark, sf):
    old, new = _manifests(spark, sf)
    return I.index_state(I.manifest_diff(old, new))


def _keyword_rows(files):
    return files.select("repo", "path", F.explode(F.array_distinct(keywords(F.col("text")))).alias("keyword"))


@register("s13_replace_by_file", lambda: f"""
WITH {MANIFEST_SQL}
SELECT DISTINCT repo, path, keyword FROM
  (SELECT repo, path, unnest({__import__('tessera.oracle.sqltext', fromlist=['keywords']).keywords('text')}) AS keyword FROM new)""")
def q_s13(spark, sf):
    """Incremental update of a keyword index equals the full rebuild on
    the new manifest (the oracle computes the rebuild)."""
    old, new = _manifests(spark, sf)
    diff = I.manifest_diff(old, new)
    return I.replace_by_file(_keyword_rows(old), diff, _keyword_rows(new))
