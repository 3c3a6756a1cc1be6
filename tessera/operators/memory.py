"""Knowledge memory, cache-log analytics, discoveries, sessions.

The reference keeps these as in-process maps; here they are keyed tables
and access logs, answered with windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def knowledge_state(log: DataFrame) -> DataFrame:
    """M01 + M02 over a log ``(key, kind in {store, lookup}, ts, ord,
    value, confidence)``.  Latest store wins (created_at, hit_count reset
    to 1); every lookup after it is a hit (hit_count + 1, last_used_at).

    No per-key window: the latest store is a partial aggregate
    (``max_by``), lookups meet it through an equi-join (AQE splits a hot
    key), and hits are a second partial aggregate."""
    order = F.struct("ts", "ord")
    latest = (log.where(F.col("kind") == "store").groupBy("key")
              .agg(F.max_by(F.struct("value", "confidence", "ts", "ord"), order).alias("s"))
              .select("key", F.col("s.value").alias("value"), F.col("s.confidence").alias("confidence"),
                      F.col("s.ts").alias("created_at"), F.col("s.ord").alias("store_ord")))
    after = ((F.col("ts") > F.col("created_at"))
             | ((F.col("ts") == F.col("created_at")) & (F.col("ord") > F.col("store_ord"))))
    hits = (log.where(F.col("kind") == "lookup").select("key", "ts", "ord")
            .join(latest.select("key", "created_at", "store_ord"), "key").where(after)
            .groupBy("key").agg(F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last_hit")))
    out = latest.join(hits, "key", "left")
    return out.select("key", "value", "confidence", "created_at",
                      F.coalesce(F.col("last_hit"), F.col("created_at")).alias("last_used_at"),
                      (1 + F.coalesce(F.col("hits"), F.lit(0))).alias("hit_count"))


def knowledge_stats(state: DataFrame, type_col: str = "type") -> DataFrame:
    """Count per type."""
    return state.groupBy(type_col).agg(F.count(F.lit(1)).alias("n"))


def lru_replay(access: DataFrame, capacity: int) -> DataFrame:
    """M04 cache replay over an access log ``(cache, key, ts, ord)``.

    An access is an LRU hit iff its key was accessed before in the same
    cache and fewer than ``capacity`` distinct other keys were touched in
    between.  distinct(p, i) = #{j in (p, i) : next(j) > i}; only
    accesses whose gap i-p-1 reaches ``capacity`` need that count (a
    shorter gap is a hit outright).  Output: per cache hits, misses,
    hit_rate, plus per-access rows via ``lru_accesses``."""
    rows = lru_accesses(access, capacity)
    return rows.groupBy("cache").agg(
        F.sum(F.col("hit").cast("long")).alias("hits"),
        F.sum((~F.col("hit")).cast("long")).alias("misses")).withColumn(
        "hit_rate", F.when((F.col("hits") + F.col("misses")) > 0,
                           F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0))


def lru_accesses(access: DataFrame, capacity: int, window: int | None = None) -> DataFrame:
    """Per access: hit iff the key was seen before and fewer than
    ``capacity`` distinct keys were touched since (distinct(p, i) =
    #{j in (p, i) : next(j) > i}).

    Bounded work: gaps shorter than ``capacity`` are hits outright; for
    longer gaps only the last ``window`` accesses (default 4·capacity)
    are expanded — reaching ``capacity`` live keys there decides a miss,
    and a gap no longer than the window is counted exactly.  Only the
    remaining accesses (long gap, few distinct keys near the end) expand
    their whole gap."""
    window = window or max(4 * capacity, capacity + 1)
    w = Window.partitionBy("cache").orderBy("ts", "ord")
    seq = access.withColumn("i", F.row_number().over(w))
    wk = Window.partitionBy("cache", "key").orderBy("i")
    seq = seq.withColumn("p", F.lag("i").over(wk)).withColumn("nxt", F.lead("i").over(wk))
    nxt = seq.select("cache", F.col("i").alias("j"), "nxt")

    def live_count(rows: DataFrame, lo) -> DataFrame:
        between = rows.select("cache", F.col("i").alias("at"), F.explode(F.sequence(lo, F.col("i") - 1)).alias("j"))
        return (between.join(nxt, ["cache", "j"])
                .where(F.col("nxt").isNull() | (F.col("nxt") > F.col("at")))
                .groupBy("cache", "at").agg(F.count(F.lit(1)).alias("live")))

    far = seq.where(F.col("p").isNotNull() & ((F.col("i") - F.col("p") - 1) >= capacity))
    lo1 = F.greatest(F.col("p") + 1, F.col("i") - window)
    near = live_count(far, lo1).withColumnRenamed("at", "i")
    f1 = far.join(near, ["cache", "i"], "left").fillna({"live": 0})
    decided = f1.where((F.col("live") >= capacity) | ((F.col("i") - F.col("p") - 1) <= window)) \
        .select("cache", "i", F.col("live").alias("distinct_between"))
    rest = f1.where((F.col("live") < capacity) & ((F.col("i") - F.col("p") - 1) > window)).drop("live")
    exact = live_count(rest, F.col("p") + 1).select("cache", F.col("at").alias("i"),
                                                    F.col("live").alias("distinct_between"))
    counts = decided.unionByName(exact)
    out = seq.join(counts, ["cache", "i"], "left")
    hit = F.col("p").isNotNull() & (F.coalesce(F.col("distinct_between"), F.lit(0)) < capacity)
    return out.select("cache", "key", "ts", "ord", "i", hit.alias("hit"))


def asof_discovery(stores: DataFrame, lookups: DataFrame, ttl_seconds: int) -> DataFrame:
    """For each lookup the newest store of the same key made at
    or before it; a hit iff that store is at most ``ttl_seconds`` old
    (store fields are null on a miss).

    Only stores within the TTL can decide a hit, so the as-of join is an
    equi-join on (key, time bucket of width ttl) against the lookup's
    bucket and the one before it, then the newest qualifying store — no
    per-key window, and a hot key is spread over its time buckets."""
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    s = stores.select("key", F.col("ts").alias("store_ts"), F.col("ord").alias("store_ord"),
                      F.col("confidence").alias("store_conf"), (sec("ts") / ttl_seconds).cast("long").alias("bucket"))
    lk = lookups.select("key", "ts", "ord", (sec("ts") / ttl_seconds).cast("long").alias("b0"))
    cand = lk.select("*", F.explode(F.array(F.col("b0"), F.col("b0") - 1)).alias("bucket"))
    age = sec("ts") - sec("store_ts")
    m = (cand.join(s, ["key", "bucket"])
         .where((F.col("store_ts") <= F.col("ts")) & (age <= ttl_seconds))
         .groupBy("key", "ts", "ord")
         .agg(F.max_by(F.struct("store_ts", "store_conf"), F.struct("store_ts", "store_ord")).alias("s")))
    out = lk.join(m, ["key", "ts", "ord"], "left")
    return out.select("key", "ts", "ord", F.col("s.store_ts").alias("store_ts"), F.col("s.store_conf").alias("store_conf"),
                      (sec("ts") - F.unix_timestamp(F.col("s.store_ts").cast("timestamp"))).alias("age_s"),
                      F.col("s").isNotNull().alias("hit"))


TURN_BUCKET = 1024

# FIXED VALUES: whole-word pronouns replaced by the last resolved entity.
PRONOUN_RE = r"(?<![A-Za-z0-9_])(it|this)(?![A-Za-z0-9_])"


def session_entity(text):
    """T08 session variant: first word (trailing ?,.:;! stripped) of >= 2
    bytes starting A–Z with a later A–Z or '_'; '' if none."""
    words = F.transform(F.filter(F.split(text, r"\s+", -1), lambda w: w != ""),
                        lambda w: F.regexp_replace(w, r"[?,.:;!]+$", ""))
    cand = F.filter(words, lambda w: (F.octet_length(w) >= 2) & w.rlike(r"^[A-Z].*[A-Z_]"))
    return F.coalesce(F.try_element_at(cand, F.lit(1)), F.lit(""))


def last_capitalised(text):
    """Fixture rule: last word (punctuation trimmed) starting A–Z, >= 2 bytes."""
    words = F.transform(F.filter(F.split(text, r"\s+", -1), lambda w: w != ""),
                        lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", ""))
    cand = F.filter(words, lambda w: (F.octet_length(w) >= 2) & w.rlike(r"^[A-Z]"))
    return F.coalesce(F.try_element_at(cand, F.lit(-1)), F.lit(""))


def resolve_pronouns(turns: DataFrame) -> DataFrame:
    """M10 + T18 over ``(conv_id, turn, role, text)`` user turns: entity
    per turn, last non-empty entity of earlier user turns, pronouns
    replaced."""
    u = turns.where(F.col("role") == "user")
    ent = F.when(session_entity(F.col("text")) != "", session_entity(F.col("text"))).otherwise(
        last_capitalised(F.col("text")))
    u = u.withColumn("entity", F.when(ent != "", ent))
    # Last non-empty entity of earlier turns, two-level so no window spans
    # a whole conversation: a running window inside 1024-turn buckets,
    # plus the last entity of earlier buckets (a window over one row per
    # bucket).
    u = u.withColumn("bucket", F.floor(F.col("turn") / TURN_BUCKET))
    w_in = (Window.partitionBy("conv_id", "bucket").orderBy("turn")
            .rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn("in_bucket", F.last("entity", ignorenulls=True).over(w_in))
    per_b = u.groupBy("conv_id", "bucket").agg(
        F.max_by(F.col("entity"), F.when(F.col("entity").isNotNull(), F.col("turn"))).alias("b_last"))
    w_b = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.withColumn("before", F.last("b_last", ignorenulls=True).over(w_b)).select("conv_id", "bucket", "before")
    u = u.join(per_b, ["conv_id", "bucket"]).withColumn("last_resolved", F.coalesce("in_bucket", "before"))
    # the entity stands for itself: no group references in it
    quoted = F.replace(F.replace(F.col("last_resolved"), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    resolved = F.when(F.col("last_resolved").isNotNull(),
                      F.regexp_replace("text", PRONOUN_RE, quoted)).otherwise(F.col("text"))
    return u.select("conv_id", "turn", "entity", "last_resolved", resolved.alias("resolved"))
