"""Knowledge kept up to date by a stream of stores and lookups.

State lies in buckets of keys (``sources.versioned``); a micro-batch rewrites
only the buckets of its keys.  ``known`` holds what events up to a bucket's
horizon (its newest event less ``delay``) have led to: one row per key with the
latest store and its hits.  ``recent`` holds the events behind the horizon as
they came, so that rows may come in any order within the delay and the state is
what one pass over all events gives (``memory.knowledge_state``).

A batch's state is named by its number: a batch that runs again after it has
been applied changes nothing, and one that failed halfway has left nothing.
Events that come later than the delay are dropped, as by a watermark.  Hot keys
are partial aggregates and an equi-join; no key's events are gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources import versioned as V

EVENT = "key string, kind string, ts timestamp, ord bigint, value string, confidence double"
KNOWN = ("key string, value string, confidence double, created_at timestamp, store_ord bigint, last_used_at timestamp, "
         "hit_count bigint")
BUCKETS = 16
DELAY = "1 hour"


def folded(known: DataFrame, events: DataFrame) -> DataFrame:
    """State of each key of ``known`` after ``events``; rows carry repo (the
    type) and bucket."""
    place = [*V.PLACE, "key"]
    stores = events.where("kind = 'store'").select(
        *place, "value", "confidence", "ts", "ord", F.lit(0).cast("long").alias("hits"), F.col("ts").alias("used")).unionByName(known.select(
            *place, "value", "confidence", F.col("created_at").alias("ts"), F.col("store_ord").alias("ord"),
            (F.col("hit_count") - 1).alias("hits"), F.col("last_used_at").alias("used")))
    row = F.struct("value", "confidence", "ts", "ord", "hits", "used")
    latest = stores.groupBy(*place).agg(F.max_by(row, F.struct("ts", "ord")).alias("s")).select(*place, "s.*")
    after = events.where("kind = 'lookup'").select(*place, F.col("ts").alias("at"), F.col("ord").alias("at_ord")) \
        .join(latest.select(*place, "ts", "ord"), place) \
        .where((F.col("at") > F.col("ts")) | ((F.col("at") == F.col("ts")) & (F.col("at_ord") > F.col("ord")))) \
        .groupBy(*place).agg(F.count("*").alias("more"), F.max("at").alias("last"))
    return latest.join(after, place, "left").select(
        *place, "value", "confidence", F.col("ts").alias("created_at"), F.col("ord").alias("store_ord"),
        F.greatest("used", "last").alias("last_used_at"), (1 + F.col("hits") + F.coalesce("more", F.lit(0))).alias("hit_count"))


def upsert(batch: DataFrame, batch_id: int, path: str, buckets: int = BUCKETS, delay: str = DELAY) -> None:
    """``foreachBatch`` body over (type, key, kind in {store, lookup}, ts,
    ord, value, confidence)."""
    spark = batch.sparkSession
    version = f"v{batch_id + 1:08d}"
    if version in V.states(spark, path):
        return
    new = batch.select(F.col("type").alias("repo"), "key", "kind", F.col("ts").cast("timestamp").alias("ts"),
                       F.col("ord").cast("long").alias("ord"), "value", F.col("confidence").cast("double").alias("confidence")) \
        .withColumn("bucket", V.bucket_of(buckets, "key"))
    new = cut_lineage(new)
    touched = new.select(*V.PLACE).distinct()
    known = V.read(spark, path, "known", KNOWN, only=touched)
    recent = V.read(spark, path, "recent", EVENT, only=touched)
    wait = F.expr(f"INTERVAL {delay}")
    clock = recent.groupBy(*V.PLACE).agg(F.max("ts").alias("newest"))
    in_time = new.join(clock, V.PLACE, "left").where(F.col("newest").isNull() | (F.col("ts") > F.col("newest") - wait)).drop("newest")
    events = recent.unionByName(in_time)
    horizon = events.groupBy(*V.PLACE).agg((F.max("ts") - wait).alias("horizon"))
    events = cut_lineage(events.join(horizon, V.PLACE).withColumn("old", F.col("ts") <= F.col("horizon")).drop("horizon"))
    V.change(spark, path, touched, {"known": lambda: (folded(known, events.where("old")), ["key"]),
                                    "recent": lambda: (events.where("not old").drop("old"), ["key", "ts"])}, version)


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """The state after the last batch, recent events included: type, key,
    value, confidence, created_at, last_used_at, hit_count."""
    now = folded(V.read(spark, path, "known", KNOWN), V.read(spark, path, "recent", EVENT))
    return now.select(F.col("repo").alias("type"), "key", "value", "confidence", "created_at", "last_used_at", "hit_count")


def run(events: DataFrame, path: str, buckets: int = BUCKETS, delay: str = DELAY) -> None:
    """Run the stream over what has come so far; a later run goes on from its
    checkpoint, which lies beside the state."""
    query = (events.writeStream.foreachBatch(lambda batch, n: upsert(batch, n, path, buckets, delay))
             .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
