"""Change-feed debounce, running counters and streaming
knowledge upserts.  Each transformation is a plain DataFrame function,
so the same code runs on a batch DataFrame (tests, backfills) and on a
``readStream`` DataFrame (watermarked, incremental)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, folders_in

WATERMARK = "10 minutes"


def change_bursts(changes: DataFrame, gap: str = "1 second") -> DataFrame:
    """I03 debounce: one row per burst of change events per repo — a
    session that restarts on each event (quiet period ``gap``).

    The feed is split two-level so no window spans a whole repository: gaps
    are found inside time buckets (60 gaps wide) and across bucket edges
    from one row per bucket; burst ids are a within-bucket running count
    plus the count of earlier bursts from one row per bucket.  A stream of
    changes goes through ``bursts``, batch by batch."""
    c = numbered_bursts(changes, gap)
    g = c.groupBy("repo", "sid").agg(F.min("ts").alias("burst_start"), F.max("ts").alias("last_ts"),
                                     F.count(F.lit(1)).alias("events"), F.countDistinct("path").alias("paths"))
    return g.select("repo", "burst_start",
                    (F.col("last_ts") + F.expr(f"INTERVAL {gap}")).alias("burst_end"), "events", "paths")


def numbered_bursts(changes: DataFrame, gap: str) -> DataFrame:
    """Change events (repo, path, ts) with ``sid``, the number of their burst
    in the repository."""
    from pyspark.sql import Window
    gap_s = _seconds(gap)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    c = changes.select("repo", "path", "ts", us.alias("t")).withColumn("b", F.floor(F.col("t") / (gap_s * 60 * 1_000_000)))
    w_in = Window.partitionBy("repo", "b").orderBy("t", "path")
    c = c.withColumn("prev_t", F.lag("t").over(w_in))
    per_b = c.groupBy("repo", "b").agg(F.min("t").alias("b_min"), F.max("t").alias("b_max"))
    w_b = Window.partitionBy("repo").orderBy("b")
    per_b = per_b.withColumn("prev_b_max", F.lag("b_max").over(w_b))
    c = c.join(per_b.select("repo", "b", "prev_b_max"), ["repo", "b"])
    prev = F.coalesce(F.col("prev_t"), F.col("prev_b_max"))
    c = c.withColumn("brk", (prev.isNull() | (F.col("t") - prev >= gap_s * 1_000_000)).cast("int"))
    c = c.withColumn("in_b", F.sum("brk").over(w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    nb = c.groupBy("repo", "b").agg(F.sum("brk").alias("n_brk"))
    nb = nb.withColumn("before", F.coalesce(F.sum("n_brk").over(w_b.rowsBetween(Window.unboundedPreceding, -1)),
                                            F.lit(0)))
    return c.join(nb.select("repo", "b", "before"), ["repo", "b"]) \
        .select("repo", "path", "ts", (F.col("before") + F.col("in_b")).alias("sid"))


def _seconds(gap: str) -> int:
    n, unit = gap.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600}[unit]
    return int(n) * mult


def hourly_counters(log: DataFrame) -> DataFrame:
    """Tumbling 1-hour counters per retriever (count, correct,
    token and latency sums).  Watermarked when streaming."""
    src = (log.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", WATERMARK)
           if log.isStreaming else log)
    return (src.groupBy(F.window("timestamp", "1 hour").alias("w"), "retriever")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("correct"),
                 F.sum("tokens").alias("tokens"), F.sum("latency_ms").alias("latency_ms"))
            .select(F.col("w.start").alias("window_start"), "retriever", "n", "correct", "tokens", "latency_ms"))


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Replay of the ``events`` table as a stream (file source)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def run_to_table(df: DataFrame, name: str, output_mode: str = "append", run_id: str | None = None) -> DataFrame:
    """Run a streaming DataFrame to completion (available-now trigger) into
    Parquet under the shared folder and return what it wrote.  Every batch is
    a folder of its own, rewritten if the batch is retried; with "complete"
    the last one is the result.  A driver that restarts with the same
    ``run_id`` resumes from the checkpoint; without one each run is new."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{run_id or uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/v{batch_id:08d}")

    q = (df.writeStream.foreachBatch(keep).outputMode(output_mode)
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    versions = folders_in(spark, f"{base}/out")
    if not versions:
        return spark.createDataFrame([], df.schema)
    wanted = versions[-1:] if output_mode == "complete" else versions
    return spark.read.schema(df.schema).parquet(*[f"{base}/out/{v}" for v in wanted])


def knowledge_upserts(batch: DataFrame, batch_id: int, target_path: str) -> None:
    """I06 ``foreachBatch`` body: last write per (type, key) in the
    micro-batch, merged into the target by replace-by-key and written as
    a new version directory.  The version before this batch's own is the old
    state, so a retried batch writes the same again."""
    row = F.struct(*[F.col(c) for c in batch.columns])
    latest = batch.groupBy("type", "key").agg(F.max_by(row, F.struct("ts", "ord")).alias("row")).select("row.*")
    spark = batch.sparkSession
    target_path = target_path.rstrip("/")
    out = f"{target_path}/v{batch_id:08d}"
    prev = [v for v in folders_in(spark, target_path) if v.startswith("v") and v < f"v{batch_id:08d}"]
    if prev:
        both = spark.read.parquet(f"{target_path}/{prev[-1]}").unionByName(latest)      # an older write that comes late stays behind
        latest = both.groupBy("type", "key").agg(F.max_by(row, F.struct("ts", "ord")).alias("row")).select("row.*")
    latest.write.mode("overwrite").parquet(out)
