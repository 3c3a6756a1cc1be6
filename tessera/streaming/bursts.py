"""I03 as an exact stream: bursts of change events, each of which starts an
incremental update (I01) of the files that it names.

A burst of a repository ends with a quiet period of ``gap``.  A micro-batch
joins its events to those of the bursts still open, numbers the bursts of this
bounded rest (``changefeed.numbered_bursts``), and closes those that no event
within ``delay`` of the newest can reach any more.  Closed bursts are written
with exact counts of events and paths; events of open ones are kept for the
next batch.  So events may come in any order within the delay, and all bursts
together are those of one pass over the feed.

Each batch has folders of its own, and its clock is written last: a batch that
runs again writes the same, one that has been completed is not run again.  Its
update, too, may run again, since it compares files by hash.  Events later than
the delay are dropped, as by a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, folders_in, path_exists
from .changefeed import change_bursts, numbered_bursts

GAP = "1 second"
DELAY = "10 minutes"

# FIXED VALUES: names of files whose changes are ignored, by end and by start.
IGNORED_ENDS = ["~", ".swp"]
IGNORED_STARTS = [".gopls"]


def ignored(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for end in IGNORED_ENDS:
        out = out | name.endswith(end)
    for start in IGNORED_STARTS:
        out = out | name.startswith(start)
    return out


def _versions(spark: SparkSession, path: str) -> list[str]:
    return [v for v in folders_in(spark, f"{path}/clock") if path_exists(spark, f"{path}/clock/{v}/_SUCCESS")]


def advance(batch: DataFrame, batch_id: int, path: str, gap: str = GAP, delay: str = DELAY,
            changed: Callable[[DataFrame, int], None] | None = None) -> None:
    """``foreachBatch`` body over (repo, path, ts).  ``changed`` is called
    with the distinct (repo, path) of the bursts that the batch closes."""
    spark = batch.sparkSession
    version = f"v{batch_id:08d}"
    done = _versions(spark, path)
    if version in done:
        return
    before = [v for v in done if v < version][-1:]
    new = batch.select("repo", "path", "ts").where(~ignored(F.col("path")))
    wait, quiet = F.expr(f"INTERVAL {delay}"), F.expr(f"INTERVAL {gap}")
    clock = None
    if before:
        clock = spark.read.parquet(f"{path}/clock/{before[0]}").first().clock
        new = new.where(F.col("ts") > F.lit(clock) - wait) if clock is not None else new
        new = spark.read.parquet(f"{path}/open/{before[0]}").unionByName(new)
    rows = cut_lineage(numbered_bursts(cut_lineage(new), gap))
    newest = rows.agg(F.max("ts")).first()[0]
    clock = max((c for c in (clock, newest) if c is not None), default=None)
    ends = rows.groupBy("repo", "sid").agg(F.max("ts").alias("last"))
    closed = ends.where(F.col("last") + quiet <= F.lit(clock) - wait) if clock is not None else ends.limit(0)
    over = cut_lineage(rows.join(closed.drop("last"), ["repo", "sid"], "left_semi").drop("sid"))
    rows.join(closed.drop("last"), ["repo", "sid"], "left_anti").drop("sid").write.mode("overwrite").parquet(f"{path}/open/{version}")
    change_bursts(over, gap).write.mode("overwrite").parquet(f"{path}/bursts/{version}")
    if changed is not None and not over.isEmpty():
        changed(over.select("repo", "path").distinct(), batch_id)
    batch.limit(0).agg(F.lit(clock).cast(batch.schema["ts"].dataType).alias("clock")).write.mode("overwrite").parquet(f"{path}/clock/{version}")


def bursts(spark: SparkSession, path: str, gap: str = GAP, still_open: bool = True) -> DataFrame:
    """(repo, burst_start, burst_end, events, paths) of the bursts closed so
    far and, with ``still_open``, of those that may still grow."""
    versions = _versions(spark, path)
    found = spark.read.parquet(*[f"{path}/bursts/{v}" for v in versions])
    return found.unionByName(change_bursts(spark.read.parquet(f"{path}/open/{versions[-1]}"), gap)) if still_open else found


def run(feed: DataFrame, path: str, gap: str = GAP, delay: str = DELAY, changed: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run the stream over what has come so far; a later run goes on from its
    checkpoint, which lies beside the state."""
    query = (feed.writeStream.foreachBatch(lambda batch, n: advance(batch, n, path, gap, delay, changed))
             .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
