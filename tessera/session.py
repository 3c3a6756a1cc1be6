"""Session helpers: local sessions for tests, checkpoint directory,
size-checked broadcast."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bound (rows) for any side we hand to ``broadcast``.  Query
# batches, rule tables and per-query top-k sets sit far below it; if a
# side is larger, the join falls back to a shuffle join.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20


def local_session(cores: int | str = "*", app: str = "tessera",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured the way tests and the bench run."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint directory.

    The cluster names it in ``spark.checkpoint.dir``; we only set one of
    our own when it is unset (local tests)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint dir
        return spark.conf.get("spark.checkpoint.dir", "")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    path = os.path.join("/tmp", "tessera-checkpoints", uuid.uuid4().hex)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def _file_system(spark: SparkSession, path: str):
    """Hadoop file system of a path, and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` exists in the storage that Spark reads it from."""
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it is missing."""
    fs, at = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session."""
    sc = spark.sparkContext
    if not getattr(sc, "_tessera_shipped", False):
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        sc.addPyFile(archive)
        sc._tessera_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives
    executor loss; never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only after proving that it holds at most
    ``max_rows`` rows and ``max_bytes`` of values; otherwise return it
    unchanged so Spark plans a shuffle join."""
    wide = [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
            if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8) for f in df.schema.fields]
    size = df.limit(max_rows + 1).select(sum(wide, F.lit(0)).cast("long").alias("b")) \
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size.n <= max_rows and size.b <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row text work at least one task per core.

    A scan already split into >= defaultParallelism partitions (the
    normal case at scale) is returned untouched — no shuffle; only an
    under-split input (e.g. one Parquet row group) is round-robined."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. Spark Connect has no RDD API
        return df
    return df.repartition(target) if n < target else df
