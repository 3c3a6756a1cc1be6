"""I03 as a stream: equal to one pass over the feed, and it updates files."""

import datetime
import random
import uuid

from pyspark.sql import functions as F

from tessera.operators import textindex as I
from tessera.operators.stored import manifest, update_files
from tessera.session import ensure_checkpoint_dir
from tessera.streaming import bursts as B
from tessera.streaming.changefeed import change_bursts

FEED = "repo string, path string, ts timestamp"


def at(seconds):
    return datetime.datetime(2024, 3, 1) + datetime.timedelta(seconds=seconds)


def folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/test-bursts-{uuid.uuid4().hex}"


def rows(df):
    return sorted(tuple(r) for r in df.select("repo", "burst_start", "burst_end", "events", "paths").collect())


def test_stream_equals_one_pass(spark):
    rng = random.Random(8)
    feed, t = [], 0.0
    for _ in range(400):
        t += rng.choice([0.2, 0.5, 0.9, 1.0, 3.0, 8.0])
        feed.append((rng.choice("ab"), f"src/{rng.choice(['x.py', 'y.py', 'y.py~', 'z.swp', '.gopls-1', 'w.go'])}", at(t)))
    coming = sorted(feed, key=lambda r: r[2].timestamp() + rng.uniform(0, 25))
    coming.append(("a", "src/late.py", at(0)))                     # beyond the delay
    base = folder(spark)
    third = len(coming) // 3 + 1
    for n in range(3):
        part = spark.createDataFrame(coming[n * third:(n + 1) * third], FEED)
        part.write.mode("append").parquet(f"{base}/feed")
        B.run(spark.readStream.schema(part.schema).parquet(f"{base}/feed"), f"{base}/state", delay="30 seconds")
    B.advance(part, 2, f"{base}/state", delay="30 seconds")         # a completed batch again
    wanted = spark.createDataFrame([r for r in feed if not r[1].rsplit("/", 1)[1].startswith(".gopls") and r[1][-1] != "~" and r[1][-4:] != ".swp"], FEED)
    assert rows(B.bursts(spark, f"{base}/state")) == rows(change_bursts(wanted)) != []
    closed = B.bursts(spark, f"{base}/state", still_open=False)
    assert 0 < closed.count() < B.bursts(spark, f"{base}/state").count()


def test_closed_bursts_update_their_files(spark):
    base = folder(spark)

    def corpus(**texts):
        return spark.createDataFrame([("r", f"f{i}.py", texts.get(f"f{i}", f"text {i}")) for i in range(6) if texts.get(f"f{i}") != "gone"],
                                     "repo string, path string, content string")

    I.update_index(corpus(), f"{base}/index", buckets=4)
    now, seen = corpus(f1="another text", f2="gone", f4="not told"), []

    def changed(files, batch_id):
        diff = update_files(now, f"{base}/index", I.TABLES, buckets=4, only=files)
        seen.append({r.path: r.status for r in diff.collect()})

    feed = [("r", "f1.py", at(1)), ("r", "f2.py", at(1.5)), ("r", "f3.py", at(2)), ("r", "f5.py~", at(2)), ("r", "f4.py", at(60))]
    B.advance(spark.createDataFrame(feed, FEED), 0, f"{base}/state", delay="10 seconds", changed=changed)
    assert seen == [{"f1.py": "changed", "f2.py": "deleted", "f3.py": "skipped"}]
    kept = {r.path: r.file_hash for r in manifest(spark, f"{base}/index").collect()}
    told = {r.path: r.h for r in corpus(f1="another text", f2="gone").select("path", F.sha2("content", 256).alias("h")).collect()}
    assert kept == told             # f4 changed too, but its burst is still open
    assert rows(B.bursts(spark, f"{base}/state", still_open=False)) == [("r", at(1), at(3), 3, 3)]
