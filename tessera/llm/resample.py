"""Importance resampling towards a target distribution (12).

A 256-byte table lower-cases A-Z and blanks every ASCII byte that is no letter
or digit; ``bytes.split`` yields the words.  The feature of a run of words is
the crc32 of its UTF-8 bytes joined by spaces: that of a longer run continues
from the crc32 of the shorter one.  Counters reduce a slice of text, their sums
leave a task as at most ``buckets`` rows.  A bucket's gain compares its share
in the target with that in the source; a document's weight is the mean gain of
its features, and the draw takes the best weights with a noise that depends
only on the id (Gumbel top-k, sampling without replacement).

The draw sorts no table in one task: scores are counted (scores are whole
numbers, some ten thousands whatever the input), counts are added up in two
levels, and only rows at or above the cutoff are ordered, score by score.

Defined results: a null text has no words, weight 0 and no rank while
``min_words`` is above 0; a null id is hashed as an empty one and comes last
among ties; repeated rows count each, are drawn each, and take the ranks
beside one another; an empty table gives no rows; without target texts all
gains follow from the smoothing."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .common import as_bytes, slices, text_rows, word_table, written

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# Scores that are added up together before the two levels meet.
COARSE = 256
# Copies of a row that are listed together.
LIST = 100_000

_TABLE = word_table((string.digits + string.ascii_lowercase).encode())


def words(data: bytes) -> list[bytes]:
    """Words of a text in UTF-8."""
    return data.translate(_TABLE).split()


def features(found: list[bytes], longest: int) -> Iterator[list[int]]:
    """crc32 of the runs of 1, 2, ... ``longest`` consecutive words; a run's
    value is the seed of the run that is a word longer."""
    level = list(map(crc32, found))
    yield level
    for n in range(1, longest):
        level = [crc32(b" " + word, seed) for seed, word in zip(level, found[n:])]
        yield level


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for part in slices(batches):
            seen: Counter = Counter()
            for data in as_bytes(part.column("text")):
                for level in features(words(data), longest):
                    seen.update(level)
            keys = np.fromiter(seen.keys(), np.int64, len(seen))
            np.add.at(total, keys % buckets, np.fromiter(seen.values(), np.int64, len(seen)))
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket from its counts in source and target, as thousandths
    of a natural logarithm; at most ``buckets`` rows of each reach the driver."""
    def counts(frame: DataFrame) -> list[int]:
        out = [0] * buckets
        for row in frame.toLocalIterator():
            out[row.bucket] = row.n
        return out

    s, t = counts(source), counts(target)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain) per row."""
    rows = text_rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n_words, n_features, weights = [], [], []
            for data in as_bytes(part.column("text")):
                found = words(data)
                total = n = 0
                for level in features(found, longest):
                    total += int(gains[np.array(level, dtype=np.int64) % len(gains)].sum())
                    n += len(level)
                n_words.append(len(found))
                n_features.append(n)
                weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noisy(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """With score: the weight and a noise from the id's hash."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    share = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(share))))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """With rank: 1, 2, ... by score, then id, for the drawn share of the rows
    with enough words; null for all others.  ``scored`` is read several
    times."""
    able = F.col("n_words") >= min_words
    counted = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("score") / COARSE))
    best = Window.orderBy(F.desc("part"))
    parts = counted.groupBy("part").agg(F.sum("n").alias("n")) \
        .select("part", (F.sum("n").over(best) - F.col("n")).alias("above"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("score"))) - F.col("n")
    begun = counted.withColumn("inside", inside).join(bounded_broadcast(parts), "part") \
        .select("score", (F.col("above") + F.col("inside")).alias("before"), F.call_function("div", F.col("rows") * percent, F.lit(100)).alias("drawn"))
    begun = written(begun.where("before < drawn"), "resample-scores")
    cutoff = begun.agg(F.min("score")).first()[0]
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if cutoff is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    inside_draw = F.coalesce(able & (F.col("score") >= cutoff), F.lit(False))
    alike = scored.where(inside_draw).groupBy(*columns).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_words", "n_features", "weight")
    placed = alike.join(bounded_broadcast(begun), "score").withColumn("last", F.col("before") + F.sum("copies").over(order))
    # a row for each copy again, from lists of bounded length
    start, end = F.col("last") - F.col("copies") + 1, F.col("last")
    ranked = placed.select(*columns, "drawn", "last", F.explode(F.sequence(start, end, F.lit(LIST))).alias("at")) \
        .select(*columns, "drawn", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + (LIST - 1), end))).alias("at")) \
        .select(*columns, F.when(F.col("at") <= F.col("drawn"), F.col("at")).alias("rank"))
    return scored.where(~inside_draw).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score
    and rank among the drawn."""
    gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets), buckets)
    weighed = weigh(docs, gains, id_col=id_col, text_col=text_col, longest=longest)
    return draw(written(noisy(weighed, seed), "resample-scored"), percent, min_words)


# crc32 in SQL: eight steps of division by the polynomial for each byte of each distinct word.
ORACLE_SQL = r"""
WITH RECURSIVE
w AS (
  SELECT 's' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 't', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
shift(byte, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM shift WHERE k < 8),
crc_table AS (SELECT byte, c FROM shift WHERE k = 8),
u AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)),
step(word, h, k, crc) AS (
  SELECT word, h, 0, 4294967295::BIGINT FROM u
  UNION ALL
  SELECT s.word, s.h, s.k + 1, xor(t.c, s.crc >> 8) FROM step s
  JOIN crc_table t ON t.byte = xor(s.crc, ('0x' || substr(s.h, 2 * s.k + 1, 2))::BIGINT) & 255
  WHERE 2 * s.k < length(s.h)),
bucket AS (SELECT word, xor(crc, 4294967295) % 10000 AS b FROM step WHERE 2 * k = length(h)),
n AS (SELECT w.side, w.doc_id, k.b, count(*) AS n FROM w JOIN bucket k USING (word) GROUP BY ALL),
c AS (SELECT b, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM n GROUP BY b),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM c),
gain AS (SELECT b, floor(1000 * ln((c.t + 1)::DOUBLE * (total.s + 10000)::DOUBLE / ((c.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS g
         FROM c, total),
one AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n)::DOUBLE)::BIGINT AS weight FROM n JOIN gain USING (b)
        WHERE side = 's' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(o.n_features, 0)::BIGINT AS n_features, coalesce(o.weight, 0)::BIGINT AS weight,
         coalesce(o.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN one o USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score::BIGINT AS score, CASE WHEN r.place <= r.drawn THEN r.place END::BIGINT AS rank
FROM scored s LEFT JOIN ranked r USING (doc_id)
"""
