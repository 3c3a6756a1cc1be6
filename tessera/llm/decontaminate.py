"""Benchmark decontamination (9): word windows of the test items against
every training text.

The benchmark is cut into shards of at most ``shard_bytes`` of text.  Each
shard becomes a set of hashed n-grams, small enough to broadcast by
construction, and one pass over the documents looks for its windows; a
larger benchmark makes more passes, never a larger broadcast.  A pass hashes
the windows of a whole batch of texts with numpy, looks them up in the sorted
hashes and compares the words of every hit, so a result is exact.

Defined results: a null text has no words and no hit; an item without words
has no window; equal windows of several items count for each of them; items of
one id are one item; an item without an id hits words and contaminates, but is
not named; repeated documents give repeated rows; an empty benchmark hits nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, list_array, ranges, slices, text_rows

WINDOW = 13
SHARD_BYTES = 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

# Lower case for A-Z; every ASCII byte outside 0-9, A-Z, a-z is a gap.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def window_hash(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(len(starts), dtype=np.uint64)
    for j in range(length):
        h = (h + ids[starts + j].astype(np.uint64) + np.uint64(1)) * _BASE
        h ^= h >> np.uint64(29)
    return h


class WindowIndex:
    """The windows of some items, by window length: sorted hashes, the place
    of each window among the items' words, and the number of its item's name
    (-1 without one).  A window that an item repeats is there once."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[str, int] = {}
        flat, sizes, owners = [], [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if ids:
                flat.extend(ids)
                sizes.append(len(ids))
                owners.append(-1 if name is None else number.setdefault(name, len(number)))
        self.names = list(number)
        self.ids = np.array(flat, dtype=np.int32)
        size, owner = np.array(sizes, dtype=np.int64), np.array(owners, dtype=np.int64)
        begin, lengths = np.cumsum(size) - size, np.minimum(size, window)
        self.tables = {}
        for length in np.unique(lengths).tolist():
            runs = size[lengths == length] - length + 1
            start, item = ranges(begin[lengths == length], runs), np.repeat(owner[lengths == length], runs)
            h = window_hash(self.ids, start, length)
            order = np.lexsort((item, h))
            h, start, item = h[order], start[order], item[order]
            again = np.flatnonzero((h[1:] == h[:-1]) & (item[1:] == item[:-1]))
            for j in range(length):
                again = again[self.ids[start[again] + j] == self.ids[start[again + 1] + j]]
            self.tables[length] = tuple(np.delete(x, again + 1) for x in (h, start, item))

    def scan(self, texts: list[bytes]):
        """Numbers of words, hit spans as (document, start, end) in word
        positions, and (document, item) pairs of some texts."""
        get, ids, counts = self.vocabulary.get, [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            words = words_of(text)
            counts[k] = len(words)
            ids.extend([get(w, -1) for w in words])
            ids.append(-1)                      # no window runs across two texts
        ids = np.array(ids, dtype=np.int64)
        ends = np.cumsum(counts + 1)
        gaps = np.flatnonzero(ids < 0)
        reach = np.diff(np.concatenate([[-1], gaps])) - 1   # known words before each gap
        cover = np.zeros(len(ids) + 1, dtype=np.int32)
        pairs = []
        for length, (hashes, start, item) in self.tables.items():
            long = reach >= length
            runs = reach[long] - length + 1
            at = ranges(gaps[long] - reach[long], runs)
            if not len(at):
                continue
            h = window_hash(ids, at, length)
            first = np.searchsorted(hashes, h, side="left")
            last = np.searchsorted(hashes, h, side="right")
            some = last > first
            at, first, n = at[some], first[some], (last - first)[some]
            which, at = ranges(first, n), np.repeat(at, n)
            same = np.ones(len(at), dtype=bool)
            for j in range(length):
                same &= ids[at + j] == self.ids[start[which] + j]
            at, which = at[same], which[same]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            of = np.searchsorted(ends, at, side="right")
            pairs.append(np.stack([of, item[which]], axis=1)[item[which] >= 0])
        hit = np.cumsum(cover[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        start, end = edges[::2], edges[1::2]
        of = np.searchsorted(ends, start, side="right")
        base = (ends - counts - 1)[of] if len(of) else of
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype=np.int64)
        return counts, of, start - base, end - base, pairs


def _shards(benchmark: DataFrame, item_col: str, text_col: str, shard_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about ``shard_bytes`` (rows dealt by hash,
    so twice the number that the mean needs)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")) \
        .where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if total <= shard_bytes else 2 * -(-total // shard_bytes)
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def _shared_index(docs: DataFrame, shard: DataFrame, window: int):
    """Broadcast index of one shard, whose size ``shard_bytes`` bounds."""
    rows = [(r.item, r.text.encode()) for r in shard.toLocalIterator()]
    return docs.sparkSession.sparkContext.broadcast(WindowIndex(rows, window))


SCAN_SCHEMA = "doc_id {id}, n_words long, starts array<long>, ends array<long>, items array<string>"


def _scan(docs: DataFrame, shard: DataFrame, window: int, id_type: str) -> DataFrame:
    shared = _shared_index(docs, shard, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in slices(batches):
            counts, of, start, end, pairs = index.scan(as_bytes(part.column("text")))
            spans = np.bincount(of, minlength=len(counts))
            names = pa.array([index.names[i] for i in pairs[:, 1]], pa.string())
            n_items = np.bincount(pairs[:, 0], minlength=len(counts))
            columns = [part.column("doc_id"), pa.array(counts), list_array(start, spans), list_array(end, spans),
                       pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_items)]).astype(np.int32)), names)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "starts", "ends", "items"])

    return docs.mapInArrow(run, SCAN_SCHEMA.format(id=id_type))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any
    window), starts and ends of the hit spans in words, and items, the sorted
    ids of the items that have a window in the text."""
    rows = text_rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shards = _shards(benchmark, item_col, item_text_col, shard_bytes)
    if len(shards) == 1:
        found = _scan(rows, shards[0], window, id_type)
    else:
        keyed = rows.withColumn("row_key", F.struct("doc_id", F.md5("text").alias("digest")))
        passes = [_scan(keyed.select(F.col("row_key").alias("doc_id"), "text"), s, window,
                        "struct<doc_id:" + id_type + ",digest:string>") for s in shards]
        union = passes[0]
        for p in passes[1:]:
            union = union.unionByName(p)
        # equal rows have equal spans, which collect_set keeps once
        merged = union.groupBy("doc_id").agg(
            F.max("n_words").alias("n_words"), (F.count("*") / len(shards)).cast("int").alias("copies"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        zero = F.array().cast("array<struct<starts:bigint,ends:bigint>>")
        joined = F.aggregate("spans", zero, lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= s["starts"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1),
                     F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"),
                                      F.greatest(F.element_at(acc, -1)["ends"], s["ends"]).alias("ends")))))
            .otherwise(F.concat(acc, F.array(s))))
        found = merged.withColumn("spans", joined) \
            .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))) \
            .select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", F.col("spans.starts").alias("starts"),
                    F.col("spans.ends").alias("ends"), "items")
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "starts", "ends",
                        F.array_sort("items").alias("items"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A document is contaminated if at least a twentieth of its words lie
    inside benchmark windows."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                        item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                        shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents that are not contaminated, all their columns as they
    were.  With one shard this is a filter in one pass; with more, the keys
    of the contaminated rows come back through a join."""
    shards = _shards(benchmark, item_col, item_text_col, shard_bytes)
    if len(shards) == 1:
        index = _shared_index(docs, shards[0], window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                counts, of, start, end, _ = index.value.scan([t or b"" for t in as_bytes(part.column(text_col))])
                n_hit = np.bincount(of, weights=end - start, minlength=len(counts))
                yield part.filter(pa.array((n_hit == 0) | (20 * n_hit < counts)))

        return docs.mapInArrow(run, docs.schema)
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.struct(F.col(id_col).alias("hit_id"), digest.alias("hit_digest")).alias("hit_key"), F.col(text_col).alias("t"))
    bad = benchmark_hits(keyed, benchmark, id_col="hit_key", text_col="t", item_col=item_col, item_text_col=item_text_col,
                         window=window, shard_bytes=shard_bytes) \
        .where(contaminated()).select(F.col("doc_id.hit_id").alias("hit_id"), F.col("doc_id.hit_digest").alias("hit_digest")).distinct()
    left, right = docs.alias("docs"), bad.alias("bad")
    same = F.col(f"docs.{id_col}").eqNullSafe(F.col("bad.hit_id")) & \
        (F.md5(F.coalesce(F.col(f"docs.{text_col}"), F.lit(""))) == F.col("bad.hit_digest"))
    return left.join(right, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id and text of every document without the words of benchmark
    windows; texts without a hit stay as they are."""
    digest = F.md5("text")
    rows = text_rows(docs, id_col, text_col).withColumn("k", F.struct("doc_id", digest.alias("digest")))
    hits = benchmark_hits(rows, benchmark, id_col="k", window=window, shard_bytes=shard_bytes).where("n_hit > 0") \
        .dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("h"), "starts", "ends")

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([strip_spans(t, s, e) for t, s, e in zip(text, starts, ends)], dtype=object)

    same = F.col("k.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("k.digest") == F.col("h.digest"))
    joined = rows.join(hits, same, "left")
    return joined.select("doc_id", F.when(F.col("h").isNull(), F.col("text")).otherwise(
        cut("text", F.coalesce("starts", F.array().cast("array<long>")), F.coalesce("ends", F.array().cast("array<long>")))).alias("text"))


def strip_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the words of the spans and the gaps after them."""
    raw = text.encode()
    flat = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flat.view(np.int8), [0]])))
    begin, out, at = edge[::2], [], 0
    for s, e in zip(starts, ends):
        out.append(raw[at:begin[s]])
        at = begin[e] if e < len(begin) else len(raw)
    return b"".join([*out, raw[at:]]).decode()

