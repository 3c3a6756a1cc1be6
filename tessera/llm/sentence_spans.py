"""Substring dedup (7): repeated runs of consecutive sentences.

From every sentence on, the shortest run with several sentences and at least
``MIN_WORDS`` words is hashed (one sentence alone if it has ``ALONE_WORDS``),
and with ``both_ends``, as in the query, the shortest such run that ends with
every sentence, so that both ends of a repeated passage are covered.  Equal runs anywhere in the corpus meet by hash; all but the first, in order of
document id and place, are repeated, and the sentences that any of them covers
are removed.  Hashes have 128 bits.  Counting is a partial aggregate and only
hashes that occur again are joined back, so a passage which a third of the
documents share is never gathered.

Defined results: a null or empty text has no sentence; texts too short for a
run keep everything; a null id comes before others; repeated rows are copies of
one another and all but the first lose what repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, slices, text_rows, written

MIN_WORDS = 12
SEVERAL = 2
ALONE_WORDS = 30
_CUT = regex.compile(r"(?<=[.!?])[^\S\n]+|\n+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the sentences of a text: they end after a mark and white
    space, or with the line."""
    out, at = [], 0
    for cut in _CUT.finditer(text):
        if cut.start() > at and not text[at:cut.start()].isspace():
            out.append((at, cut.start()))
        at = cut.end()
    if at < len(text) and not text[at:].isspace():
        out.append((at, len(text)))
    return out


def shortest(sizes: list[int]) -> list[tuple[int, int]]:
    """(start, end) of the shortest run from each sentence that begins one."""
    out, end, n = [], 0, 0
    for start in range(len(sizes)):
        if end <= start:
            end, n = start, 0
        while end < len(sizes) and not (n >= MIN_WORDS and end - start >= SEVERAL or n >= ALONE_WORDS):
            n += sizes[end]
            end += 1
        if not (n >= MIN_WORDS and end - start >= SEVERAL or n >= ALONE_WORDS):
            break
        out.append((start, end))
        n -= sizes[start]
    return out


def runs(parts: list[list[bytes]], both_ends: bool = True) -> list[tuple[int, int, bytes]]:
    """(start, end, hash) of the shortest runs from each sentence that begins
    one and, with ``both_ends``, to each sentence that ends one."""
    sizes = [len(p) for p in parts]
    joined = [b" ".join(p) for p in parts]
    places = set(shortest(sizes))
    if both_ends:
        places.update((len(parts) - e, len(parts) - s) for s, e in shortest(sizes[::-1]))
    return [(s, e, xxhash.xxh3_128_digest(b"\n".join(joined[s:e]))) for s, e in sorted(places)]


def repeated_sentences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", both_ends: bool = False) -> DataFrame:
    """One row per document: doc_id, digest (md5 of the text), n_sentences,
    removed (covered sentences as arrays of start and end, in sentences,
    disjoint and ordered) and first_docs (documents with the first copies)."""
    rows = text_rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, found = [], []
            for text in part.column("text").to_pylist():
                parts = [text[a:b].encode().translate(_LOWER).split() for a, b in sentences(text)]
                n.append(len(parts))
                found.append(runs(parts, both_ends))
            counts = np.array([len(f) for f in found])
            starts = np.array([s for f in found for s, _, _ in f], dtype=np.int32)
            ends = np.array([e for f in found for _, e, _ in f], dtype=np.int32)
            hashes = pa.array([h for f in found for _, _, h in f], pa.binary())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), pa.array(n, pa.int64()), list_array(starts, counts), list_array(ends, counts),
                 pa.ListArray.from_arrays(offsets, hashes)], ["doc_id", "digest", "n_sentences", "starts", "ends", "hashes"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    read = written(rows.withColumn("digest", F.md5("text")).mapInArrow(
        run, f"doc_id {id_type}, digest string, n_sentences long, starts array<int>, ends array<int>, hashes array<binary>")
        .withColumn("row", F.monotonically_increasing_id()), "spans-read")
    spans = read.select("row", "doc_id", F.explode(F.arrays_zip("hashes", "starts", "ends")).alias("s")) \
        .select("row", "doc_id", F.col("s.starts").alias("start"), F.col("s.ends").alias("end"), F.col("s.hashes").alias("hash"))
    first = spans.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "start")).alias("first")) \
        .where("n > 1").select("hash", "first")
    first = written(first, "spans-first")       # a side of its own, so that a hot hash can be split in the join
    again = spans.join(first, "hash").where(~F.struct("doc_id", "row", "start").eqNullSafe(F.col("first"))) \
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("covered"),
                            F.array_sort(F.collect_set("first.doc_id")).alias("first_docs"))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def union(covered: pd.Series) -> pd.Series:
        out = []
        for spans_ in covered:
            merged: list[dict] = []
            for s in spans_:
                if merged and s["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append({"start": s["start"], "end": s["end"]})
            out.append(merged)
        return pd.Series(out)

    again = again.select("row", union("covered").alias("removed"), "first_docs")
    return read.select("row", "doc_id", "digest", "n_sentences").join(again, "row", "left").select(
        "doc_id", "digest", "n_sentences", F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"),
        F.coalesce("first_docs", F.array().cast(f"array<{id_type}>")).alias("first_docs"))


def without_sentences(text: str, removed: list[tuple[int, int]]) -> str:
    """A text without some sentences and the gaps after them."""
    places, out, at = sentences(text), [], 0
    for a, b in removed:
        out.append(text[at:places[a][0]])
        at = places[b][0] if b < len(places) else len(text)
    return "".join([*out, text[at:]])


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every document without its repeated sentences.  Rows
    of equal id and text differ only in which of them is the first."""
    found = repeated_sentences(docs, id_col=id_col, text_col=text_col, both_ends=True) \
        .groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list("removed")).alias("each"))
    rows = text_rows(docs, id_col, text_col).withColumn("digest", F.md5("text"))

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series, each: pd.Series) -> pd.Series:
        return pd.Series([[without_sentences(t, [(s["start"], s["end"]) for s in spans]) for spans in e] for t, e in zip(text, each)])

    texts = rows.groupBy("doc_id", "digest").agg(F.first("text").alias("text"))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.digest") == F.col("f.digest"))
    return texts.alias("d").join(found.alias("f"), same).select(F.col("d.doc_id").alias("doc_id"), F.explode(cut("text", "each")).alias("text"))
