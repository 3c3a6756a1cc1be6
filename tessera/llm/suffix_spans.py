"""Suffix-array dedup (13): bytes of repeated substrings of a fixed length.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  Suffixes are sorted by a mergesort whose
comparisons take prefix polynomial hashes and find the common extension of two
suffixes by binary search; neighbours with ``length`` common bytes are one
string, which their bytes verify.

No task sorts all suffixes.  Every string of ``length`` bytes has an anchor:
the least, by hash, of the strings of half that length in it, so that equal
strings have equal anchors at equal places.  Consecutive strings often share an
anchor, and only a fourteenth or so of all places is one.

1. Texts are dealt to blocks of about ``BLOCK_BYTES`` and written, bucketed by
   block, with their anchors; later steps read a block where it lies, and no
   text is shuffled.
2. Each block sends the hashes of its anchors, once each, and learns which are
   in other blocks too.
3. For these it sends the context of the anchor: the strings that share it, as
   one run of bytes, once each, with the smallest id that has it.  Suffixes of
   the contexts that meet are sorted, and the answer tells which strings start
   in a smaller document.
4. Each block unites the strings found and cuts them out.

An anchor in more than ``hot_blocks`` blocks sends its strings one by one,
dealt by their own hash, so that a passage which a third of the documents
share, with as many different neighbours, is spread; a block still sends each
string once.  Both ways are exact, and nothing is left out by either.

Defined results: a null text is empty; texts below ``length`` keep all; rows of
one id never remove one another's bytes; a null id is smaller than all others;
an empty table gives no rows.  Ids are whole numbers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import as_bytes, slices, text_rows, written

LENGTH = 50
BLOCK_BYTES = 4 << 20
# Text of one answering task, about; and blocks beyond which an anchor is hot.
BUCKET_BYTES = 8 << 20
HOT_BLOCKS = 256
# Places that numpy looks at together, and suffixes sorted together.
PIECE = 1 << 17
SORTED = 1 << 20
BASE = 0x9E3779B97F4A7C15
_HOT = 0xFFFF
_NO_ID = -(2**63)
_LOW = np.uint64((1 << 24) - 1)


# ---- prefix polynomial hashes

@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, pow(base, -1, 1 << 64), np.uint64)]))
    return up, down


class Prefixes:
    """Hash of any substring of ``data`` from one running sum."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        size = 1 << max(12, int(len(data)).bit_length())
        up, self.down = _powers(size, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashes_at(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` bytes from ascending places, piece by piece."""
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(data), PIECE):
        a, b = np.searchsorted(starts, [at, at + PIECE])
        if b > a:
            out[a:b] = Prefixes(data[at:at + PIECE + length]).of(starts[a:b] - at, length)
    return _mixed(out)


# ---- anchors

def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Ascending places of the anchors in texts that begin at ``starts``."""
    core = length // 2
    span = length - core + 1
    ends = np.append(starts[1:], len(data))
    inside = np.ones(len(data), bool)
    for s, e in zip(starts.tolist(), ends.tolist()):
        inside[max(s, e - length + 1):e] = False
    found = []
    for at in range(0, len(data) - length + 1, PIECE):
        part = data[at:at + PIECE + length - 1]
        own = inside[at:at + min(PIECE, len(part) - length + 1)]
        if not own.any():
            continue
        first = np.arange(len(part) - core + 1)
        least = (_mixed(Prefixes(part).of(first, core)) & ~_LOW) | first.astype(np.uint64)
        wide = 1
        while wide * 2 <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < span:
            least = np.minimum(least[:-(span - wide)], least[span - wide:])
        chosen = (least[:len(own)][own] & _LOW).astype(np.int64)
        found.append(np.unique(chosen) + at)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Block:
    """Texts of a block, one after the other, with their anchors."""

    def __init__(self, rows: pa.Table, length: int):
        rows = rows.sort_by("row")
        self.rows, self.length, self.span = rows, length, length - length // 2 + 1
        texts = as_bytes(rows.column("text").combine_chunks())
        self.text = b"".join(texts)
        self.data = np.frombuffer(self.text, np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], dtype=np.int64)
        self.ids = np.array([_NO_ID if i is None else i for i in rows.column("doc_id").to_pylist()], dtype=np.int64)
        gaps = [np.frombuffer(g, np.uint16) for g in rows.column("gaps").to_pylist()]
        self.doc = np.repeat(np.arange(len(texts)), [len(g) for g in gaps])
        self.place = np.concatenate([np.cumsum(g, dtype=np.int64) + s for g, s in zip(gaps, self.starts)])
        self.hash = hashes_at(self.data, self.place, length // 2)
        self.unique, self.which = np.unique(self.hash, return_inverse=True)

    def dealt(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, indexes) of the distinct anchor hashes."""
        return _dealt(self.unique, buckets)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the strings that share each anchor."""
        p, v = self.place, self.hash & ~_LOW
        first = np.maximum(p - self.span + 1, self.starts[self.doc])
        last = np.minimum(p, self.ends[self.doc] - self.length)
        for back in range(1, self.span):
            near = p[back:] - p[:-back] < self.span
            if not near.any():
                break
            left = near & (v[:-back] <= v[back:])
            first[back:] = np.where(left, np.maximum(first[back:], p[:-back] + 1), first[back:])
            right = near & (v[back:] < v[:-back])
            last[:-back] = np.where(right, np.minimum(last[:-back], p[back:] - self.span), last[:-back])
        return first, last

    def contexts(self, codes: dict[int, np.ndarray], hash_buckets: int, buckets: int) -> Contexts:
        """Strings of the anchors that occur in several documents."""
        code = np.zeros(len(self.unique), np.uint8)
        for bucket, at in self.dealt(hash_buckets):
            if bucket in codes:
                code[at] = codes[bucket]
        low, high = np.full(len(code), 2**63 - 1), np.full(len(code), _NO_ID)
        np.minimum.at(low, self.which, self.ids[self.doc])
        np.maximum.at(high, self.which, self.ids[self.doc])
        code = np.maximum(code, low != high)[self.which]
        first, last = self.runs()
        plain, hot = np.nonzero(code == 1)[0], np.nonzero(code == 2)[0]
        count = last - first + 1
        alone = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b + 1) for a, b in zip(first[hot].tolist(), last[hot].tolist()))])
        start = np.concatenate([first[plain], alone])
        doc = np.concatenate([self.doc[plain], np.repeat(self.doc[hot], count[hot])])
        order = np.argsort(self.ids[doc], kind="stable")
        key = np.concatenate([self.hash[plain], hashes_at(self.data, alone, self.length) if len(alone) else np.zeros(0, np.uint64)])
        offset = np.concatenate([self.place[plain] - first[plain], np.full(len(alone), _HOT)])
        count = np.concatenate([count[plain], np.ones(len(alone), np.int64)])
        return Contexts(self, *(x[order] for x in (start, count, offset, self.ids[doc], key)), buckets)


class Contexts:
    """Runs of strings of a block in order of document id; equal ones stand
    behind the first, which is sent."""

    def __init__(self, block: Block, start, count, offset, ids, key, buckets: int):
        self.start, self.count, self.offset, self.ids = start, count, offset, ids
        self.end = start + count + block.length - 1
        seen: dict = {}
        text = block.text
        self.head = np.array([seen.setdefault((o, text[s:e]), i) for i, (o, s, e)
                              in enumerate(zip(offset.tolist(), start.tolist(), self.end.tolist()))], dtype=np.int64)
        self.sent = np.unique(self.head)
        self.dealt = [(bucket, self.sent[at]) for bucket, at in _dealt(key[self.sent], buckets)]


def _dealt(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    used, at = np.unique(bucket[order], return_index=True)
    return list(zip(used.tolist(), np.split(order, at[1:]))) if len(used) else []


# ---- sort of suffixes

def compare(prefixes: Prefixes, data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 for the first ``length`` bytes of suffixes: their common
    extension by binary search over hashes, then the bytes behind it."""
    out = np.zeros(len(x), np.int8)
    unlike = np.nonzero(prefixes.of(x, length) != prefixes.of(y, length))[0]
    x, y = x[unlike], y[unlike]
    same, other = np.zeros(len(x), np.int64), np.full(len(x), length)
    while (open_ := other - same > 1).any():
        mid = np.where(open_, (same + other) // 2, same)
        alike = prefixes.of(x, mid) == prefixes.of(y, mid)
        same, other = np.where(alike, mid, same), np.where(alike, other, mid)
        other = np.maximum(other, same + 1)
    out[unlike] = np.where(data[x + same] < data[y + same], -1, 1)
    return out


def merge_sorted(prefixes: Prefixes, data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of suffixes by group, then by their first ``length`` bytes.  In
    each round, pairs of sorted runs of a group are merged: an element moves
    by the number of smaller elements in the other run, found by binary
    search, for all elements at once."""
    order = np.argsort(group, kind="stable")
    ordered = group[order]
    at = np.arange(len(order))
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    begin = np.maximum.accumulate(np.where(new, at, 0))
    size = np.diff(np.append(np.nonzero(new)[0], len(order)))[np.cumsum(new) - 1]
    width = 1
    while len(order) and width < size.max():
        active = np.nonzero(size > width)[0]
        base, n = begin[active], size[active]
        place = active - base
        left = (place // width) % 2 == 0
        other = base + np.where(left, (place // width + 1) * width, (place // width - 1) * width)
        stop = np.minimum(other + width, base + n)
        lo, hi = other.copy(), np.maximum(stop, other)
        mine = starts[order[active]]
        while (open_ := np.nonzero(lo < hi)[0]).size:
            mid = (lo[open_] + hi[open_]) // 2
            sign = compare(prefixes, data, starts[order[mid]], mine[open_], length)
            before = np.where(left[open_], sign < 0, sign <= 0)         # stable: the left run goes first
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        passed = lo - other
        run = base + (place // (2 * width)) * 2 * width
        moved = order.copy()
        moved[run + (place % width) + passed] = order[active]
        order = moved
        width *= 2
    return order


def equal_strings(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """Class number of each suffix: equal where the first ``length`` bytes
    are.  ``group`` tells apart strings that cannot be equal."""
    prefixes = Prefixes(data, base)
    order = merge_sorted(prefixes, data, starts, group, length)
    x, y = starts[order[:-1]], starts[order[1:]]
    same = (group[order[1:]] == group[order[:-1]]) & (prefixes.of(x, length) == prefixes.of(y, length))
    views = np.lib.stride_tricks.sliding_window_view(data, length)
    claimed = np.nonzero(same)[0]
    sure = all((views[x[part]] == views[y[part]]).all() for part in np.array_split(claimed, len(claimed) // PIECE + 1))
    if not sure:        # a collision of hashes: the bytes themselves decide
        return np.unique(np.ascontiguousarray(views[starts]).view(f"V{length}").ravel(), return_inverse=True)[1]
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ~same]))
    return out


def smaller_copies(contexts: dict[tuple[int, bytes], int], length: int) -> dict[tuple[int, bytes], np.ndarray]:
    """For each context, (offset of its anchor, bytes) -> smallest id: the
    smallest id that has each of its strings."""
    core = length // 2
    keys = list(contexts)
    text = b"".join(k[1] for k in keys)
    size = np.array([len(k[1]) for k in keys], dtype=np.int64)
    begin = np.cumsum(size) - size
    offset = np.array([k[0] for k in keys], dtype=np.int64)
    least = np.array([contexts[k] for k in keys], dtype=np.int64)
    data = np.frombuffer(text, np.uint8)
    hot = offset == _HOT
    anchor = np.empty(len(keys), np.uint64)
    for some, n in ((~hot, core), (hot, length)):
        anchor[some] = hashes_at(data, (begin + np.where(hot, 0, offset))[some], n)
    by_anchor = np.argsort(anchor, kind="stable")
    number = np.cumsum(np.concatenate([[False], anchor[by_anchor][1:] != anchor[by_anchor][:-1]])) if len(keys) else np.zeros(0, np.int64)
    strings = np.cumsum((size - length + 1)[by_anchor])
    out: dict = {}
    at = 0
    while at < len(keys):
        # whole anchors, up to the number of suffixes that are sorted together
        stop = np.searchsorted(strings, (strings[at - 1] if at else 0) + SORTED)
        stop = max(int(np.searchsorted(number, number[min(stop, len(keys) - 1)])), int(np.searchsorted(number, number[at], side="right")))
        mine, group = by_anchor[at:stop], number[at:stop]
        count = size[mine] - length + 1
        place = np.concatenate([data[b:b + n] for b, n in zip(begin[mine].tolist(), size[mine].tolist())])
        first = np.cumsum(size[mine]) - size[mine]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        inside = np.repeat(np.where(hot[mine], _HOT, offset[mine]), count) - np.where(np.repeat(hot[mine], count), 0, step)
        owner = np.repeat(least[mine], count)
        classes = equal_strings(place, np.repeat(first, count) + step, np.repeat(group, count) * (_HOT + 1) + inside, length)
        best = np.full(int(classes.max()) + 1, 2**63 - 1)
        np.minimum.at(best, classes, owner)
        for k, found in zip(mine.tolist(), np.split(best[classes], np.cumsum(count)[:-1])):
            out[keys[k]] = found
        at = stop
    return out


# ---- the operator

def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (the removed runs,
    in bytes) and kept (the bytes that remain)."""
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, part in enumerate(slices(batches, max_bytes=block_bytes)):
            texts = as_bytes(part.column("text"))
            size = np.array([len(t) for t in texts], dtype=np.int64)
            ends = np.cumsum(size)
            place = anchors(np.frombuffer(b"".join(texts), np.uint8), ends - size, length)
            each = np.split(place, np.searchsorted(place, ends[:-1]))
            gaps = [np.diff(p, prepend=s).astype(np.uint16).tobytes() for p, s in zip(each, (ends - size).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(texts), (task << 32) + n)), pa.array(np.arange(len(texts)), pa.int32()), part.column("doc_id"),
                 part.column("text"), pa.array(size), pa.array(gaps, pa.binary())], ["block", "row", "doc_id", "text", "n_bytes", "gaps"])

    name = f"suffix_blocks_{uuid.uuid4().hex}"
    rows.mapInArrow(to_blocks, "block long, row int, doc_id long, text string, n_bytes long, gaps binary").write \
        .bucketBy(partitions, "block").option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    blocks = spark.table(name)
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(partitions, total // bucket_bytes)

    def send_hashes(rows: pa.Table) -> pa.Table:
        block = Block(rows, length)
        dealt = block.dealt(buckets)
        sent = [(block.unique[at] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for _, at in dealt]
        return pa.table([pa.array([b for b, _ in dealt], pa.int32()), pa.array([rows.column("block")[0].as_py()] * len(dealt), pa.int64()),
                         pa.array(sent, pa.binary())], ["bucket", "block", "hashes"])

    def answer_hashes(rows: pa.Table) -> pa.Table:
        sent = rows.column("hashes").to_pylist()
        size = np.array([len(h) // 6 for h in sent])
        wide = np.zeros((int(size.sum()), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(sent), np.uint8).reshape(-1, 6)
        _, which, n = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        code = (n > 1).astype(np.uint8) + (n > hot_blocks)
        codes = [c.tobytes() for c in np.split(code[which].astype(np.uint8), np.cumsum(size)[:-1])]
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array(codes, pa.binary())], ["block", "bucket", "codes"])

    anchored = blocks.groupBy("block").applyInArrow(send_hashes, "bucket int, block long, hashes binary")
    codes = written(anchored.groupBy("bucket").applyInArrow(answer_hashes, "block long, bucket int, codes binary"), "suffix-codes")

    def contexts(rows: pa.Table, answers: pa.Table) -> tuple[Block, Contexts]:
        block = Block(rows, length)
        told = {b: np.frombuffer(c, np.uint8) for b, c in zip(answers.column("bucket").to_pylist(), answers.column("codes").to_pylist()) if c is not None}
        return block, block.contexts(told, buckets, buckets)

    def send_contexts(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block, found = contexts(rows, answers)
        out = []
        for _, at in found.dealt:
            shape = np.stack([found.offset[at], found.end[at] - found.start[at]]).astype(np.uint16).tobytes()
            out.append((shape, found.ids[at].tobytes(), b"".join(block.text[s:e] for s, e in zip(found.start[at].tolist(), found.end[at].tolist()))))
        return pa.table([pa.array([b for b, _ in found.dealt], pa.int32()), pa.array([rows.column("block")[0].as_py()] * len(out), pa.int64()),
                         *(pa.array([o[k] for o in out], pa.binary()) for k in range(3))], ["bucket", "block", "shape", "ids", "bytes"])

    def answer_contexts(rows: pa.Table) -> pa.Table:
        least: dict = {}
        sent = []
        for shape, ids, data in zip(*(rows.column(c).to_pylist() for c in ("shape", "ids", "bytes"))):
            offset, size = np.frombuffer(shape, np.uint16).reshape(2, -1).tolist()
            cut = np.cumsum([0, *size]).tolist()
            keys = [(o, data[a:b]) for o, a, b in zip(offset, cut, cut[1:])]
            ids = np.frombuffer(ids, np.int64).tolist()
            for key, i in zip(keys, ids):
                if i < least.get(key, 2**63):
                    least[key] = i
            sent.append((keys, ids))
        best = smaller_copies(least, length)
        bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
        masks = [np.array([bit[:len(best[k])][best[k] < i].sum(dtype=np.uint64) for k, i in zip(keys, ids)], np.uint64).tobytes() for keys, ids in sent]
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array(masks, pa.binary())], ["block", "bucket", "masks"])

    by_block = blocks.groupBy("block")
    asked = by_block.cogroup(codes.groupBy("block")).applyInArrow(send_contexts, "bucket int, block long, shape binary, ids binary, bytes binary")
    masks = asked.groupBy("bucket").applyInArrow(answer_contexts, "block long, bucket int, masks binary")
    told = codes.withColumn("masks", F.lit(None).cast("binary")) \
        .unionByName(masks.withColumn("codes", F.lit(None).cast("binary")))

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block, found = contexts(rows, answers)
        mask = np.zeros(len(found.head), np.uint64)
        known = {b: np.frombuffer(m, np.uint64) for b, m in zip(answers.column("bucket").to_pylist(), answers.column("masks").to_pylist()) if m is not None}
        for bucket, at in found.dealt:
            mask[at] = known[bucket]
        mask = np.where(found.ids > found.ids[found.head], ~np.uint64(0), mask[found.head])
        change = np.zeros(len(block.data) + 1, np.int32)
        for step in range(block.span):
            hit = found.start[(mask >> np.uint64(step) & np.uint64(1) == 1) & (step < found.count)] + step
            np.add.at(change, hit, 1)
            np.add.at(change, hit + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        kept, starts, ends = [], [], []
        for s, e in zip(block.starts.tolist(), block.ends.tolist()):
            own = gone[s:e]
            edges = np.nonzero(np.diff(own.astype(np.int8), prepend=0, append=0))[0]
            starts.append(edges[::2])
            ends.append(edges[1::2])
            kept.append(block.data[s:e][~own].tobytes() if len(edges) else block.text[s:e])
        counts = np.array([len(s) for s in starts])
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (starts, ends)], ["start", "end"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.table([block.rows.column("doc_id"), block.rows.column("n_bytes"), pa.ListArray.from_arrays(offsets, spans), pa.array(kept, pa.binary())],
                        ["doc_id", "n_bytes", "spans", "kept"])

    return blocks.groupBy("block").cogroup(told.groupBy("block")) \
        .applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
