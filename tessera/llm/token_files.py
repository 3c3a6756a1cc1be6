"""Token-ID / binary output (5).

A shard holds the ids of consecutive documents in one array and the document
boundaries in Elias-Fano form: the low bits of every offset side by side and
the high bits in unary, so a boundary costs about 2 + log2(mean length) bits.
``select`` finds a boundary from the ones counted before each 64-bit word;
there is no table of 64-bit offsets.  Document ids ascend and are stored the
same way.

Shards are written as a Parquet data set on shared storage, one self-contained
byte string each, by tasks over ascending ranges of ids.

Defined results: a null or empty text holds the end id only; null ids come
first; equal ids are ordered by a hash of the text and all kept; an empty
table gives an empty data set."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import ensure_checkpoint_dir
from .bpe import Memo
from .common import ranges, slices, text_rows

SHARD_IDS = 1 << 21     # ids after which a shard is closed (a longer document stays whole)
MEMO = 3 << 18
MAGIC = b"TSEF"


class EliasFano:
    """A non-decreasing sequence of n numbers below ``universe``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32)   # ones before each word

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        low = values & np.uint64((1 << bits) - 1)
        marks = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-(int(marks[-1]) + 1 if n else 0) // 64) * 64, dtype=np.uint8)
        flags[marks] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        planes = ((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(planes.ravel(), bitorder="little")
        return cls(n, bits, packed, high)

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, n_low, n_high = struct.unpack_from("<QBQQ", raw, at)
        at += struct.calcsize("<QBQQ")
        low = np.frombuffer(raw, np.uint8, n_low, at)
        high = np.frombuffer(raw, "<u8", n_high, at + n_low)
        return cls(n, bits, low, high), at + n_low + 8 * n_high

    def select(self, index: np.ndarray) -> np.ndarray:
        """The numbers at some places: the word that holds the k-th one is
        found by its count, the place inside it by its bits."""
        k = np.asarray(index, dtype=np.int64)
        word = np.searchsorted(self.before, k, side="right") - 1
        bits = np.unpackbits(self.high[word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rank = (k - self.before[word]).astype(np.int64)
        place = np.argmax(np.cumsum(bits, axis=1, dtype=np.int64) > rank[:, None], axis=1)
        high = (word * 64 + place - k).astype(np.uint64)
        low = np.zeros(len(k), dtype=np.uint64)
        for j in range(self.low_bits):
            at = k * self.low_bits + j
            low |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(j)
        return (high << np.uint64(self.low_bits)) | low

    def values(self, step: int = 1 << 16) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64)] + [
            self.select(np.arange(i, min(i + step, self.n))) for i in range(0, self.n, step)])


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Magic, number of null document ids, first document id, width of an
    id, Elias-Fano document ids, Elias-Fano boundaries, ids."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    gaps = (known - first).astype(np.uint64)
    return b"".join([MAGIC, struct.pack("<QqB", len(doc_ids) - len(known), first, width), EliasFano.of(gaps).to_bytes(),
                     EliasFano.of(np.concatenate([[0], np.cumsum(lengths)])).to_bytes(), ids.astype(f"<u{width}").tobytes()])


class Shard:
    """A shard read back: ids of any document by its place."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token shard")
        view = memoryview(raw)
        self.nulls, self.first, width = struct.unpack_from("<QqB", view, 4)
        self.doc_gaps, at = EliasFano.from_bytes(view, 4 + struct.calcsize("<QqB"))
        self.bounds, at = EliasFano.from_bytes(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", offset=at)
        self.n_docs = self.bounds.n - 1

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [int(g) + self.first for g in self.doc_gaps.values()]

    def tokens(self, place: int) -> np.ndarray:
        start, end = self.bounds.select(np.array([place, place + 1]))
        return self.ids[int(start):int(end)]


# Latin letters whose normal and lower-case forms are single letters, and then
# marks (no apostrophe): two pieces under the tokenizer's pattern, so the ids
# are those of both, and those of the letters are those of their lower case.
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+"
_LETTERS = regex.compile(_LATIN).fullmatch
_TAIL = regex.compile(rf"({_LATIN})([!-&(-/:-@\[-`{{-~]+)").fullmatch

_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"     # the marks of the tail

# Signs which byte-level vocabularies write for bytes: printable ones stand
# for themselves, the others follow from 256 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordIds:
    """Ids of whole texts from the library's ids of their cuts at spaces and
    line ends.  The tokenizer drops white space before anything else can
    depend on it, so cuts are independent; they are remembered, and the
    library sees each new one once."""

    def __init__(self, tokenizer: str):
        self.library = Tokenizer.from_str(tokenizer)
        self.model = self.library.model
        self.cuts = Memo(self._ids, MEMO)
        self.cuts[""] = ()

    def _ids(self, cut: str) -> tuple[int, ...]:
        if cut.isascii():       # the two cases below, for the commonest cuts
            if cut.isalpha():
                return tuple([t.id for t in self.model.tokenize(cut.lower())])
            if (head := cut.rstrip(_MARKS)) != cut and head.isalpha():
                return self.cuts[head] + self.cuts[cut[len(head):]]
        if tail := _TAIL(cut):
            return self.cuts[tail[1]] + self.cuts[tail[2]]
        if _LETTERS(cut):
            # one piece in normal form: only the lower case and the merges are left to do
            return tuple([t.id for t in self.model.tokenize(cut.lower().encode().decode("latin-1").translate(_BYTE_SIGNS))])
        return tuple(self.library.encode(cut, add_special_tokens=False).ids)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cuts.__getitem__, text.replace("\n", " ").split(" "))))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts one after another, and where each text begins
        and ends; each distinct cut is looked up once."""
        cuts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = cuts.values.dictionary_encode()
        known = list(map(self.cuts.__getitem__, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        pool = np.fromiter(chain.from_iterable(known), np.uint32, int(sizes.sum()))
        which = np.asarray(coded.indices)
        n = sizes[which]
        ids = pool[ranges((np.cumsum(sizes) - sizes)[which], n)]
        return ids, np.concatenate([[0], np.cumsum(n)])[np.asarray(cuts.offsets)]


_LOCAL: dict[int, WordIds] = {}


def _word_ids(tokenizer: str) -> WordIds:
    """The worker's own encoder of a broadcast tokenizer file."""
    if (key := hash(tokenizer)) not in _LOCAL:
        _LOCAL.clear()
        _LOCAL[key] = WordIds(tokenizer)
    return _LOCAL[key]


SHARD_SCHEMA = "part int, shard int, n_docs long, n_ids long, payload binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, *, end_id: int, path: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> str:
    """Tokenize every text, append ``end_id`` and write the shards in
    ascending order of document ids; returns the path of the data set (in the
    shared folder unless one is given).  ``doc_id`` is a long."""
    rows = text_rows(docs, id_col, text_col)
    # the hash also deals out the rows of one id that many rows share
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, shard = _word_ids(shared.value), TaskContext.get().partitionId(), 0
        doc_ids, lengths, arrays, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            payload = shard_bytes(doc_ids, lengths, np.concatenate(arrays))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(lengths)], pa.int64()),
                 pa.array([total], pa.int64()), pa.array([payload], pa.binary())],
                ["part", "shard", "n_docs", "n_ids", "payload"])

        for batch in slices(batches):
            ids, ends = words.encode_all(batch.column("text"))
            ids = np.insert(ids, ends[1:], end_id)
            ends = ends + np.arange(len(ends))
            names, at = batch.column("doc_id").to_pylist(), 0
            while at < len(names):
                # up to the document that fills the shard
                to = min(len(names), int(np.searchsorted(ends, ends[at] + shard_ids - total)))
                doc_ids += names[at:to]
                lengths += np.diff(ends[at:to + 1]).tolist()
                arrays.append(ids[ends[at]:ends[to]])
                total += int(ends[to] - ends[at])
                at = to
                if total >= shard_ids:
                    yield close()
                    shard += 1
                    doc_ids, lengths, arrays, total = [], [], [], 0
        if lengths:
            yield close()

    path = path or f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    ordered.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned
    32-bit integers).  The starts of shards come from running sums over the
    parts and inside each part, one row a shard."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")) \
        .select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    starts = sizes.withColumn("inside", inside).join(parts, F.col("part") == F.col("p")) \
        .select(F.col("part").alias("s_part"), F.col("shard").alias("s_shard"), (F.col("part_start") + F.col("inside")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column("payload")):
                one = Shard(raw.as_py())
                bounds = one.bounds.values().astype(np.int64)
                ids = one.ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                n = one.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("part")[k].as_py()] * n, pa.int32()), pa.array([batch.column("shard")[k].as_py()] * n, pa.int32()),
                     pa.array(one.doc_ids(), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "shard", "payload").mapInArrow(
        run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, (F.col("part") == F.col("s_part")) & (F.col("shard") == F.col("s_shard"))) \
        .select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
