"""Helpers shared by the operators: shared-storage tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship  # noqa: F401 - the operators take ship from here

# Bytes of text which a task looks at together; bounds the memory of the
# numpy work whatever the Arrow batch holds.
CHUNK_BYTES = 4 << 20
WORD = (1 << 32) - 1         # the bits of a word's number in a key


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder which
    ``spark.checkpoint.dir`` names and read it back: cuts the lineage with a
    copy that outlives any executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a document table; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def held_out(id_col: str, modulus: int):
    """True where crc32(id as text) mod ``modulus`` is 0; a null id is
    never held out."""
    return F.coalesce((F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus) == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``max_bytes`` of text;
    one longer text stays whole, in a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends = np.cumsum(size + 16)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def words_of(column: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts once ``table`` has translated their
    bytes, the number of every word in their order, and the words of each text."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if ends[-1] > ends[0] else b""
    texts = pa.Array.from_buffers(pa.string(), len(column), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(raw.translate(table))])
    split = pc.ascii_split_whitespace(texts)
    n, coded = np.asarray(split.value_lengths(), np.int64), split.flatten().dictionary_encode()
    ids, words = np.asarray(coded.indices), coded.dictionary.cast(pa.binary())
    blank = np.asarray(pc.equal(words, b""))            # stands before the first blank and after the last
    if blank.any():
        full = ~blank[ids]
        n = np.bincount(np.repeat(np.arange(len(n)), n)[full], minlength=len(n))
        ids = (np.cumsum(~blank) - 1)[ids[full]]
        words = words.filter(pa.array(~blank))
    return words, ids, n


def united(distinct: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The words of several arrays, each once, and the places there of the words of every array."""
    coded = pa.concat_arrays(distinct).dictionary_encode()
    return coded.dictionary, np.split(np.asarray(coded.indices).astype(np.int64), np.cumsum([len(x) for x in distinct])[:-1])


def added(found: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, with the sums of their numbers (none: 1 each)."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(found) == 1 and found[0][1] is None:
        keys, n = np.sort(found[0][0]), None
    else:
        keys, n = map(np.concatenate, zip(*found))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n, first) if len(first) else n


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each start and length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrow list array from flat values and the number of each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def word_table(kept: bytes) -> bytes:
    """Table for ``bytes.translate``: A-Z in lower case, bytes beyond ASCII and
    those of ``kept`` as they are, blanks for all others; ``split`` then yields
    the words of a text in UTF-8."""
    return bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in kept else 32 for c in range(256))
