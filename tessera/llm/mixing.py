"""LM scoring (2): online logistic mixing of hashed-context bit predictors.

The model's text is the token sequence: words in lower case, each closed by a
space, and an end byte.  A byte is a path of binary decisions in a Huffman
tree.  Predictors of several orders look at the bytes before it inside the
word; each hashes context and tree node to a slot with the numbers of zeros
and ones seen there.  Their stretched probabilities are added with weights
which a gate selects (how well the longest contexts are known, and whether a
word begins).  The weights are learnt online over the vocabulary with the
word itself left out of its counts, for several emphases between tokens and
types; a document then starts with all emphases alike and shifts between them
after every block of tokens by what they foresaw, so mixing stays adaptive
and the probabilities of all texts add up to one.

A text first names its script (a class by its commonest character beyond
ASCII), and most contexts hold the script.

Inside a word, counts over the vocabulary are counts over all training text,
and a word of a script costs work once however often it occurs.  What follows
what is counted over the training texts: every pair of a word (or a text's
begin) and the next (or the end), none left out.  Two further predictors mix
the share of a pair among all that follows its first word with the next word's
own probability, which counts the more the rarer the first word is; a
document shifts between these and the predictors that see no word before.

The short contexts have a fixed number of slots,
whatever the corpus, which can be broadcast.  Contexts of the whole word so
far grow with the vocabulary, of which none is left out: it is sorted and cut
into pages, and every page has slots of its own.  Words that share a context
lie together, so that only what begins the first or the last word of a page
goes on in others; those few contexts are summed over all pages.

Words, their probabilities and pairs grow with the corpus and stay in tables.
Texts are cut into slices, whose tokens are numbers of words.  A slice takes
frequent words (at most ``HOT_WORDS``) from a broadcast and joins all others,
each once; it sends each of its pairs once, as a hash of 48 bits, with other
pairs of that share of the hashes, and the numbers come back in the same order.

Defined results: a null or empty text is the end token alone; without
training rows the model is uniform over tree decisions and the base score is
0; repeated rows stay."""

from __future__ import annotations

import heapq
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, added, as_bytes, ensure_checkpoint_dir, held_out, list_array, ranges, slices, text_rows, united, words_of, written

MODULUS = 10
ADD = 0.1
HOT_WORDS = 200_000
PAGE_WORDS = 32_768         # words of a page of the vocabulary, about
PAGE_BYTES = 1 << 20
LEARN_PAGES = 8             # pages from all over the vocabulary that are learnt from together, about, and at most
MOST_PAGES = 24
BATCH_WORDS = 65_536        # words that a task hands on together
SCORE_WORDS = 1024          # words that are scored together
FLUSH = 500_000             # numbers of words that a task holds before it hands them on
ORDERS = (2, 3, 4, 6, 0)     # bytes of context inside the word; 0: all of the word so far
SLOT_BITS = (18, 20, 21, 22, 20)     # the last for each page
SCRIPTS = 16
SCRIPT_SHARE = 200          # one character beyond ASCII in so many bytes makes a script
BLOCK_SLOTS = 4096
EMPHASES = (1.0, 0.4)       # powers of a word's count that weigh it in learning
GATES = 96
PAD = max(ORDERS)
NEAREST, WHOLE = ORDERS.index(3), ORDERS.index(0)
TURN = 32                   # tokens between two shifts of a document's emphases
SHARE = 0.02
PAIR_POWERS = (0.5, 0.8)    # of the first word's number that the second word's own probability counts, one for each emphasis
PAIR_BITS = 48
PART_TOKENS = 1 << 23       # tokens whose pairs one task adds up, about
TEXT_BYTES = 4 << 20        # of text in a slice
KEEP = 0.98                 # of the curvature summed before a step
STEP_BYTES = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = b""                  # the end token's key in word tables
_START = np.uint64(0xA0761D6478BD642F)      # stands before a text's first word
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
_LOG = np.log(np.arange(1 << 16) + 0.4).astype(np.float32)


# --- the code tree ---------------------------------------------------------

@dataclass
class Tree:
    """Huffman paths: for each byte its first place, its length, and at each
    place the inner node and the bit."""

    first: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(counts: np.ndarray) -> Tree:
    """Every byte gets a path, those never seen too."""
    heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    fresh = 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (fresh, 0), (fresh, 1)
        heapq.heappush(heap, (a + b, fresh, fresh))
        fresh += 1
    paths = []
    for b in range(256):
        path, at = [], b
        while at in parent:
            at, bit = parent[at]
            path.append((at - 256, bit))
        paths.append(path[::-1])
    length = np.array([len(p) for p in paths])
    flat = np.array([x for p in paths for x in p])
    return Tree(np.cumsum(length) - length, length, flat[:, 0].astype(np.uint64), flat[:, 1].astype(np.int8))


def word_hashes(words: list[bytes], scripts: np.ndarray, tree: Tree, orders: tuple = ORDERS):
    """The binary decisions of some words: hashes of context and node (one row
    per order), bits, whether each belongs to a word's first byte, and the
    decisions of each word."""
    spelled = [w + b" " if w != _END else b"\n" for w in words]
    size = np.array([len(w) for w in spelled])
    raw = np.frombuffer(b"".join([bytes(PAD) + w for w in spelled]), dtype=np.uint8)
    at = ranges(np.cumsum(size + PAD) - size, size)
    byte = raw[at]
    n = tree.length[byte]
    place = ranges(tree.first[byte], n)
    node, bit = tree.node[place], tree.bit[place]
    wide, context, hashes, order = raw.astype(np.uint64), np.zeros(len(at), np.uint64), [], 0
    of_script, of_node = np.repeat(scripts.astype(np.uint64) * _M2, size), node * _M2
    for k in orders:
        while order < k:
            order += 1
            context |= wide[at - order] << np.uint64(8 * (order - 1))
        if not k:                               # sums of all bytes so far, each times a number for its place
            place_in = (at - np.repeat(np.cumsum(size + PAD) - size, size)).astype(np.uint64)
            mixed = (wide[at] + np.uint64(1)) * ((place_in + np.uint64(1)) * _M2 ^ (place_in << np.uint64(40)) | np.uint64(1))
            mixed = (mixed ^ mixed >> np.uint64(29)) * _M1
            run = np.cumsum(mixed) - mixed
            context = run - np.repeat(run[np.cumsum(size) - size], size)
        h = (context + np.uint64(k)) * _M1
        h += of_script
        h = (h ^ h >> np.uint64(30)) * _M1
        h ^= h >> np.uint64(31)
        h = np.repeat(h, n)
        h += of_node
        h *= _M1
        hashes.append(h)
    begins = np.zeros(len(at), bool)
    begins[np.cumsum(size) - size] = True
    return hashes, bit, np.repeat(begins, n), np.add.reduceat(n, np.cumsum(size) - size) if len(size) else size


def _slot(h: np.ndarray, order: int) -> np.ndarray:
    slot = (h >> np.uint64(64 - SLOT_BITS[order])).view(np.int64)
    slot += _OFFSETS[order]
    return slot


def word_bits(words: list[bytes], scripts: np.ndarray, tree: Tree):
    """``word_hashes`` as slots."""
    hashes, bit, begins, n = word_hashes(words, scripts, tree)
    return [_slot(h, k) for k, h in enumerate(hashes)], bit, begins, n


def features(slots, bit, begins, table: np.ndarray, left_out: bool):
    """Stretched predictions and gate of each decision: how often the two
    longest contexts were seen, whether always with the same bit and for how
    long alone, whether a middle one was seen, whether a word begins.  ``left_out`` takes
    one occurrence of the decision itself out of its counts."""
    x = np.empty((len(bit), len(ORDERS)), dtype=np.float32)
    known, mixed_in, one = {}, {}, bit == 1
    both = table.view("<u4").ravel()                        # zeros and ones of a slot lie together
    for k, slot in enumerate(slots):
        pair = both.take(slot)
        n0, n1 = (pair & 0xFFFF).astype(np.uint16), (pair >> 16).astype(np.uint16)
        if left_out:
            n1 -= one & (n1 > 0)
            n0 -= ~one & (n0 > 0)
        np.subtract(_LOG.take(n1), _LOG.take(n0), out=x[:, k])
        if k in (NEAREST, WHOLE - 1, WHOLE):
            known[k] = n0.astype(np.int32) + n1
            mixed_in[k] = (n0 > 0) & (n1 > 0)
    n = known[WHOLE]
    turn = np.ones(len(n), bool)                            # the count changed: words part here
    turn[1:] = (n[1:] != n[:-1]) | (begins[1:] & ~begins[:-1])
    at = np.arange(len(n))
    chain = np.digitize(at - np.maximum.accumulate(np.where(turn, at, 0)), (1, 8))
    whole = np.where(n == 0, 0, np.where(mixed_in[WHOLE], np.where(n < 16, 1, 2), np.where(n < 3, 3 + chain, 6 + (chain == 2))))
    longest = np.where(known[WHOLE - 1] == 0, 0, 1 + mixed_in[WHOLE - 1])
    gate = whole * 6 + longest * 2 + (known[NEAREST] > 0) + 48 * begins
    return x, gate


# --- learning --------------------------------------------------------------

def scripts_of(texts: list[bytes]) -> np.ndarray:
    """The script of each text: a hash of its commonest character beyond
    ASCII, 0 where such are rare.  A text is scored with the probability of
    its script as a first symbol, so the choice is paid for."""
    raw = np.frombuffer(b"".join(texts) + bytes(4), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(size)
    at = np.flatnonzero(raw >= 0xC0)
    out = np.zeros(len(texts), dtype=np.int32)
    if not len(at):
        return out
    wide = raw.astype(np.uint32)
    char = wide[at] << 8 | wide[at + 1]
    char = np.where(wide[at] >= 0xE0, wide[at] << 8, char)       # three and four bytes: by the lead
    char = np.where((char >= 0xC3A0) & (char <= 0xC3BE), char - 32, char)   # accented letters in one case
    of = np.searchsorted(ends, at, side="right")
    pairs, n = np.unique(of.astype(np.int64) << 20 | char, return_counts=True)
    order = np.lexsort((pairs, -n, pairs >> 20))
    pairs, n = pairs[order], n[order]
    first = np.concatenate([[True], (pairs[1:] >> 20) != (pairs[:-1] >> 20)])
    doc, char, total = pairs[first] >> 20, pairs[first] & 0xFFFFF, np.bincount(of, minlength=len(texts))
    common = total[doc] * SCRIPT_SHARE >= size[doc]
    out[doc[common]] = 1 + (char[common] * 2654435761 % (1 << 32) >> 7) % (SCRIPTS - 1)
    return out


def _counted(rows: DataFrame, modulus: int) -> DataFrame:
    """(word, script, c): all words with their number in training texts,
    summed in tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct: list[pa.Array] = []               # words of each slice
        found: list[tuple[np.ndarray, np.ndarray]] = []         # (script << 32 | word, number) of each slice
        ends = np.zeros((2, SCRIPTS), np.int64)     # texts, training texts

        def out():
            if not distinct:
                return
            words, places = united(distinct)
            keys, n = added([(keys & ~WORD | at[keys & WORD], n) for at, (keys, n) in zip(places, found)])
            some = np.flatnonzero(ends[0])
            distinct.clear()
            found.clear()
            for a in range(0, len(keys), BATCH_WORDS):
                at = keys[a:a + BATCH_WORDS]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(at & WORD)), pa.array((at >> 32).astype(np.int32)), pa.array(n[a:a + BATCH_WORDS])], _COUNTS)
            yield pa.RecordBatch.from_arrays([pa.array([_END] * len(some), pa.binary()), pa.array(some.astype(np.int32)), pa.array(ends[1, some])], _COUNTS)
            ends[:] = 0
            pa.default_memory_pool().release_unused()

        for part in slices(batches):
            words, ids, size = words_of(part.column("text"), _LOWER)
            scripts, trains = scripts_of(as_bytes(part.column("text"))), ~np.asarray(part.column("other").to_pylist(), bool)
            ends[0] += np.bincount(scripts, minlength=SCRIPTS)
            ends[1] += np.bincount(scripts, trains, SCRIPTS).astype(np.int64)
            distinct.append(words)
            # the lowest bit: whether the word is one of a training text
            keys, n = added([(np.repeat(scripts.astype(np.int64) << 33 | trains, size) | ids.astype(np.int64) << 1, None)])
            found.append(added([(keys >> 1, n * (keys & 1))]))
            if sum(len(keys) for keys, _ in found) > FLUSH:
                yield from out()
        yield from out()

    return rows.select("text", held_out("doc_id", modulus).alias("other")).mapInArrow(run, "word binary, script int, n long") \
        .groupBy("word", "script").agg(F.sum("n").alias("c"))


def _paged(counted: DataFrame) -> DataFrame:
    """Rows of lists: the words in their order, their scripts and numbers, the
    numbers in all scripts, and whether it is the word's first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def out():
            if held:
                page = pa.Table.from_batches(held).combine_chunks()
                ends = pa.array([0, page.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c.chunk(0)) for c in page.columns], page.column_names)
                held.clear()

        for part in slices(batches, "word", PAGE_BYTES):
            n_bytes = sum(map(len, part.column("word").to_pylist()))
            if rows + part.num_rows > PAGE_WORDS or size + n_bytes > PAGE_BYTES:
                yield from out()
                rows = size = 0
            held.append(part)
            rows, size = rows + part.num_rows, size + n_bytes
        yield from out()

    word = Window.partitionBy("word")
    rows = counted.repartitionByRange("word").select(
        "word", "script", "c", F.sum("c").over(word).alias("all_c"), (F.row_number().over(word.orderBy("script")) == 1).alias("first"))
    return rows.mapInArrow(run, "word array<binary>, script array<int>, c array<long>, all_c array<long>, first array<boolean>")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Words, scripts, numbers and all columns of every page."""
    for batch in batches:
        for i in range(batch.num_rows):
            page = pa.RecordBatch.from_arrays([c[i].values for c in batch.columns], batch.schema.names)
            yield page.column("word").to_pylist(), np.asarray(page.column("script")), np.asarray(page.column("c")), page


def _byte_counts(pages: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for words, _, c, _ in _pages(batches):
            c = c.astype(np.float64)
            size = np.array([len(w) for w in words])
            total += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(c, size), 256)
            total[32] += c[size > 0].sum()
            total[10] += c[size == 0].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    rows = pages.mapInArrow(run, "byte long, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(256)
    for r in rows:
        out[r.byte] = r.n
    return out


def add_words(table: np.ndarray, words: list[bytes], scripts: np.ndarray, c: np.ndarray, tree: Tree, whole: bool) -> None:
    """Add words to the numbers of zeros and ones of all slots, those of the
    whole word on demand.  The orders count a word by the root of its number,
    so that rare words have a say in how words are built; the whole-word
    contexts count every token."""
    root = np.ceil(np.sqrt(c)).astype(np.int64)
    orders = ORDERS if whole else ORDERS[:WHOLE]
    hashes, bit, _, n = word_hashes(words, scripts, tree, orders)
    flat, roots = table.reshape(-1), np.repeat(root, n)
    for k, order in enumerate(orders):
        np.add.at(flat, 2 * _slot(hashes[k], k) + bit, roots if order > 0 else np.repeat(c, n))


def on_edges(words: list[bytes], tree: Tree) -> np.ndarray:
    """Decisions of a page in contexts that other pages may hold too: what
    stands before them begins the first word of the page or its last."""
    spelled = [w + b" " if w != _END else b"\n" for w in words]
    size = np.array([len(w) for w in spelled])
    raw = np.frombuffer(b"".join(spelled), np.uint8)
    start = np.cumsum(size) - size
    place, out = ranges(np.zeros(len(size), np.int64), size), np.zeros(len(raw), bool)
    for edge in (spelled[0], spelled[-1]):
        like = np.zeros(size.max(), np.uint8)
        like[:len(edge)] = np.frombuffer(edge, np.uint8)
        other = raw != like[place]
        before = np.cumsum(other) - other
        out |= before == np.repeat(before[start], size)
    return np.repeat(out, tree.length[raw])


def edge_counts(h: np.ndarray, bit: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their numbers of zeros and ones."""
    keys, of = np.unique(h, return_inverse=True)
    return keys, np.bincount(2 * of + bit, each, 2 * len(keys)).astype(np.int64).reshape(-1, 2)


def whole_slots(words: list[bytes], scripts: np.ndarray, c: np.ndarray, tree: Tree, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Zeros and ones of the slots of a page.  ``edges`` has hashes, in order,
    that several pages hold and their numbers in all pages."""
    (h,), bit, _, n = word_hashes(words, scripts, tree, (0,))
    each, base = np.repeat(c, n), _OFFSETS[WHOLE]
    pair = np.bincount(2 * (_slot(h, WHOLE) - base) + bit, each, 2 << SLOT_BITS[WHOLE]).reshape(-1, 2)
    edge = on_edges(words, tree)
    keys, own = edge_counts(h[edge], bit[edge], each[edge])
    if len(edges[0]):
        at = np.minimum(np.searchsorted(edges[0], keys), len(edges[0]) - 1)
        found = edges[0][at] == keys
        np.add.at(pair, _slot(keys[found], WHOLE) - base, edges[1][at[found]] - own[found])
    return _scaled(pair)


def _slot_table(pages: DataFrame, shared_tree) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Zeros and ones of every slot of the short contexts over the vocabulary,
    as 16-bit numbers, and the contexts on the edges of pages.  A task sums its
    words into a table of fixed size and hands on blocks of it; blocks are
    summed where they meet."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tree = np.zeros((_OFFSETS[-1], 2), dtype=np.int64), shared_tree.value
        for words, scripts, c, _ in _pages(batches):
            add_words(table, words, scripts, c, tree, False)
        blocks = table.reshape(-1, 2 * BLOCK_SLOTS)
        for b in np.flatnonzero(blocks.any(axis=1)):
            small = blocks[b].max() < 1 << 32
            raw = b"4" + blocks[b].astype(np.uint32).tobytes() if small else b"8" + blocks[b].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([raw], pa.binary())], ["block", "counts"])

    def on_edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared_tree.value
        for words, scripts, c, _ in _pages(batches):
            edge = on_edges(words, tree)
            (h,), bit, _, n = word_hashes(words, scripts, tree, (0,))
            keys, pair = edge_counts(h[edge], bit[edge], np.repeat(c, n)[edge])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["h", "n0", "n1"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in batches:
            for b, raw in zip(part.column("block").to_pylist(), part.column("counts")):
                raw = raw.as_py()
                counts = np.frombuffer(raw, np.uint32 if raw[:1] == b"4" else np.int64, offset=1).astype(np.int64)
                held[b] = held[b] + counts if b in held else counts
        for b, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([_scaled(counts.reshape(-1, 2)).tobytes()], pa.binary())],
                                             ["block", "counts"])

    schema = "block long, counts binary"
    rows = pages.mapInArrow(sums, schema).repartition("block").mapInArrow(meet, schema).toLocalIterator()
    table = np.zeros((_OFFSETS[-1], 2), dtype=np.uint16)
    for r in rows:
        table[r.block * BLOCK_SLOTS:(r.block + 1) * BLOCK_SLOTS] = np.frombuffer(r.counts, np.uint16).reshape(-1, 2)
    met = pages.mapInArrow(on_edge, "h long, n0 long, n1 long") \
        .groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("pages")).where("pages > 1").toArrow()
    keys = np.asarray(met.column("h")).astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return table, (keys[order], np.column_stack([met.column("n0"), met.column("n1")]).astype(np.int64).reshape(-1, 2)[order])


def _scaled(pair: np.ndarray) -> np.ndarray:
    """Counts in 16 bits, their ratio kept."""
    top = np.maximum(pair[:, 0], pair[:, 1])
    big = np.flatnonzero(top > 65535)
    out = np.minimum(pair, 65535).astype(np.uint16)
    out[big] = np.ceil(pair[big] / (top[big] / 65535.0)[:, None]).astype(np.uint16)
    return out


class Learner:
    """Online Newton steps for every emphasis and gate: curvature is summed
    with a slow decay, so early steps are bold and late ones are averages."""

    def __init__(self):
        self.w = start_weights()
        self.curve = np.zeros((len(EMPHASES), GATES, len(ORDERS), len(ORDERS)))
        self.seen = 0

    def step(self, words: list[bytes], scripts: np.ndarray, c: np.ndarray, tree: Tree, table: np.ndarray, page: np.ndarray | int = 0) -> None:
        """``page`` tells which of the whole-word tables, one behind the other, is a word's."""
        slots, bit, begins, n = word_bits(words, scripts, tree)
        slots[WHOLE] += np.repeat(np.broadcast_to(page, len(words)) << SLOT_BITS[WHOLE], n)
        x, gate = features(slots, bit, begins, table, True)
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        x, bit, each, gate = x[order].astype(np.float64), bit[order], np.repeat(c, n)[order], gate[order]
        cuts = np.searchsorted(gate, np.arange(GATES + 1))
        self.seen += len(bit)
        for m, power in enumerate(EMPHASES):
            weigh = (each ** power).astype(np.float32)
            for g in range(GATES):
                a, b = cuts[g], cuts[g + 1]
                if a == b:
                    continue
                part, w = x[a:b], self.w[m, g]
                p = 1 / (1 + np.exp(-np.clip(part @ w, -14, 14)))
                slope = part.T @ (weigh[a:b] * (bit[a:b] - p))
                bent = (part * (weigh[a:b] * np.maximum(p * (1 - p), 0.002))[:, None]).T @ part
                curve = self.curve[m, g] = KEEP * self.curve[m, g] + bent
                ridge = 0.001 * np.trace(curve) + 1e-6
                move = np.linalg.solve(curve + ridge * np.eye(len(ORDERS)), slope)
                self.w[m, g] = w + move * min(1.0, 1.0 / (np.abs(move).max() + 1e-9))


def _weights(pages: DataFrame, shared_tree, shared_table, shared_edges) -> np.ndarray:
    """Weights by emphasis, gate and order: every task learns online over the
    words of some pages in mixed order, as words of one page begin alike; the
    mean over the tasks is taken by the decisions they saw."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, tree, held = Learner(), shared_tree.value, []

        def learn():
            words = [w for part in held for w in part[0]]
            scripts, c = (np.concatenate([part[k] for part in held]) for k in (1, 2))
            page = np.repeat(np.arange(len(held)), [len(part[0]) for part in held])
            table = np.concatenate([shared_table.value[:_OFFSETS[WHOLE]], *(whole_slots(*part, tree, shared_edges.value) for part in held)])
            order = np.random.default_rng(len(words)).permutation(len(words))
            order = order[c[order] > 0]
            ends = np.cumsum(np.array([len(words[i]) + 16 for i in order], np.int64))
            for at in np.split(order, np.flatnonzero(np.diff(ends // STEP_BYTES)) + 1) if len(order) else ():
                learner.step([words[i] for i in at], scripts[at], c[at].astype(np.float64), tree, table, page[at])
            held.clear()

        for words, scripts, c, _ in _pages(batches):
            held.append((words, scripts, c))
            if len(held) == MOST_PAGES:
                learn()
        if held:
            learn()
        yield pa.RecordBatch.from_arrays([pa.array([learner.seen], pa.int64()), list_array(learner.w.ravel(), np.array([learner.w.size]))], ["seen", "w"])

    groups = max(1, round(pages.count() / LEARN_PAGES))
    rows = pages.repartition(groups).mapInArrow(run, "seen long, w array<double>").where("seen > 0") \
        .select("seen", F.posexplode("w").alias("at", "v")) \
        .groupBy("at").agg((F.sum(F.col("v") * F.col("seen")) / F.sum("seen")).alias("v")).collect()
    w = start_weights()
    for r in rows:
        w.reshape(-1)[r["at"]] = r["v"]
    return w.astype(np.float32)


def start_weights() -> np.ndarray:
    return np.full((len(EMPHASES), GATES, len(ORDERS)), 0.25)


@dataclass
class Model:
    tree: Tree
    weights: np.ndarray
    script_logs: np.ndarray
    table: np.ndarray | None = None     # of the page at hand

    def words(self, words: list[bytes], scripts: np.ndarray) -> np.ndarray:
        """Log probability of each word in its script under each emphasis."""
        out = np.empty((len(EMPHASES), len(words)))
        for a in range(0, len(words), SCORE_WORDS):
            some = words[a:a + SCORE_WORDS]
            slots, bit, begins, n = word_bits(some, scripts[a:a + SCORE_WORDS], self.tree)
            x, gate = features(slots, bit, begins, self.table, False)
            sign = (1 - 2 * bit).astype(np.float32)
            for m, w in enumerate(self.weights):
                z = np.clip(np.einsum("ij,ij->i", x, w[gate]), -14, 14)
                out[m, a:a + len(some)] = np.add.reduceat(-np.log1p(np.exp(z * sign)), np.cumsum(n) - n)
        return out


def mixture(sums: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Log probability of token sequences from those of their blocks of tokens
    under each predictor (a row each): a mixture of the predictors that shifts
    after each block."""
    m = len(sums)
    at_block = np.cumsum(blocks) - blocks
    order = np.argsort(-blocks, kind="stable")
    mix = np.full((m, len(blocks)), -np.log(m))
    total = np.zeros(len(blocks))
    for k in range(int(blocks.max()) if len(blocks) else 0):
        live = order[:np.searchsorted(-blocks[order], -k, side="left")]
        joint = mix[:, live] + sums[:, at_block[live] + k]
        top = joint.max(axis=0)
        log = top + np.log(np.exp(joint - top).sum(axis=0))
        total[live] += log
        mix[:, live] = np.log((1 - SHARE) * np.exp(joint - log) + SHARE / m)
    return total


# --- pairs of words --------------------------------------------------------

def word_keys(words: list[bytes]) -> np.ndarray:
    """A number of 64 bits for each word."""
    spelled = [w + b" " if w != _END else b"\n" for w in words]
    size = np.array([len(w) for w in spelled], np.int64)
    if not len(size):
        return np.zeros(0, np.uint64)
    place = ranges(np.zeros(len(size), np.int64), size).astype(np.uint64)
    mixed = (np.frombuffer(b"".join(spelled), np.uint8).astype(np.uint64) + np.uint64(1)) * ((place + np.uint64(1)) * _M2 ^ (place << np.uint64(40)) | np.uint64(1))
    total = np.add.reduceat((mixed ^ mixed >> np.uint64(29)) * _M1, np.cumsum(size) - size)
    return (total ^ total >> np.uint64(31)) * _M2


def pair_keys(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of each token and the one before, from the numbers of the words
    at all tokens and the places where texts begin."""
    h = np.empty_like(keys)
    h[1:] = keys[:-1]
    h[starts] = _START
    h ^= h >> np.uint64(31)
    h *= _M1
    h += keys
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h >> np.uint64(64 - PAIR_BITS)


def packed(x: np.ndarray) -> bytes:
    """Numbers by their first bytes, their second bytes and so on, compressed."""
    return np.int64(len(x)).tobytes() + pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    n, width = int(np.frombuffer(raw, np.int64, 1)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, "zstd", asbytes=True) if n else b"", np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pair_numbers(slices_: DataFrame, shared_hot_keys, bits: int) -> DataFrame:
    """(slice, part, n): how often training texts hold each distinct pair of a
    slice, in the order of the hashes."""
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, h, n_tokens = _slice_pairs(batch, row, shared_hot_keys.value)
                h <<= np.uint64(1)
                h |= np.repeat(np.asarray(batch.column("trains")[row].values), n_tokens).astype(np.uint64)
                h.sort()
                keys, of_training = h >> np.uint64(1), (h & np.uint64(1)).astype(np.uint32)
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                keys, n = keys[first], np.add.reduceat(of_training, first).astype(np.uint32)
                cuts = np.searchsorted(keys >> np.uint64(PAIR_BITS - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                some = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in some], pa.int32()), pa.array([batch.column("slice")[row].as_py()] * len(some), pa.int64()),
                     pa.array([packed(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in some], pa.binary()),
                     pa.array([packed(n[a:b]) for _, a, b in some], pa.binary())], ["part", "slice", "keys", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def out():
            keys, n = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            fresh = np.append(True, ordered[1:] != ordered[:-1])
            total = np.add.reduceat(n[order], np.flatnonzero(fresh), dtype=np.uint64)
            answer = np.empty(len(keys), np.uint64)
            answer[order] = total[np.cumsum(fresh) - 1]
            ends = np.cumsum([len(x[1]) for x in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in held], pa.int64()), pa.array([part] * len(held), pa.int32()),
                 pa.array([packed(answer[a:b]) for a, b in zip(np.append(0, ends[:-1]), ends)], pa.binary())], ["slice", "part", "n"])
            held.clear()
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("part")[row].as_py() != part:
                    if held:
                        yield from out()
                    part = batch.column("part")[row].as_py()
                keys = np.cumsum(unpacked(batch.column("keys")[row].as_py(), "u8"), dtype=np.uint64)
                held.append((batch.column("slice")[row].as_py(), keys, unpacked(batch.column("n")[row].as_py(), "u4")))
        if held:
            yield from out()

    return slices_.mapInArrow(sent, "part int, slice long, keys binary, n binary").repartition("part").sortWithinPartitions("part") \
        .mapInArrow(summed, "slice long, part int, n binary")


def _slice_pairs(batch: pa.RecordBatch, row: int, hot_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' numbers at all tokens of a slice, the hashes of pairs there, and the tokens of each text."""
    tokens, spot = unpacked(batch.column("tokens")[row].as_py(), "u4"), unpacked(batch.column("spots")[row].as_py(), "i4")
    keys = hot_keys[spot]
    keys[spot < 0] = unpacked(batch.column("keys")[row].as_py(), "u8")
    n_tokens = np.asarray(batch.column("n_tokens")[row].values)
    return tokens, pair_keys(keys[tokens], np.cumsum(n_tokens) - n_tokens), n_tokens


# --- scoring ---------------------------------------------------------------

_LOGS = [f"log_{m}" for m in range(len(EMPHASES))]


def _scored_words(pages: DataFrame, shared_model, shared_table, shared_edges) -> DataFrame:
    """(word, script, c, all_c, first, log_...): the log probability of every
    word in its script under each emphasis."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = shared_model.value
        lm.table = shared_table.value.copy()
        for words, scripts, c, page in _pages(batches):
            lm.table[_OFFSETS[WHOLE]:] = whole_slots(words, scripts, c, lm.tree, shared_edges.value)
            logs = lm.words(words, scripts)
            yield pa.RecordBatch.from_arrays([*page.columns, *map(pa.array, logs)], [*page.schema.names, *_LOGS])

    return pages.mapInArrow(run, "word binary, script int, c long, all_c long, first boolean, " + ", ".join(f"{name} double" for name in _LOGS))


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = MODULUS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10), bits_per_byte (of the model's
    text)."""
    rows = text_rows(docs, id_col, text_col)
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    counted = written(_counted(rows, modulus), "lm-counts")
    ends = {r.script: r.c for r in counted.where(F.col("word") == F.lit(_END)).collect()}
    share = np.array([ends.get(k, 0) + 1.0 for k in range(SCRIPTS)])
    pages = written(_paged(counted), "lm-pages")
    tree = huffman(_byte_counts(pages))
    shared_tree = sc.broadcast(tree)
    table, edges = _slot_table(pages, shared_tree)
    shared_table, shared_edges = sc.broadcast(table), sc.broadcast(edges)
    model = sc.broadcast(Model(tree, _weights(pages, shared_tree, shared_table, shared_edges), np.log(share / share.sum())))
    scored = written(_scored_words(pages, model, shared_table, shared_edges), "lm-words")
    words = scored.where("first and all_c > 0")
    size = words.agg(F.coalesce(F.sum("all_c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    scale = float(np.log10(size.n + ADD * (size.v + 1)))
    steps = words.groupBy(F.floor(F.log2("all_c") * 4).alias("s")).agg(F.count("*").alias("n"), F.min("all_c").alias("c")).collect()
    least, above = None, 0                      # the least count that no more than HOT_WORDS words reach
    for r in sorted(steps, key=lambda r: -r.s):
        above += r.n
        if above > HOT_WORDS:
            break
        least = r.c
    hot = scored.where(F.lit(False) if least is None else F.col("all_c") >= F.lit(least))
    place, hot_c, hot_logs = {}, array("q"), array("d")
    for r in hot.select("word", "script", "all_c", *_LOGS).toLocalIterator():
        place[bytes(r.word) + bytes([r.script])] = len(place)
        hot_c.append(r.all_c)
        hot_logs.extend(r[3:])
    names = iter(place)
    hot_keys = [word_keys([key[:-1] for key in islice(names, SCORE_WORDS)]) for _ in range(0, len(place), SCORE_WORDS)]
    shared_place, shared_hot_keys = sc.broadcast(place), sc.broadcast(np.concatenate([*hot_keys, word_keys([_END])]))
    # the place after all others is for words that are joined
    hot_c.append(0)
    hot_logs.extend([0.0] * len(EMPHASES))
    shared_hot = sc.broadcast((np.array(hot_c, np.int64), np.array(hot_logs).reshape(-1, len(EMPHASES)).T.copy()))
    n_texts = int(sum(ends.values()))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row of kind 0 is a slice with its tokens, one of kind 1 a word of it that is not frequent and its place
        serial, known = TaskContext.get().partitionId() << 33, shared_place.value
        for part in slices(batches, max_bytes=TEXT_BYTES):
            distinct, inner, size = words_of(part.column("text"), _LOWER)
            spelled = [*distinct.to_pylist(), _END]
            scripts = scripts_of(as_bytes(part.column("text")))
            n_tokens, n = size + 1, len(size)
            ids = np.full(int(n_tokens.sum()), len(distinct), np.int64)
            inside = np.ones(len(ids), bool)
            inside[np.cumsum(n_tokens) - 1] = False
            ids[inside] = inner
            n_bytes = np.add.reduceat(np.array([len(w) + 1 for w in spelled])[ids], np.cumsum(n_tokens) - n_tokens)
            ids += np.repeat(scripts.astype(np.int64) * len(spelled), n_tokens)
            met = np.zeros(SCRIPTS * len(spelled), bool)        # words by script
            met[ids] = True
            ids, met = (np.cumsum(met) - 1)[ids], np.flatnonzero(met)
            spelled, script_of = [spelled[i] for i in met % len(spelled)], (met // len(spelled)).astype(np.int32)
            spot = np.array([known.get(w + _TAILS[s], -1) for w, s in zip(spelled, script_of.tolist())], dtype=np.int32)
            rare = np.flatnonzero(spot < 0)
            rare_words = [spelled[i] for i in rare]
            lists = [list_array(x, np.array([n])) for x in (n_tokens, n_bytes.astype(np.int64), scripts.astype(np.int32))]
            trains = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(~np.asarray(part.column("other").to_pylist(), bool)))
            doc_ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([part.column("doc_id")]))
            blobs = [pa.array([packed(x)], pa.binary()) for x in (ids.astype(np.uint32), spot, word_keys(rare_words))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([serial], pa.int64()), doc_ids, *lists, trains, *blobs,
                 pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32())], _COLUMNS)
            k = len(rare)
            if k:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(k, np.int32)), pa.array(np.full(k, serial, np.int64)), pa.nulls(k, doc_ids.type), *(pa.nulls(k, x.type) for x in (*lists, trains)),
                     *[pa.nulls(k, pa.binary())] * 3, pa.array(rare_words, pa.binary()), pa.array(script_of[rare]), pa.array(rare.astype(np.int32))], _COLUMNS)
            serial += 1
            pa.default_memory_pool().release_unused()

    # in buckets of slices, so that the tokens are never shuffled
    name = f"lm_texts_{uuid.uuid4().hex}"
    rows.select("doc_id", "text", held_out("doc_id", modulus).alias("other")).mapInArrow(
        run, f"kind int, slice long, doc_ids array<{id_type}>, n_tokens array<long>, n_bytes array<long>, scripts array<int>, trains array<boolean>, "
             "tokens binary, spots binary, keys binary, word binary, script int, place int") \
        .write.partitionBy("kind").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice") \
        .option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    both = spark.table(name)
    of_slices = both.where("kind = 0").select("slice", "doc_ids", "n_tokens", "n_bytes", "scripts", "trains", "tokens", "spots", "keys")
    rare = both.where("kind = 1").select("word", "script", "slice", "place") \
        .join(scored.select("word", "script", "all_c", *_LOGS), ["word", "script"]) \
        .groupBy("slice").agg(F.collect_list(F.struct("place", "all_c", *_LOGS)).alias("rare"))
    bits = max(0, int(size.n) // PART_TOKENS).bit_length()
    met = _pair_numbers(of_slices.drop("doc_ids", "n_bytes", "scripts"), shared_hot_keys, bits) \
        .groupBy("slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "n"))), lambda x: x["n"]).alias("pairs"))
    placed = of_slices.join(met, "slice").join(rare, "slice", "left")

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_c, hot_logs = shared_hot.value
        for batch in batches:
            for row in range(batch.num_rows):
                tokens, h, n_tokens = _slice_pairs(batch, row, shared_hot_keys.value)
                of = np.unique(h, return_inverse=True)[1].ravel()
                n_pair = np.concatenate([unpacked(x, "u8") for x in batch.column("pairs")[row].as_py()]).astype(np.float64)[of]
                spot = unpacked(batch.column("spots")[row].as_py(), "i4")
                c, logs = hot_c[spot], hot_logs[:, spot]
                if (spot < 0).any():
                    joined = batch.column("rare")[row].values
                    at = np.asarray(joined.field("place"))
                    c[at] = np.asarray(joined.field("all_c"))
                    for m, name in enumerate(_LOGS):
                        logs[m, at] = np.asarray(joined.field(name))
                begin = np.cumsum(n_tokens) - n_tokens
                before = np.empty(len(tokens), np.float64)
                before[1:] = c[tokens[:-1]]
                before[begin] = n_texts
                blocks = -(-n_tokens // TURN)
                starts = np.repeat(begin, blocks) + TURN * ranges(np.zeros(len(blocks), np.int64), blocks)
                sums = np.empty((2 * len(EMPHASES), len(starts)))
                with np.errstate(divide="ignore"):
                    log_pair = np.log(n_pair)
                for m, power in enumerate(PAIR_POWERS):
                    alone = logs[m, tokens]
                    sums[m] = np.add.reduceat(alone, starts)
                    weight = np.maximum(before, 1.0) ** power
                    sums[len(EMPHASES) + m] = np.add.reduceat(np.logaddexp(log_pair, np.log(weight) + alone) - np.log(before + weight), starts)
                scripts, n_bytes = (np.asarray(batch.column(x)[row].values) for x in ("scripts", "n_bytes"))
                total = mixture(sums, blocks) + model.value.script_logs[scripts]
                base = np.add.reduceat(np.log10(c + ADD)[tokens], begin) - n_tokens * scale
                n_known = np.add.reduceat((c > 0).astype(np.int64)[tokens], begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(total / np.log(10)),
                     pa.array(-total / np.log(2) / n_bytes)], ["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])
                pa.default_memory_pool().release_unused()

    return placed.mapInArrow(mixed, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double, bits_per_byte double").select(
        "doc_id", held_out("doc_id", modulus).alias("held_out"), "n_tokens", "n_known", F.lit(size.n).cast("long").alias("train_tokens"),
        "base_score", "score", "bits_per_byte")


_COUNTS = ["word", "script", "n"]
_TAILS = [bytes([s]) for s in range(SCRIPTS)]
_COLUMNS = ["kind", "slice", "doc_ids", "n_tokens", "n_bytes", "scripts", "trains", "tokens", "spots", "keys", "word", "script", "place"]
