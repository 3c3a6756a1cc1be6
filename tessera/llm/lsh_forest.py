"""MinHash near-dedup by an LSH forest (8).

A document is its set of distinct five-word shingles.  Equal sets are one
node.  Each node's MinHash signature is read in several orders; in each order
the nodes are sorted by their values, dealt out by range, and every node meets
the next ones in the sorted sequence that share its first values.  In a thin
region these are all nodes with a short common prefix, in a crowded one the
neighbours with the longest: the depth follows the region.  Nodes of crowded
regions, where neighbours were left over and links have not joined all, are
compared exactly, by a join on their rarest shingles (``crowd_pairs``).

Pairs whose signatures agree enough are candidates; links are confirmed on
the full sets.  Of the candidates only those are looked at that would join two
components: all at once where they are few for their nodes, else the likeliest
of each component first, so that a group of n copies costs some n comparisons.

At similarity 0.75 a pair shares the two first values of one of 14 orders with
probability 0.99999; pairs that the look ahead then leaves out are found by
the exact join.  The tests hold the links against brute force.

Defined results: a text without words, empty or null, has no shingle and no
link; rows with the same set are linked; a null id is never the smallest of a
component unless it has no other; repeated rows stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import as_bytes, list_array, ranges, slices, text_rows, written
from .components import components, forest

SHINGLE = 5
SIMILARITY = (75, 100)
VALUES = 96             # MinHash values of a signature
SURE = 0.56             # share of equal values below which a pair is no candidate (4.3 deviations under 0.75)
ORDERS, DEPTH, AHEAD = 14, 2, 8
LONGEST = 10            # values kept of an order
RARE = 32               # sets that may hold a shingle by which all of them meet
BLOCK = 1 << 16         # shingles of the classes that meet others in one task
SHIPPED = 8             # pairs per node whose sets may travel at once
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20240229)
_FACTORS = (_rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_READ = np.stack([_rng.permutation(VALUES)[:LONGEST] for _ in range(ORDERS)])


class Shingles:
    """Hashed shingle sets of texts, many at a time."""

    def __init__(self):
        self.word = Memo(lambda w: xxhash.xxh3_64_intdigest(w) >> 1, 1 << 19).__getitem__

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes of all texts and their numbers."""
        ids, n_words = [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            words = text.translate(_FOLD).split()
            n_words[k] = len(words)
            ids.extend(map(self.word, words))
        ids = np.array(ids, dtype=np.uint64)
        first = np.cumsum(n_words) - n_words
        n = np.maximum(n_words - SHINGLE + 1, 0)
        at = ranges(first, n)
        h = np.full(len(at), SHINGLE, dtype=np.uint64)
        for j in range(SHINGLE):
            h = (h ^ ids[at + j]) * _MIX
            h ^= h >> np.uint64(32)
        short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
        extra = np.zeros(len(short), dtype=np.uint64)
        for i, k in enumerate(short):
            raw = ids[first[k]:first[k] + n_words[k]].tobytes()
            extra[i] = xxhash.xxh3_64_intdigest(raw, seed=int(n_words[k]))
        of = np.concatenate([np.repeat(np.arange(len(texts)), n), short])
        h = np.concatenate([h, extra])
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        return h[new], np.bincount(of[new], minlength=len(texts))


_LOCAL: list[Shingles] = []


def _shingles() -> Shingles:
    if not _LOCAL:
        _LOCAL.append(Shingles())
    return _LOCAL[0]


def signatures(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MinHash values (16 bits of each) of the sets, one row a set with members."""
    some = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    out = np.zeros((int(some.sum()), VALUES), dtype=np.uint16)
    if len(starts):
        for t, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(h * factor, starts)
            least = (least ^ (least >> np.uint64(29))) * _MIX     # low bits of a minimum, not its zero head
            out[:, t] = (least >> np.uint64(40)).astype(np.uint16)
    return out


def _sketched(rows: DataFrame, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, sizes = _shingles().sets(as_bytes(part.column("text")))
            ends = np.cumsum(sizes)
            digests = [xxhash.xxh3_128_digest(h[e - n:e].tobytes()) if n else None for e, n in zip(ends, sizes)]
            found = iter(signatures(h, sizes))
            sigs = [next(found).tobytes() if n else None for n in sizes]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()),
                 pa.array(sigs, pa.binary())], ["doc_id", "digest", "n_shingles", "set_id", "sig"])

    return rows.mapInArrow(run, f"doc_id {id_type}, digest string, n_shingles long, set_id binary, sig binary")


def _in_order(nodes: DataFrame) -> DataFrame:
    """Each node once per order, sorted inside ranges by the order's values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(part.num_rows, VALUES)
            brief = (sig & np.uint16(255)).astype(np.uint8)
            short = pa.array([r.tobytes() for r in brief], pa.binary())
            for order in range(ORDERS):
                keys = np.ascontiguousarray(sig[:, _READ[order]].astype(">u2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.num_rows, order, np.int32)), pa.array([r.tobytes() for r in keys], pa.binary()),
                     part.column("node"), short], ["order", "key", "node", "brief"])

    rows = nodes.select("node", "sig").mapInArrow(run, "order int, key binary, node long, brief binary")
    return rows.repartitionByRange("order", "key", "node").sortWithinPartitions("order", "key", "node")


def _neighbours(nodes: DataFrame) -> DataFrame:
    """(a, b, est): pairs of near nodes in sorted sequences that may be
    similar; b is null for a node ``a`` that has not met all of its run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [np.asarray(batch.column("order")),
                    np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u2").reshape(n, LONGEST),
                    np.asarray(batch.column("node")),
                    np.frombuffer(b"".join(batch.column("brief").to_pylist()), np.uint8).reshape(n, VALUES)]
            old = 0
            if held is not None:
                old = len(held[0])
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            order, key, node, brief = cols
            held = [c[-AHEAD:] for c in cols]
            same = (key[1:, :DEPTH] == key[:-1, :DEPTH]).all(axis=1) & (order[1:] == order[:-1])
            reach = np.concatenate([[False], same])         # shares the prefix with the row before it
            a_out, b_out, e_out = [], [], []
            run_on = reach.copy()
            for ahead in range(1, AHEAD + 1):
                if ahead > 1:
                    run_on = np.concatenate([[False], run_on[:-1]]) & reach
                later = np.flatnonzero(run_on)
                later = later[later >= max(old, ahead)]
                if not len(later):
                    break
                for at in range(0, len(later), 1 << 15):
                    x = later[at:at + (1 << 15)]
                    est = (brief[x] == brief[x - ahead]).mean(axis=1)
                    good = est >= SURE
                    a_out.append(np.minimum(node[x], node[x - ahead])[good])
                    b_out.append(np.maximum(node[x], node[x - ahead])[good])
                    e_out.append(est[good])
            else:
                crowd = np.unique(np.concatenate([node[later], node[later - AHEAD]]))    # both ends of what is left out
                yield pa.RecordBatch.from_arrays([pa.array(crowd), pa.nulls(len(crowd), pa.int64()), pa.nulls(len(crowd), pa.float64())],
                                                 ["a", "b", "est"])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_out, b_out, e_out)], ["a", "b", "est"])

    return _in_order(nodes).mapInArrow(run, "a long, b long, est double") \
        .groupBy("a", "b").agg(F.max("est").alias("est"))


def _still_open(crowded: DataFrame) -> DataFrame:
    """Nodes of (node, component, sig) whose prefix in some order occurs with
    several components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(part.num_rows, VALUES)
                for order in range(ORDERS):
                    keys = np.full(part.num_rows, order, np.int64)
                    for column in _READ[order][:DEPTH]:
                        keys = keys << 16 | sig[:, column]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), part.column("node"), part.column("component")], ["key", "node", "component"])

    keyed = crowded.select("node", "component", "sig").mapInArrow(run, "key long, node long, component long")
    several = written(keyed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"),
                      "forest-runs")        # a side of its own, so that a long run can be split in the join
    return keyed.join(several, "key").select("node").distinct()


def _bridges(a: np.ndarray, b: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Numbers of some of the edges (a, b) that join what all of them join,
    where nodes of one component are joined already; fewer than nodes."""
    label = np.unique(component, return_inverse=True)[1]
    chosen = []
    while len(open_ := np.flatnonzero(label[a] != label[b])):
        ends = np.concatenate([label[a[open_]], label[b[open_]]])
        at = np.unique(np.unique(ends, return_index=True)[1] % len(open_))
        picked = open_[at]      # an edge of each component
        chosen.append(picked)
        moved, to = forest(label[a[picked]], label[b[picked]], len(component))
        new = np.arange(len(component))
        new[moved] = to
        label = new[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Number of values that each set of ``x`` shares with each of ``y``."""
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    fx, fy = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(fx, fy)
    rows = [(np.repeat(np.arange(len(s)), [len(v) for v in s]), f) for s, f in ((x, fx), (y, fy))]
    for at in range(0, len(both), 4096):
        part, sides = both[at:at + 4096], []
        for (row, value), n in zip(rows, out.shape):
            place = np.minimum(np.searchsorted(part, value), len(part) - 1)
            hit = part[place] == value
            side = np.zeros((n, len(part)), dtype=np.float32)
            side[row[hit], place[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _block_pairs(sized: DataFrame, classes: DataFrame, similarity: tuple[int, int], block: int = BLOCK) -> DataFrame:
    """(class, other, common, link): of the classes whose heads are similar by
    what the classes share, for each class the partner of the longest reach in
    every pair of blocks, and links that join all such heads.

    Classes that may share a shingle of their prefixes, directly or through
    others, are a family.  A family is dealt into blocks of bounded weight,
    those of a large component apart from the others, and two blocks meet in
    one task unless one component holds both.  So blocks, not rows, meet in
    pairs, and a task returns fewer rows than it has read."""
    num, den = similarity
    at = classes.join(sized.select("class", "lo", "hi", F.col("head.size").alias("size"), F.col("head.component").alias("component")), "class")
    first = F.size("items") - F.ceil(F.col("size") * num / den) + 1
    edges = at.select(F.col("class").alias("a"), F.explode(F.slice("items", 1, F.greatest(F.lit(0), first.cast("int")))).alias("b"))
    family = components(written(edges, "crowd-edges")).select(F.col("node").alias("class"), F.col("component").alias("family"))
    at = at.join(family, "class").withColumn("one", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1)) \
        .withColumn("weight", F.size("items").cast("long") + block // 512)
    at = written(at, "crowd-families")
    apart = at.groupBy("family", "one").agg(F.sum("weight").alias("weight")) \
        .withColumn("part", F.when((F.col("weight") >= block) & (F.col("one") >= 0), F.col("one")).otherwise(-1))
    apart = written(apart, "crowd-apart")
    dealt = apart.groupBy("family", "part").agg(F.ceil(F.sum("weight") / block).alias("n"))
    places = apart.drop("weight").join(dealt, ["family", "part"])
    at = at.drop("weight").join(places, ["family", "one"]) \
        .withColumn("block", F.xxhash64("family", "part", F.pmod(F.xxhash64("class"), "n"))).drop("one", "part", "n")
    at = written(at, "crowd-blocks")
    blocks = at.groupBy("family", "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.block") <= F.col("y.block"))
                   & (F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi"))) \
        .select(F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    sides = written(pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")), "crowd-sides")
    sent = at.drop("family").join(sides, "block").repartition("x", "y").sortWithinPartitions("x", "y")

    def compare(held: list[dict]) -> pa.RecordBatch:
        left = [r for r in held if r["block"] == r["x"]]
        right = [r for r in held if r["block"] == r["y"]]
        size, lo, hi = ([np.array([r[c] for r in side], dtype=np.int64) for side in (left, right)] for c in ("size", "lo", "hi"))
        rows = []
        if left and right:
            common = _common([r["items"] for r in left], [r["items"] for r in right]).astype(np.int64)
            good = common * (den + num) >= num * (size[0][:, None] + size[1][None, :])
            good &= np.minimum(lo[0][:, None], lo[1][None, :]) < np.maximum(hi[0][:, None], hi[1][None, :])
            if left[0]["x"] == left[0]["y"]:
                good = np.triu(good, 1)
            i, j = np.nonzero(good)
            shared = common[i, j]
            for this, that, a, b, s in ((left, right, i, j, size[1]), (right, left, j, i, size[0])):
                order = np.lexsort((shared * (den + num) // num - s[b], a))
                last = order[np.flatnonzero(np.append(a[order][1:] != a[order][:-1], len(order) > 0))] if len(order) else order
                rows += [(this[a[k]]["class"], that[b[k]]["class"], int(shared[k]), False) for k in last]
            names, at_ = np.unique([r["class"] for r in left + right], return_inverse=True)
            component = np.zeros(len(names), dtype=np.int64)
            component[at_] = [r["component"] for r in left + right]
            a, b = at_[i], at_[len(left) + j]
            rows += [(left[i[k]]["class"], right[j[k]]["class"], int(shared[k]), True) for k in _bridges(a, b, component)]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in
                                           enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["class", "other", "common", "link"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for part in batches:
            narrow = part.drop_columns(["items"]).to_pylist()
            for row, items in zip(narrow, part.column("items")):
                if held and (held[0]["x"], held[0]["y"]) != (row["x"], row["y"]):
                    yield compare(held)
                    held = []
                held.append(row | {"items": np.array(items.values)})
        if held:
            yield compare(held)

    return sent.mapInArrow(run, "class long, other long, common long, link boolean")


def crowd_pairs(sets: DataFrame, similarity: tuple[int, int], rare: int = RARE, labels: DataFrame | None = None,
                block: int = BLOCK) -> DataFrame:
    """(a, b, est) of nodes of ``sets`` (node, set) such that every pair which
    is similar enough is joined by similar pairs among them and by the
    components of ``labels`` (node, component), if given.  Exact.

    Sets with their shingles in one order, rare ones first, can only be
    similar if their prefixes share a shingle.  Sets meet by the shingles of
    their prefixes that at most ``rare`` sets hold.  A pair without such a
    shingle can only share frequent ones, and both its prefixes reach these:
    such sets go on with their frequent shingles alone, equal ones as one
    class.  Members of two classes then share what the classes share, so a
    member of size n is similar to another only if it is to the smallest, the
    head, of that class, which is if n is at most the reach of its own class
    over that head; and then both heads are similar.  So classes meet by their
    heads, in blocks (``_block_pairs``), and a member meets one head, that of
    its class's longest reach.  What one component holds wholly does not meet.
    A class is sent once for each block that its own meets: n classes of one
    template that links leave apart cost n squared over the classes of a block."""
    num, den = similarity

    def prefix(size, left):
        """Length of the prefix of a set, ``left`` of whose shingles go on."""
        return (size - F.ceil(size * num / den) + 1 - size + left).cast("int")

    def reach(common, head_size):
        """Largest size that is similar to a head with so many in common."""
        return F.floor(common * (den + num) / num) - head_size

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            held = [np.frombuffer(x.as_buffer(), "<i8") for x in part.column("set")]
            counts = np.array([len(x) for x in held], dtype=np.int64)
            if len(held):
                yield pa.RecordBatch.from_arrays([part.column("node"), list_array(np.concatenate(held), counts)], ["class", "items"])

    # sets that share a rare shingle
    items = sets.select("node", "set").mapInArrow(split, "class long, items array<bigint>")
    nodes = sets.select("node", (F.octet_length("set") / 8).cast("long").alias("size"))
    if labels is not None:
        nodes = nodes.join(labels, "node", "left")
    else:
        nodes = nodes.withColumn("component", F.lit(None).cast("long"))
    nodes = written(nodes.select("node", "size", F.coalesce("component", "node").alias("component")), "crowd-nodes")
    each = items.select("class", F.explode("items").alias("item"))
    counts = written(each.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"), "crowd-counts")
    ordered = each.join(counts, "item", "left").groupBy("class").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "item"))).alias("items"))
    ordered = ordered.join(nodes, F.col("class") == F.col("node")) \
        .withColumn("first", F.slice("items", 1, F.greatest(F.lit(0), prefix(F.col("size"), F.size("items")))))
    ordered = written(ordered.select(
        F.struct("node", "size", "component").alias("s"), F.transform(F.filter("first", lambda s: s["df"].between(2, rare)), lambda s: s["item"]).alias("probes"),
        F.when(F.exists("first", lambda s: s["df"] > rare),
               F.array_sort(F.transform(F.filter("items", lambda s: s["df"] > rare), lambda s: s["item"]))).alias("rest")), "crowd-sets")
    # at most ``rare`` sets a shingle, of more than one component
    met = ordered.select(F.explode("probes").alias("item"), "s") \
        .groupBy("item").agg(F.collect_list("s").alias("s"), F.min("s.component").alias("lo"), F.max("s.component").alias("hi")) \
        .where("lo <> hi").select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y")) \
        .where((F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
               & (F.least("x.size", "y.size") * den >= F.greatest("x.size", "y.size") * num)) \
        .groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("est"))

    # sets that may share frequent shingles only go on with these
    named = ordered.where("rest is not null").select("s.*", "rest", F.struct(
        F.xxhash64("rest").alias("h"), F.xxhash64(F.lit(1), "rest").alias("i"), F.size("rest").alias("left")).alias("key"))
    named = written(named.where(prefix(F.col("size"), F.col("key.left")) > 0), "crowd-rest")
    same = written(named.groupBy("key").agg(F.min("node").alias("class"), F.min(F.struct("size", "node", "component")).alias("head"),
                                            F.min("component").alias("lo"), F.max("component").alias("hi")), "crowd-classes")
    classes = named.join(same.select("class"), F.col("node") == F.col("class"), "left_semi").select(F.col("node").alias("class"), F.col("rest").alias("items"))
    sized = same.select("class", "head", "lo", "hi", F.col("key.left").alias("left"))
    members = named.select("node", "size", "component", "key").join(same.select("key", "class"), "key").drop("key")
    near = written(_block_pairs(sized, classes, similarity, block), "crowd-near")
    other = sized.select(F.col("class").alias("other"), F.col("head").alias("to"))
    near = written(near.join(sized.select("class", "head"), "class").join(other, "other"), "crowd-heads")
    links = near.where("link").select(F.least("head.node", "to.node").alias("a"), F.greatest("head.node", "to.node").alias("b"), F.col("common").alias("est"))
    # members of one component are joined with their head
    own = sized.where("lo <> hi").select("class", F.struct(reach(F.col("left"), F.col("head.size")).alias("reach"), F.col("head.node").alias("b"),
                                                           F.col("head.component").alias("c")).alias("best"))
    own = own.unionByName(near.where("not link").select("class", F.struct(
        reach(F.col("common"), F.col("to.size")).alias("reach"), F.col("to.node").alias("b"), F.col("to.component").alias("c")).alias("best")))
    best = sized.where("lo <> hi").select("class", F.col("head.component").alias("hc")) \
        .join(own.groupBy("class").agg(F.max("best").alias("best")), "class")
    ends = members.join(written(best, "crowd-best"), "class") \
        .where("size <= best.reach and node <> best.b and component <> best.c and component <> hc")
    ends = ends.select(F.least("node", "best.b").alias("a"), F.greatest("node", "best.b").alias("b"), F.lit(0).cast("long").alias("est"))
    return met.unionByName(links).unionByName(ends).groupBy("a", "b").agg(F.max("est").cast("double").alias("est"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar enough."""
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            good = []
            for x, y in zip(part.column("set_a"), part.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) * den >= num * max(len(x), len(y)) else 0
                good.append(den * common >= num * (len(x) + len(y) - common))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _labelled(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs with the components of their ends; those inside one go."""
    if labels is None:
        return pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    la = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    lb = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left") \
        .withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, digest (md5 of the text), n_shingles,
    component_id (smallest doc_id that links reach), kept (it is that one),
    and group, the component itself, whatever its ids are."""
    rows = text_rows(docs, id_col, text_col).withColumn("digest", F.md5("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    sketches = written(_sketched(rows, id_type).withColumn("row", F.monotonically_increasing_id()), "forest-sketches")
    # one node per set: its first row
    nodes = written(sketches.where("set_id is not null").groupBy("set_id").agg(
        F.min("row").alias("node"), F.min_by(F.struct("doc_id", "digest", "sig"), "row").alias("of"))
        .select("set_id", "node", "of.doc_id", "of.digest", "of.sig"), "forest-nodes")
    met = written(_neighbours(nodes), "forest-pairs")
    pairs = met.where("b is not null")

    def set_table(ends: DataFrame) -> DataFrame:
        """Full sets of some nodes."""
        wanted = nodes.join(ends, "node").select("node", F.col("doc_id").alias("w_id"), F.col("digest").alias("w_digest"))
        same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest"))
        texts = rows.join(wanted, same)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                h, sizes = _shingles().sets(as_bytes(part.column("text")))
                ends_ = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([h[e - n:e].astype("<u8").tobytes() for e, n in zip(ends_, sizes)], pa.binary())],
                    ["node", "set"])

        return written(texts.select("node", "text").mapInArrow(run, "node long, set binary").dropDuplicates(["node"]), "forest-sets")

    links: DataFrame | None = None
    labels: DataFrame | None = None

    def settle(pairs: DataFrame, sets: DataFrame | None = None) -> None:
        """Look at candidates until none is left between two components."""
        nonlocal links, labels
        bound, batch = None, 0
        while True:
            open_ = written(_labelled(pairs, labels), "forest-open")
            n = open_.count()
            if not n:
                return
            if sets is None:
                sets = set_table(open_.select(F.col("a").alias("node")).unionByName(open_.select(F.col("b").alias("node"))).distinct())
            bound = bound or sets.count()
            if few := n <= SHIPPED * bound:
                chosen = open_.select("a", "b")
            else:
                # the likeliest of each component; the rest may be joined by then, and
                # where links are few, ever more of the rest
                best = F.struct(F.col("est").alias("e"), F.xxhash64("a", "b").alias("h"), "a", "b")
                sides = open_.select(F.explode(F.array("ca", "cb")).alias("c"), best.alias("p"))
                tops = sides.groupBy("c").agg(F.max("p").alias("p"), F.max_by("p", "p.h").alias("q"))
                some = tops.select(F.explode(F.array("p", "q")).alias("x")).select("x.a", "x.b")
                if batch:
                    some = some.unionByName(open_.where(F.pmod(F.xxhash64("b", "a"), F.lit(n)) < min(batch, SHIPPED * bound)).select("a", "b"))
                chosen = written(some.distinct(), "forest-chosen")
            fresh = written(_verified(chosen, sets, similarity), "forest-links")
            n_fresh = fresh.count()
            if not few and 4 * n_fresh < chosen.count():
                batch = 2 * batch or bound
            if n_fresh:
                links = fresh if links is None else links.unionByName(fresh)
                labels = written(components(links), "forest-labels")
            if few:
                return
            pairs = open_.select("a", "b", "est").join(chosen, ["a", "b"], "left_anti")

    settle(pairs)
    crowded = met.where("b is null").select(F.col("a").alias("node"))
    named = nodes.join(crowded, "node").select("node", "sig")
    if labels is not None:
        named = named.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "sig")
    else:
        named = named.withColumn("component", F.col("node"))
    # only regions of several components are still open
    left_over = written(_still_open(named), "forest-crowd")
    if left_over.limit(1).count():
        sets = set_table(left_over)
        settle(written(crowd_pairs(sets, similarity, labels=labels), "forest-more"), sets)

    of_set = nodes.select("set_id", "node")
    placed = sketches.join(of_set, "set_id", "left")
    if labels is not None:
        placed = placed.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node", -F.col("row") - 1))
    else:
        placed = placed.withColumn("c", F.coalesce("node", -F.col("row") - 1))
    placed = written(placed.select("doc_id", "digest", "n_shingles", "c"), "forest-placed")
    least = written(placed.groupBy("c").agg(F.min("doc_id").alias("component_id")), "forest-least")
    return placed.join(least, "c").select("doc_id", "digest", "n_shingles", "component_id",
                                          F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                                          F.col("c").alias("group"))
