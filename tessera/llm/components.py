"""Connected components of an undirected graph.  Tasks first replace their
own share of the edges, of bounded number, by stars; what several tasks leave
is joined by star contraction: edges are pulled towards the least neighbour,
first from above and then from below, until every edge joins a node to the
least node of its component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SHARE = 250_000     # edges that one task holds


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that reach a smaller one over some edges, and the least each
    reaches, by relaxation."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        ends = np.concatenate(held, axis=1)
        names, at = np.unique(ends, return_inverse=True)
        at = at.reshape(ends.shape)
        moved, to = forest(at[0], at[1], len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[to])], ["a", "b"])

    for part in batches:
        if part.num_rows:
            held.append(np.stack([np.asarray(part.column("a")), np.asarray(part.column("b"))]))
            n += part.num_rows
            if n > 2 * SHARE:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour of each first node, itself included."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); nodes without an
    edge to another are absent.  Copies of an edge, loops and null ends do no
    harm.  The rounds are few: about the logarithm of the longest path."""
    edges = edges.select("a", "b").where("a <> b")
    tasks = max(1, -(-edges.count() // SHARE))
    edges = written(edges.coalesce(tasks).mapInArrow(_stars, "a long, b long"), "components")
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.join(_least(both), F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = up.where("a <> b").distinct()        # a > b: the smaller neighbours of a
        low = _least(down)
        pulled = down.join(low, F.col("a") == F.col("n"))
        edges = pulled.select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        edges = written(edges, "components")
        # done when every node points to one that points nowhere
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("out")),
                                              F.struct(F.col("b").alias("x"), F.lit(0).alias("out")))).alias("e"))
        busy = ends.groupBy("e.x").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("least")) \
            .where("out > 1 or (out = 1 and least = 0)").limit(1)
        if not busy.count():
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
