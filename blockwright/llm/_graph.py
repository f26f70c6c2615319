"""Connected components by repeated contraction, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import _text
from blockwright.llm._session import checkpoint, ship

#: Edges that one task may hold (16 bytes each).
TASK_EDGES = 1_000_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a bounded set of edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:  # pointers to the end
            twice = new[new]
            if (twice == new).all():
                break
            new = twice
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what a task's edges connect: a node and its smallest one."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, roots = _roots(a, b)
        own = nodes != roots
        return roots[own], nodes[own]

    def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        a = np.concatenate((a, batch.column(0).to_numpy()))
        b = np.concatenate((b, batch.column(1).to_numpy()))
        if a.size >= TASK_EDGES:
            a, b = star(a, b)
            if 2 * a.size >= TASK_EDGES:  # does not shrink: pass it on
                yield batch_of(a, b)
                a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield batch_of(*star(a, b))


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, roots = _roots(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node id of its component) for every node
    that has an edge ``a``-``b`` to another.

    Each task first reduces its own edges to a forest.  What is left is solved
    in one task as soon as it has at most ``TASK_EDGES`` edges; until then it is
    contracted in rounds: each node points to itself or a neighbour, whichever
    comes first in an order drawn anew by hash, pointers are doubled once, and
    edges are renamed to the nodes pointed at; edges inside one node vanish.  The
    drawn order keeps pointer chains short, so rounds grow with the logarithm of
    the size, whatever the shape.  No node's neighbours are ever gathered."""
    ship(edges.sparkSession)
    left = edges.where("a <> b").select("a", "b").mapInArrow(_text.frees(_forest), "a long, b long")
    levels: list[DataFrame] = []
    while True:
        left = checkpoint(left)
        if left.count() <= TASK_EDGES:
            break
        drawn = lambda c, seed=len(levels): F.struct(F.xxhash64(c, F.lit(seed)).alias("rank"), F.col(c).alias("id"))
        both = left.select(F.col("a").alias("node"), drawn("b").alias("other")).union(left.select(F.col("b").alias("node"), drawn("a").alias("other")))
        parent = both.groupBy("node").agg(F.min("other").alias("first")).select("node", F.least("first", drawn("node"))["id"].alias("label"))
        above = parent.select(F.col("node").alias("label"), F.col("label").alias("up"))
        parent = checkpoint(parent.join(above, "label").select("node", F.col("up").alias("label")))
        levels.append(parent)
        xs = left.join(parent.withColumnRenamed("node", "a"), "a").select(F.col("label").alias("a"), "b")
        ys = xs.join(parent.withColumnRenamed("node", "b"), "b").select("a", F.col("label").alias("b"))
        left = ys.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    last = left.repartition(1).mapInArrow(_text.frees(_labels), "node long, label long")
    if not levels:
        return checkpoint(last)
    out = levels[0]
    for level in [*levels[1:], last]:
        above = level.select(F.col("node").alias("label"), F.col("label").alias("up"))
        out = out.join(above, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    lowest = out.groupBy("label").agg(F.min("node").alias("low"))
    return checkpoint(out.join(lowest, "label").select("node", F.col("low").alias("label")))
