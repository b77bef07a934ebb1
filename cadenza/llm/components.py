"""Connected components of links between numbers, distributed and in memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of 0..n-1 over undirected links."""
    at = np.arange(n)
    while len(u):
        a, b = at[u], at[v]
        low = np.minimum(a, b)
        np.minimum.at(at, a, low)
        np.minimum.at(at, b, low)
        while True:
            up = at[at]
            if np.array_equal(up, at):
                break
            at = up
        open_ = at[u] != at[v]
        u, v = u[open_], v[open_]
    return at


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect the same nodes as the given ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = roots(len(nodes), at[: len(u)], at[len(u) :])
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


#: Links that are gathered before they are reduced to a forest.
_AT_ONCE = 2_000_000


def _reduced(batches):
    """(u, v) to a forest that connects the same nodes; it holds a task's nodes at most."""
    held, size = [], 0

    def joined():
        return forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        size += batch.num_rows
        if size > _AT_ONCE:
            held = [joined()]
            size = len(held[0][0])
    if held:
        u, v = joined()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``links`` (u, v), root the smallest node of the component.

    Links are first reduced to a forest in each task, so that pairs within a group become as many as its nodes
    there. Every round hooks each node to the smallest label around it and then skips one label ahead; labels
    are written to the shared folder after each round, and only a count reaches the driver.
    """
    both = links.select("u", "v").where("u != v").mapInArrow(_reduced, "u long, v long")
    both = both.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
    both = written(both.distinct(), "links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("near"))
        met = labels.join(near, labels["node"] == near["u"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("next"))
        # a label is itself a node: nodes that carry it move on to what it has met
        moved = met.groupBy(F.col("old").alias("label")).agg(F.min("next").alias("to"))
        new = met.join(moved, met["next"] == moved["label"], "left").select("node", "old", F.least("next", F.coalesce("to", "next")).alias("root"))
        new = written(new, "labels")
        if not new.where("old != root").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")
