"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, tidy

#: Links that one task takes in, of 16 bytes each; more are connected in rounds of joins, with the same result.
MOST_LINKS = 1_000_000


def connect(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in rising order and the smallest node that each is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if got:
        nodes, label = connect(*(np.concatenate([g[k] for g in got]) for k in range(2)))
        yield pa.RecordBatch.from_pydict({"node": nodes, "label": label})


def components(links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """node, label of every end of the links (a, b): the smallest node that it is connected with.

    Few links are connected in one task. With more, each round takes the least of a node's label, its neighbours' labels and its label's own
    label, so paths halve; rounds go on until no label changes.
    """
    links = checkpoint(links.select("a", "b"))
    if links.limit(most + 1).count() <= most:
        return links.coalesce(1).mapInArrow(tidy(_in_one_task), "node long, label long")
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    edges = checkpoint(pairs.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    label = checkpoint(edges.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("label")))
    while not label.isEmpty():
        near = edges.join(label.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        own = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = checkpoint(label.join(near, "node").join(own, "label").select("node", F.least("label", "near", "far").alias("new"), "label"))
        label = step.select("node", F.col("new").alias("label"))
        if step.where("label <> new").isEmpty():
            break
    return label
