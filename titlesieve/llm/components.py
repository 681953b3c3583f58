"""Connected components of link tables, by joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlesieve.llm.batches import map_batches
from titlesieve.sources.storage import materialise

#: Rounds after which something must be wrong: components halve in depth in each.
MOST_ROUNDS = 60
_FOREST = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a - b that have a smaller one, and the smallest they lead to."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: BIGINT, not null).

    ``component`` is the smallest node that can be reached. Links may be repeated, point
    either way or join a node with itself; nodes without a link are not in the result
    (a node linked with itself only is not either). An empty table gives no rows.

    Union-find inside each batch thins the links to forests. Then stars are formed in
    rounds: every node is linked with the smallest neighbour of its centre, first through
    larger, then through smaller neighbours, until nothing changes. The minimum of a
    node's neighbours is aggregated before the shuffle, and joined back by a key that has
    one row on that side, so a node with a third of all links can be split. Rounds are
    stored under the checkpoint folder. Nothing but one count per round is collected.
    """
    pairs = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    current = materialise(pairs.transform(map_batches, _forests, _FOREST), "links")
    for _ in range(MOST_ROUNDS):
        large = _star(current, larger=True)
        # Small star: each node and its smaller neighbours all point at the smallest.
        small = _star(large, larger=False)
        after = materialise(small, "links")
        current = after
        if _settled(after):
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots
    )


def _settled(links: DataFrame) -> bool:
    """Whether every node points at one other node, and none points at one that points on."""
    down = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    up = links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    roles = down.unionByName(up).groupBy("node").agg(
        F.sum("out").alias("out"), F.max("in").alias("in")
    )
    return roles.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """One star round over links (a > b), as links (a > b) without repeats."""
    if larger:
        both = links.select("a", "b").unionByName(
            links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        )
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # b > a >= low: every larger neighbour now points at the centre's smallest.
    else:
        low = links.groupBy("a").agg(F.min("b").alias("low"))
        down = links.join(low, "a")
        moved = down.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = moved.unionByName(low.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()
