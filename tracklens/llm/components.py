"""Connected components of a graph held as a table, by forests of its parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, stage_table

#: Edges that one step joins in memory.
EDGES = 1_000_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), the node of each one's component that a hash puts first, and that hash."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    with np.errstate(over="ignore"):
        hashes = mix64(nodes.astype(np.int64).view(np.uint64)).view(np.int64)
    order = np.argsort(hashes)
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    at = place[at]
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            first = order[root[place]]
            return nodes, nodes[first], hashes[first]
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> Iterator[pa.RecordBatch]:
        columns = roots(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        held.clear()
        for lo in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in columns], ["node", "root", "hash"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(h[0]) for h in held) >= EDGES:
            yield from joined()
    if held:
        yield from joined()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges (u, v); the component is its smallest node.

    Each round joins the edges of every input split in memory, a bounded number at a
    time, so that a node has one root a split, however many edges it had. It keeps the
    root that a hash puts first, and its other roots become edges to that one: a smaller
    graph of roots for the next round, in as few splits as hold EDGES edges each, which
    loses a share of its nodes each time as hashes know no long ascending paths. Once no node has two roots, the rounds' answers
    are joined from the last to the first. What a round finds is written to the shared
    folder, so that a lost executor costs one round. Loops and repeated edges do no harm;
    rows with a null end are left out. An empty table gives an empty table.
    """
    edges = stage_table(edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), "edges")
    own = Window.partitionBy("node").orderBy("hash", "root")
    rounds = []
    for _ in range(max_rounds):
        found = edges.mapInArrow(_forest, "node long, root long, hash long")
        found = stage_table(found.select("node", "root", F.first("root").over(own).alias("first"), F.row_number().over(own).alias("turn")), "forest")
        rounds.append(found.where("turn = 1").select("node", "root"))
        edges = found.where("root <> first").select(F.col("root").alias("u"), F.col("first").alias("v"))
        left = edges.count()
        if left == 0:
            break
        edges = edges.coalesce(-(-left // EDGES))
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    out = rounds.pop()
    while rounds:
        above = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = rounds.pop().join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    return out.join(least, "root").select("node", "component")
