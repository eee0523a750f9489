"""Connected components of an edge table, by alternating star contractions.

Tasks that read the edges put stars in their place first, and what is left, when it is few enough for one task of bounded
size, is joined there. Of more, each round joins and aggregates on node ids only and is written to the shared folder, so a lost
executor costs a re-read, never a restart. No component of more edges than that bound is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.session import materialize

MAX_ROUNDS = 60
#: A task holds so many edges (of 16 bytes) at once.
EDGES_PER_TASK = 1 << 20


def rooted(edges: np.ndarray) -> np.ndarray:
    """Rows (node, root) for every node of ``edges`` (rows of two longs); ``root`` is the least node that can be reached."""
    nodes, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    # Of two roots the larger hangs itself below the least that it meets; in two turns at least half of those that meet others are gone.
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while ((up := root[root]) != root).any():
            root = up
    return np.stack([nodes, nodes[root]], axis=1)


def _folder(names: tuple[str, str], most: int, roots: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stars in place of a task's edges, those of about ``most`` edges at once; with ``roots`` a root is listed as its own."""

    def fold(batches):
        held, size = [np.empty((0, 2), np.int64)], 0

        def folded():
            found = rooted(np.concatenate(held))
            return found if roots else found[found[:, 0] != found[:, 1]]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found.T], list(names))

        for batch in batches:
            if size + batch.num_rows > most and size:
                found = folded()
                if 2 * len(found) > most:
                    yield out(found)
                    held, size = [np.empty((0, 2), np.int64)], 0
                else:
                    held, size = [found], len(found)
            held.append(np.stack([x.to_numpy() for x in batch.columns], axis=1))
            size += batch.num_rows
        yield out(folded())

    return fold


def _hub(edges: DataFrame) -> DataFrame:
    """The least of a node and its neighbours, per node ``u``."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("hub"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_hub(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("hub").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    hubs = _hub(edges)
    moved = edges.join(hubs, "u").select(F.col("v").alias("u"), F.col("hub").alias("v"))
    return moved.union(hubs.select("u", F.col("hub").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``u``, ``v``; any order, repeats allowed).

    ``root`` is the least node that can be reached. Nodes without an edge to another node are not
    listed. Nulls are left out; an empty table gives an empty table.
    """
    longs = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u <> v")
    current = longs.mapInArrow(_folder(("u", "v"), EDGES_PER_TASK, False), "u long, v long")
    current, before = materialize(current, "edges"), None
    for _ in range(MAX_ROUNDS):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= EDGES_PER_TASK:
            return current.coalesce(1).mapInArrow(_folder(("node", "root"), EDGES_PER_TASK, True), "node long, root long")
        if state == before:
            # Stable: every node hangs directly from its root.
            leaves = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return leaves.union(roots)
        before = state
        stars = _large_star(current).where("u <> v").distinct()
        current = materialize(_small_star(stars).where("u <> v").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
