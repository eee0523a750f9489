"""The exact k nearest rows of every row, by a partition of the space around pivots.

Equal vectors are one point with its smallest keys, so a vector that a third of all rows have is no burden. Sampled points are pivots;
every point belongs to the cell of its nearest pivot, and a cell of many points to one of its blocks of bounded size. A point finds its
neighbours in its own block first. The k-th distance there bounds what others may offer: by the triangle inequality most
cells hold nothing within it, and the point is sent only to the blocks of cells that may. With vectors in which distances tell
points apart, the number of those depends on the data's dimension, not on the number of rows; in many dimensions, or without
any structure, it comes to all blocks, n / BLOCK_ROWS of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewell.functions.exprs import c
from scorewell.session import materialize

CELL_ROWS = 512
BLOCK_ROWS = 8_192
MOST_PIVOTS = 16_384
ASKING_ROWS = 32_768
CELLS_PER_STEP = 4_000_000
POINT = "id long, vec array<double>, keys array<long>"
FOUND = "id long, dist double, keys array<long>"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def rough_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and how far rounding may have moved each row of them."""
    square_x, square_y = (x * x).sum(1), (y * y).sum(1)
    rough = square_x[:, None] + square_y[None, :] - 2.0 * (x @ y.T)
    return rough, 1e-9 * (square_x + square_y.max(initial=0))


def nearest_in(x: np.ndarray, x_id: np.ndarray, reach: np.ndarray, y: np.ndarray, y_id: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row of x, row of y, squared distance): up to k nearest of y within ``reach`` of each x, equal ids left out.

    The matrix product chooses with room for its rounding; only chosen distances are worked out from the differences.
    """
    out = []
    step = max(1, CELLS_PER_STEP // max(1, len(y)))
    for i in range(0, len(x), step):
        rough, slack = rough_squares(x[i : i + step], y)
        rough[x_id[i : i + step, None] == y_id[None, :]] = np.inf
        limit = reach[i : i + step] ** 2
        if k < len(y):
            limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
        rows, cols = np.nonzero((rough <= (limit * (1 + 1e-9) + slack)[:, None]) & np.isfinite(rough))
        exact = ((x[i + rows] - y[cols]) ** 2).sum(1)
        order = np.lexsort((y_id[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        out.append((i + rows[best], cols[best], exact[best]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def points(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(id, vec, keys): each distinct vector once, with its k + 1 smallest keys; the least is its id.

    Ranks are cut within each task before the shuffle, so a vector with very many rows stays small.
    """
    base = rows.select(c(key).cast("long").alias("key"), F.transform(c(vector), lambda v: v.cast("double")).alias("vec"))
    first = base.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("key"))).where(F.col("nth") <= k + 1)
    return first.groupBy("vec").agg(F.sort_array(F.collect_list("key")).alias("keys")).select(F.col("keys")[0].alias("id"), "vec", "keys")


def dealt(found: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Points with the cell of their nearest pivot and the distance to it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            near = [rough_squares(x[i : i + 256], pivots)[0].argmin(1) for i in range(0, len(x), 256)]
            cell = np.concatenate(near) if near else np.zeros(0, np.int64)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "vec", "keys", "cell", "far"])

    return found.select("id", "vec", "keys").mapInArrow(deal, f"{POINT}, cell int, far double")


def _own_block(k: int):
    """Each point's neighbours in its own block, and how far others may be."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        x, ids = matrix(table.column("vec")), table.column("id").to_numpy()
        rows, cols, squares = nearest_in(x, ids, np.full(len(x), np.inf), x, ids, k)
        reach = np.full(len(x), np.inf)
        full = np.bincount(rows, minlength=len(x)) == k
        last = np.searchsorted(rows, np.arange(len(x)), side="right") - 1
        reach[full] = np.sqrt(squares[last[full]])
        starts = pa.array(np.searchsorted(rows, np.arange(len(x) + 1)), pa.int32())
        keys = table.column("keys").combine_chunks().take(pa.array(cols))
        near = pa.StructArray.from_arrays([pa.array(squares), keys], ["dist", "keys"])
        return table.select(["id", "vec", "keys", "cell", "sub"]).append_column("reach", pa.array(reach)).append_column("near", pa.ListArray.from_arrays(starts, near))

    return work


def _open_cells(pivots: np.ndarray, least: np.ndarray, most: np.ndarray, enough: np.ndarray):
    """The cells that may hold a point within reach of each point.

    Where its own block had too few, any cell with ``enough`` points bounds the reach by its far side. A point y of cell j is at least |d(x, p_j) - d(y, p_j)| away, and on pivot j's side of the plane between p_j and x's own pivot.
    """
    between = np.sqrt(np.maximum(rough_squares(pivots, pivots)[0], 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cell, reach = matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            lists, reach = [], reach.copy()
            for i in range(0, len(x), 256):
                rough, slack = rough_squares(x[i : i + 256], pivots)
                square, own = np.maximum(rough, 0), cell[i : i + 256]
                d = np.sqrt(square)
                if enough.any():
                    reach[i : i + 256] = np.minimum(reach[i : i + 256], (d + most)[:, enough].min(1) * (1 + 1e-9) + np.sqrt(slack))
                plane = (square - square[np.arange(len(own)), own][:, None]) / (2 * np.maximum(between[own], 1e-300))
                bound = np.maximum(np.maximum(d - most, least - d), np.where(between[own] > 0, plane, 0))
                # The slack of the squares, as one of distances.
                room = reach[i : i + 256] * (1 + 1e-9) + np.sqrt(slack) + 1e-12
                lists += [np.flatnonzero(r) for r in bound <= room[:, None]]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in lists])]), pa.int32())
            cells = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            opened = pa.ListArray.from_arrays(offsets, pa.array(cells.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reach), opened, batch.column(4), batch.column(2)], ["id", "vec", "reach", "cells", "own_sub", "own_cell"])

    return work


def _ask(k: int):
    def work(key: tuple, asking: pa.Table, asked: pa.Table) -> pa.Table:
        x, y = (matrix(t.column("vec")) if t.num_rows else np.zeros((0, 1)) for t in (asking, asked))
        ids = asking.column("id").to_numpy()
        if len(x) and len(y):
            rows, cols, squares = nearest_in(x, ids, asking.column("reach").to_numpy(), y, asked.column("id").to_numpy(), k)
        else:
            rows, cols, squares = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        keys = asked.column("keys").combine_chunks().take(pa.array(cols, pa.int64()))
        return pa.table([pa.array(ids[rows], pa.int64()), pa.array(squares, pa.float64()), keys], ["id", "dist", "keys"])

    return work


def questions(
    near: DataFrame, pivots: np.ndarray, least: np.ndarray, most: np.ndarray, enough: np.ndarray, subs: np.ndarray
) -> DataFrame:
    """(id, vec, reach, cell, sub): each point once per block that may hold a nearer one, its own block left out."""
    asked = near.select("id", "vec", "cell", "reach", "sub")
    opened = asked.mapInArrow(
        _open_cells(pivots, least, most, enough), "id long, vec array<double>, reach double, cells array<int>, own_sub int, own_cell int"
    )
    blocks = F.create_map(*[F.lit(x) for j in np.flatnonzero(subs > 1) for x in (int(j), int(subs[j]))]) if (subs > 1).any() else None
    one = opened.withColumn("cell", F.explode("cells"))
    many = F.lit(1) if blocks is None else F.coalesce(F.try_element_at(blocks, F.col("cell")), F.lit(1))
    one = one.withColumn("sub", F.explode(F.sequence(F.lit(0), many - 1)))
    return one.where("cell <> own_cell OR sub <> own_sub").select("id", "vec", "reach", "cell", "sub")


def nearest_neighbours(
    rows: DataFrame, key: str, vector: str, k: int, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(key, rank, neighbour): the ``k`` nearest other rows of each row, exactly; equal distances by the smaller key.

    Keys are distinct whole numbers and vectors, without nulls, have one length. Fewer than ``k`` other rows give fewer
    neighbours; an empty table gives none.
    """
    found = materialize(points(rows, key, vector, k), "points")
    n = found.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "key long, rank int, neighbour long")
    wanted = min(MOST_PIVOTS, max(1, n // cell_rows))
    sample = found.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").toArrow()  # bounded by MOST_PIVOTS
    pivots = matrix(sample.column("vec"))
    cells = materialize(dealt(found, pivots), "cells")
    least, most, size = np.full(wanted, np.inf), np.full(wanted, -np.inf), np.zeros(wanted, np.int64)
    for r in cells.groupBy("cell").agg(F.min("far").alias("least"), F.max("far").alias("most"), F.count("*").alias("n")).collect():
        least[r["cell"]], most[r["cell"]], size[r["cell"]] = r["least"], r["most"], r["n"]
    subs = np.maximum(1, -(-size // block_rows))
    split = [F.when(F.col("cell") == int(j), F.lit(int(subs[j]))) for j in np.flatnonzero(subs > 1)]
    blocks = F.coalesce(*split, F.lit(1)) if split else F.lit(1)
    homes = cells.withColumn("sub", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    schema = f"{POINT}, cell int, sub int, reach double, near array<struct<dist:double,keys:array<long>>>"
    near = materialize(homes.groupBy("cell", "sub").applyInArrow(_own_block(k), schema), "near")
    offers = near.select("id", F.inline("near"))
    if subs.sum() > 1:
        asking = materialize(questions(near, pivots, least, most, size > k, subs), "questions")
        # A block that very many points ask meets them in several tasks.
        load = materialize(asking.groupBy("cell", "sub").agg(F.ceil(F.count("*") / ASKING_ROWS).cast("int").alias("shares")), "load")
        asking = asking.join(load, ["cell", "sub"]).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
        asked = near.select("id", "vec", "keys", F.col("cell").alias("c"), F.col("sub").alias("s"))
        asked = asked.join(load.toDF("c", "s", "n"), ["c", "s"]).withColumn("h", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        offers = offers.union(asking.groupBy("cell", "sub", "share").cogroup(asked.groupBy("c", "s", "h")).applyInArrow(_ask(k), FOUND))
    order = Window.partitionBy("id").orderBy("dist", F.col("keys")[0])
    best = offers.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    lists = best.groupBy("id").agg(F.expr("collect_list(struct(dist, keys))").alias("offers"))
    # Points at one distance give their keys in one order.
    spread = "flatten(transform(coalesce(offers, array()), o -> transform(o.keys, y -> struct(o.dist AS dist, y AS key))))"
    ranked = f"transform(array_sort({spread}), s -> s.key)"
    each = near.select("id", "vec", "keys").join(lists, "id", "left").withColumn("others", F.expr(ranked))
    each = each.select("vec", "keys", "others", F.explode("keys").alias("key"))
    nearest = F.expr(f"slice(concat(filter(keys, y -> y <> key), others), 1, {k})")
    out = each.select("key", F.posexplode(nearest).alias("rank", "neighbour"))
    # Of a vector with more rows than keys were kept, the other rows have the first k keys for neighbours.
    crowded = near.where(F.size("keys") == k + 1).select("vec", "keys")
    if not crowded.isEmpty():
        base = rows.select(c(key).cast("long").alias("key"), F.transform(c(vector), lambda v: v.cast("double")).alias("vec"))
        others = base.join(F.broadcast(crowded) if n <= MOST_PIVOTS else crowded, "vec").where("key > keys[size(keys) - 1]")
        out = out.union(others.select("key", F.posexplode(F.slice("keys", 1, k)).alias("rank", "neighbour")))
    return out.select("key", (F.col("rank") + 1).alias("rank"), "neighbour")
