"""Nearest rows by pivots: against all pairs, and how far vectors are copied."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.operators import neighbours


def brute(x, k):
    out = set()
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i]
        out |= {(i, r + 1, int(j)) for r, j in enumerate(order[:k])}
    return out


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vec array<double>").repartition(5)


@pytest.mark.parametrize("name", ["plane", "ties", "clusters", "hot", "wide", "few"])
def test_neighbours_equal_all_pairs(spark, name):
    rng = np.random.default_rng(len(name))
    x = {
        "plane": rng.random((400, 2)),
        "ties": rng.integers(0, 6, (300, 2)).astype(float),
        "clusters": rng.normal(0, 0.01, (300, 3)) + rng.integers(0, 5, (300, 1)) * 100,
        "hot": np.concatenate([np.ones((150, 2)), rng.random((200, 2)), np.zeros((3, 2))]),
        "wide": rng.normal(size=(150, 40)),
        "few": rng.random((3, 2)),
    }[name]
    rng.shuffle(x)
    got = neighbours.nearest_neighbours(frame(spark, x), "key", "vec", 5, cell_rows=20, block_rows=16)
    assert {tuple(r) for r in got.collect()} == brute(x, 5)


def copies_per_point(spark, n):
    x = np.random.default_rng(1).random((n, 2))
    found = neighbours.points(frame(spark, x), "key", "vec", 5)
    pivots = x[: n // 32]
    cells = neighbours.dealt(found, pivots).withColumn("sub", F.lit(0)).cache()
    near = cells.groupBy("cell", "sub").applyInArrow(
        neighbours._own_block(5), f"{neighbours.POINT}, cell int, sub int, reach double, near array<struct<dist:double,keys:array<long>>>"
    )
    least, most, size = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots))
    for r in cells.groupBy("cell").agg(F.min("far").alias("a"), F.max("far").alias("b"), F.count("*").alias("n")).collect():
        least[r["cell"]], most[r["cell"]], size[r["cell"]] = r["a"], r["b"], r["n"]
    return neighbours.questions(near, pivots, least, most, size > 5, np.ones(len(pivots), int)).count() / n


def test_copies_of_a_vector_do_not_grow_with_the_rows(spark):
    few, many = copies_per_point(spark, 8_000), copies_per_point(spark, 32_000)
    assert many < 4 and many < 1.2 * few


def test_empty_table(spark):
    assert neighbours.nearest_neighbours(frame(spark, np.zeros((0, 2))), "key", "vec", 5).collect() == []
