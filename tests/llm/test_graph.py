import random

import numpy as np
import pytest

from scorewell.llm import graph


def brute(edges):
    root = {}
    for u, v in edges:
        a, b = sorted((root.setdefault(u, u), root.setdefault(v, v)))
        root = {k: a if x == b else x for k, x in root.items()}
    return root


def drawn():
    """A chain in random order, a star whose hub is its largest, loose pairs, repeats and negative ids."""
    rng = random.Random(7)
    chain = rng.sample(range(-500, 500), 300)
    edges = [*zip(chain, chain[1:]), *((9_000, i) for i in range(2_000, 2_100)), *((i, i + 1) for i in range(3_000, 3_100, 2))]
    edges += edges[:20] + [(v, u) for u, v in edges[20:40]]
    rng.shuffle(edges)
    return edges


def test_roots_of_arrays():
    edges = drawn()
    assert dict(graph.rooted(np.array(edges)).tolist()) == brute(edges)
    assert graph.rooted(np.empty((0, 2), np.int64)).shape == (0, 2)


@pytest.mark.parametrize("most", [graph.EDGES_PER_TASK, 100])
def test_components_equal_brute_force(spark, monkeypatch, most):
    """In one task, and in rounds where tasks hold fewer edges than there are."""
    monkeypatch.setattr(graph, "EDGES_PER_TASK", most)
    edges = drawn()
    rows = [*edges, (5_000, 5_000), (None, 1), (6_000, None)]
    found = [(r.node, r.root) for r in graph.components(spark.createDataFrame(rows, "u long, v long").repartition(6)).collect()]
    assert len(found) == len(dict(found)) and dict(found) == brute(edges)
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """Each round is some seven shuffles of as many tasks as the session has partitions, however few edges there are."""
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, name, write=graph.materialize: written.append(name) or write(df, name))
    found = graph.components(spark.createDataFrame(drawn(), "u long, v long").repartition(6))
    assert written == ["edges"]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
