"""Boosted trees by second-order steps: every split and leaf value comes from sums of gradients and hessians.

Features are cut into bins once. A pass over the rows gives, for every node asked for, one histogram per feature (sums of gradient and
hessian, and rows, for each bin); tasks fold their rows before the shuffle, and one number per (node, feature, bin)
reaches the driver, which is bounded by the tree's size. Of two children only the one with fewer rows is measured, the other is
the parent's histogram less that. Trees grow best-first: the leaf with the highest gain is split next. So that this takes one pass per
level and not one per leaf, a pass measures the children of all leaves that may be split next; those that are not needed are pruned.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasProbabilityCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.functions.exprs import c
from scorewell.session import materialize

MISSING = 255  # the bin of missing cells
MOST_BINS = 254
REFRESH_TREES = 8


@dataclass
class Settings:
    """``delta`` bounds a leaf's step before the learning rate (0: none), ``columns`` is the share of features each tree sees."""

    trees: int = 100
    leaves: int = 31
    rate: float = 0.1
    l2: float = 1.0
    least_hessian: float = 1e-3
    least_rows: int = 20
    least_gain: float = 1e-9
    delta: float = 0.0
    columns: float = 1.0
    bins: int = 64
    seed: int = 42


@dataclass
class Node:
    """Part of a growing tree. ``hist`` is (features, bins + 1, 3): gradient, hessian, rows; the last bin holds missing cells."""

    hist: np.ndarray | None
    total: np.ndarray
    gain: float = 0.0
    feature: int = -1
    cut: int = -1
    missing_left: bool = False
    left: int = -1
    right: int = -1
    kept: bool = field(default=False)


def step(total: np.ndarray, s: Settings) -> np.ndarray:
    """The leaf value that sums of gradient and hessian call for."""
    value = -total[..., 0] / (total[..., 1] + s.l2)
    return np.clip(value, -s.delta, s.delta) if s.delta else value


def worth(total: np.ndarray, s: Settings) -> np.ndarray:
    """How far a leaf lowers the loss: (gradient)^2 / (hessian + l2) / 2 where its step is not bounded."""
    value = step(total, s)
    return -(total[..., 0] * value + 0.5 * (total[..., 1] + s.l2) * value * value)


def best_split(hist: np.ndarray, total: np.ndarray, chosen: np.ndarray, n_cuts: Sequence[int], s: Settings) -> tuple[float, int, int, bool]:
    """(gain, feature, cut, missing cells go left): the first of the best in order of feature, side of missing cells and cut."""
    best = (0.0, -1, -1, False)
    if total[2] < 2 * s.least_rows:
        return best
    here = float(worth(total, s))
    for f in chosen.tolist():
        if not n_cuts[f]:
            continue
        below = np.cumsum(hist[f, : n_cuts[f]], axis=0)
        for missing_left in (False, True) if hist[f, -1, 2] else (False,):
            left = below + hist[f, -1] if missing_left else below
            right = total - left
            ok = (left[:, 2] >= s.least_rows) & (right[:, 2] >= s.least_rows)
            ok &= (left[:, 1] >= s.least_hessian) & (right[:, 1] >= s.least_hessian)
            gains = np.where(ok, worth(left, s) + worth(right, s) - here, -np.inf)
            k = int(np.argmax(gains))
            if gains[k] > max(best[0], s.least_gain) * (1 + 1e-12):
                best = (float(gains[k]), f, k, missing_left)
    return best


class Tree:
    """Arrays by node: feature (-1 for a leaf), cut, whether missing cells go left, the children and the value."""

    def __init__(self, nodes: Sequence[Node] | None = None, s: Settings | None = None, kept_only: bool = True):
        if nodes is None:
            return
        inner = [n.left >= 0 and (n.kept or not kept_only) for n in nodes]
        self.feature = np.array([n.feature if i else -1 for n, i in zip(nodes, inner)], np.int32)
        self.cut = np.array([n.cut for n in nodes], np.int32)
        self.missing_left = np.array([n.missing_left for n in nodes], bool)
        self.left = np.array([n.left for n in nodes], np.int32)
        self.right = np.array([n.right for n in nodes], np.int32)
        self.value = np.array([s.rate * float(step(n.total, s)) for n in nodes])
        self.gain = np.array([n.gain for n in nodes])

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int32)
        while True:
            feature = self.feature[at]
            rows = np.flatnonzero(feature >= 0)
            if not len(rows):
                return at
            node = at[rows]
            b = bins[rows, feature[rows]]
            left = np.where(b == MISSING, self.missing_left[node], b <= self.cut[node])
            at[rows] = np.where(left, self.left[node], self.right[node])

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(bins)]

    def to_dict(self) -> dict:
        return {k: v.tolist() for k, v in vars(self).items()}

    @classmethod
    def from_dict(cls, facts: dict) -> Tree:
        out = cls()
        kinds = {"value": float, "gain": float, "missing_left": bool}
        for k, v in facts.items():
            setattr(out, k, np.array(v, kinds.get(k, np.int32)))
        return out


def bin_cuts(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Up to ``bins - 1`` cuts per feature, at quantiles; a feature with few values is cut at each of them. One scan."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"bins must be in 2..{MOST_BINS}")
    shares = ", ".join(repr((i + 1) / bins) for i in range(bins))
    sql = [f"percentile_approx(if(isnan(x[{j}]), null, x[{j}]), array({shares}), {50 * bins})" for j in range(width)]
    found = rows.selectExpr(f"array({', '.join(sql)}) AS cuts").first()["cuts"] if width else []
    # Nothing is above the largest value, so it is no cut.
    return [np.unique(np.array(x or [], float))[:-1] for x in found]


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin b holds values above cut b - 1, up to cut b."""
    out = np.empty(x.shape, np.uint8)
    for j, edges in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(edges, x[:, j], side="left"))
    return out


def _binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    width = len(cuts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(to_bins(x, cuts).tobytes())])
            raw = pa.array(np.zeros(len(x)))
            yield pa.RecordBatch.from_arrays([packed.cast(pa.binary()), batch.column(1), batch.column(2), raw], ["bins", "y", "w", "raw"])

    return rows.mapInArrow(work, "bins binary, y double, w double, raw double")


def _cells(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = np.frombuffer(batch.column(0).cast(pa.binary()).buffers()[2] or b"", np.uint8)
    start = batch.column(0).offset * width
    return flat[start : start + batch.num_rows * width].reshape(-1, width)


def _with_raw(rows: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _cells(batch, width)
            raw = batch.column(3).to_numpy() + sum((t.raw(bins) for t in trees), np.zeros(len(bins)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(raw)], ["bins", "y", "w", "raw"])

    return rows.mapInArrow(work, rows.schema)


def _measure(rows: DataFrame, done: list[Tree], growing: Tree, wanted: list[int], cuts: list[np.ndarray], chosen: np.ndarray) -> dict[int, np.ndarray]:
    """Histograms of some nodes of a growing tree, over all rows."""
    width, slots = len(cuts), max(len(x) for x in cuts) + 2
    place = np.full(len(growing.feature), -1)
    place[wanted] = np.arange(len(wanted))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(chosen), len(wanted) * slots))
        for batch in batches:
            bins = _cells(batch, width)
            node = place[growing.leaf_of(bins)]
            here = np.flatnonzero(node >= 0)
            if not len(here):
                continue
            bins, node = bins[here], node[here]
            y, w, raw = (batch.column(k).to_numpy()[here] for k in (1, 2, 3))
            raw = raw + sum((t.raw(bins) for t in done), np.zeros(len(bins)))
            p = 1 / (1 + np.exp(-raw))
            sums = (w * (p - y), w * p * (1 - p), np.ones(len(p)))
            for i, f in enumerate(chosen):
                b = np.where(bins[:, f] == MISSING, slots - 1, bins[:, f])
                at = node * slots + b
                for k, v in enumerate(sums):
                    total[k, i] += np.bincount(at, v, total.shape[2])
        parts = total.reshape(3, len(chosen), len(wanted), slots).transpose(2, 1, 3, 0).reshape(len(wanted), len(chosen), slots * 3)
        keys = [(n, f) for n in range(len(wanted)) for f in range(len(chosen)) if parts[n, f].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in keys], pa.int32()) for k in (0, 1)] + [pa.array([parts[x].tobytes() for x in keys], pa.binary())],
            ["node", "feature", "hist"],
        )

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in table.column("hist").to_pylist()], axis=0)
        return pa.table({"node": [key[0].as_py()], "feature": [key[1].as_py()], "hist": [total.tobytes()]}, schema=table.schema)

    kind = "node int, feature int, hist binary"
    out = {n: np.zeros((width, slots, 3)) for n in wanted}
    for r in rows.mapInArrow(fold, kind).groupBy("node", "feature").applyInArrow(add, kind).collect():
        out[wanted[r["node"]]][chosen[r["feature"]]] = np.frombuffer(r["hist"]).reshape(slots, 3)
    return out


def grow(rows: DataFrame, done: list[Tree], cuts: list[np.ndarray], chosen: np.ndarray, s: Settings) -> Tree:
    """One tree, best-first. A pass over the rows per level at most."""
    nodes, n_cuts = [Node(None, np.zeros(3))], [len(x) for x in cuts]

    def settle(node: Node, hist: np.ndarray) -> None:
        node.hist, node.total = hist, hist[chosen[0]].sum(0)
        node.gain, node.feature, node.cut, node.missing_left = best_split(hist, node.total, chosen, n_cuts, s)

    settle(nodes[0], _measure(rows, done, Tree(nodes, s, False), [0], cuts, chosen)[0])
    while True:
        for n in nodes:
            n.kept = False
        heap, leaves, waiting = [(-nodes[0].gain, 0)], 1, False
        while heap and leaves < s.leaves:
            gain, i = heapq.heappop(heap)
            if gain >= 0:
                break
            if nodes[i].left < 0:
                waiting = True
                break
            nodes[i].kept = True
            leaves += 1
            for j in (nodes[i].left, nodes[i].right):
                heapq.heappush(heap, (-nodes[j].gain, j))
        if not waiting:
            return Tree(nodes, s)
        # Every leaf that may still be split, the most promising first.
        open_ = sorted((i for i, n in enumerate(nodes) if n.left < 0 and n.gain > 0), key=lambda i: (-nodes[i].gain, i))
        parents, wanted = open_[: s.leaves - leaves], []
        for i in parents:
            n = nodes[i]
            n.left, n.right = len(nodes), len(nodes) + 1
            left = n.hist[n.feature, : n.cut + 1].sum(0) + (n.hist[n.feature, -1] if n.missing_left else 0)
            nodes += [Node(None, left), Node(None, n.total - left)]
            wanted.append(n.left if left[2] <= n.total[2] - left[2] else n.right)
        found = _measure(rows, done, Tree(nodes, s, False), wanted, cuts, chosen)
        for i, j in zip(parents, wanted):
            other = nodes[i].left + nodes[i].right - j
            settle(nodes[j], found[j])
            settle(nodes[other], nodes[i].hist - found[j])


def fit_trees(rows: DataFrame, s: Settings) -> tuple[list[Tree], list[np.ndarray]]:
    """Trees and cuts for rows of (x array<double>, y double, w double). Scores start at 0, a probability of one half."""
    head = rows.select(F.size("x").alias("n")).first()
    width = head["n"] if head else 0
    if not width:
        raise ValueError("no rows or no features")
    cuts = bin_cuts(rows, width, s.bins)
    current = materialize(_binned(rows.select("x", "y", "w"), cuts), "binned").persist(StorageLevel.MEMORY_AND_DISK)
    trees, fresh = [], []
    for t in range(s.trees):
        chosen = np.arange(width)
        if s.columns < 1:
            rng = np.random.default_rng([s.seed, t])
            chosen = np.sort(rng.choice(width, max(1, round(s.columns * width)), replace=False))
        tree = grow(current, fresh, cuts, chosen, s)
        trees.append(tree)
        if tree.feature[0] < 0:
            break  # nothing is left to gain
        fresh = [*fresh, tree]
        if len(fresh) == REFRESH_TREES and t + 1 < s.trees:
            newer = materialize(_with_raw(current, fresh, width), "binned").persist(StorageLevel.MEMORY_AND_DISK)
            current.unpersist()
            current, fresh = newer, []
    current.unpersist()
    return trees, cuts


def raw_scores(x: np.ndarray, trees: list[Tree], cuts: list[np.ndarray]) -> np.ndarray:
    bins = to_bins(x, cuts)
    return sum((t.raw(bins) for t in trees), np.zeros(len(x)))


class SecondOrderModel(Model, HasFeaturesCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability``, a vector of the probabilities of class 0 and 1."""

    facts = Param(Params._dummy(), "facts", "trees and cuts as JSON", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(probabilityCol="probability")

    @property
    def trees(self) -> list[Tree]:
        return [Tree.from_dict(t) for t in json.loads(self.getOrDefault("facts"))["trees"]]

    @property
    def cuts(self) -> list[np.ndarray]:
        return [np.array(x, float) for x in json.loads(self.getOrDefault("facts"))["cuts"]]

    def nodes(self) -> list[tuple]:
        """(tree, node, feature, threshold, left, right, gain, value) of all nodes in use; feature and threshold are null for leaves."""
        out, cuts = [], self.cuts
        for t, tree in enumerate(self.trees):
            todo = [0]
            while todo:
                i = todo.pop()
                f = int(tree.feature[i])
                if f < 0:
                    out.append((t, i, None, None, None, None, None, float(tree.value[i])))
                    continue
                todo += [int(tree.left[i]), int(tree.right[i])]
                out.append((t, i, f, float(cuts[f][tree.cut[i]]), *sorted(todo[-2:]), float(tree.gain[i]), None))
        return sorted(out, key=lambda r: r[:2])

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, cuts = self.trees, self.cuts

        @F.pandas_udf("double")
        def chance(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            return pd.Series(1 / (1 + np.exp(-raw_scores(np.stack(x.to_numpy()).astype(float), trees, cuts))))

        p = "__chance"
        scored = df.withColumn(p, chance(vector_to_array(c(self.getFeaturesCol()))))
        return scored.withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - F.col(p), F.col(p)))).drop(p)


class SecondOrderBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits boosted trees by ``Settings`` to a vector column and a 0/1 label, null labels left out."""

    settings = Param(Params._dummy(), "settings", "Settings as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", weightCol: str | None = None, settings: str = "{}") -> None:
        super().__init__()
        self._setDefault(settings="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, s: Settings, **columns: str) -> SecondOrderBoosting:
        return cls(settings=json.dumps(vars(s)), **columns)

    def _fit(self, df: DataFrame) -> SecondOrderModel:
        weight = c(self.getOrDefault("weightCol")).cast("double") if self.isSet("weightCol") else F.lit(1.0)
        label = c(self.getLabelCol()).cast("double")
        rows = df.where(label.isNotNull()).select(vector_to_array(c(self.getFeaturesCol())).alias("x"), label.alias("y"), weight.alias("w"))
        trees, cuts = fit_trees(rows, Settings(**json.loads(self.getOrDefault("settings"))))
        model = SecondOrderModel()
        model._set(facts=json.dumps({"trees": [t.to_dict() for t in trees], "cuts": [x.tolist() for x in cuts]}), featuresCol=self.getFeaturesCol())
        return model
