"""Per-row feature impacts of linear and tree models, and their summaries.

Impacts travel as one array per row, so ranking the features of a row needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.functions.exprs import c, double_sql, lit_double, lit_text
from scorewell.session import fresh_path

# How many features the views of one row and of the whole table list.
ROW_TOP = 5
TABLE_TOP = 20

#: Leaves whose paths test up to so many features keep a table of all patterns: 3 kB a leaf at most.
TABLE_BITS = 6
MOST_BITS = 62
LEAVES_AT_ONCE = 2_000
TESTS_KEPT = 1_000


def explain_linear(
    df: DataFrame, keys: Sequence[str], coefficients: dict[str, float], means: dict[str, float]
) -> DataFrame:
    """(keys, impacts): coefficient x (value - mean) per feature, exact for a linear score."""
    parts = [
        f"struct({lit_text(f)} AS feature, {lit_double(w)} * ({double_sql(df, f)} - {lit_double(means[f])}) AS impact)"
        for f, w in coefficients.items()
    ]
    return df.select(*[c(k) for k in keys], F.expr(f"array({', '.join(parts)})").alias("impacts"))


def linear_base(coefficients: dict[str, float], means: dict[str, float], intercept: float) -> float:
    """The log-odds at the mean row, which the impacts add to."""
    return intercept + sum(w * means[f] for f, w in coefficients.items())


def explain_linear_vector(
    df: DataFrame, keys: Sequence[str], names: Sequence[str], weights: Sequence[float], means: Sequence[float],
    features: str = "features",
) -> DataFrame:
    """``explain_linear`` over an assembled feature vector."""
    facts = ", ".join(
        f"struct({lit_text(n)} AS n, {lit_double(w)} AS w, {lit_double(m)} AS m)" for n, w, m in zip(names, weights, means)
    )
    impacts = f"zip_with(x, array({facts}), (v, f) -> struct(f.n AS feature, f.w * (v - f.m) AS impact))"
    return df.select(*[c(k) for k in keys], vector_to_array(c(features)).alias("x")).select(
        *[c(k) for k in keys], F.expr(impacts).alias("impacts")
    )


@dataclass(frozen=True)
class Path:
    """A leaf: its value, and per feature on the way the share of training rows kept and the tests."""

    value: float
    features: tuple[int, ...]
    shares: tuple[float, ...]
    tests: tuple[tuple[tuple[str, object, bool], ...], ...]


@dataclass(frozen=True)
class TreeNode:
    """A node of a tree: training rows (by weight) that reached it, and either a leaf's value or a test that sends rows to the left.

    ``kind`` is ``le`` (the feature is at most ``bound``) or ``in`` (it is one of ``bound``); ``left`` and ``right`` are node numbers.
    """

    cover: float
    value: float = 0.0
    feature: int = -1
    kind: str = "le"
    bound: object = None
    left: int = -1
    right: int = -1


def tree_paths(nodes: dict[int, TreeNode], root: int = 0) -> list[Path]:
    """The leaves of one tree."""
    paths, stack = [], [(root, {})]
    while stack:
        at, seen = stack.pop()
        n = nodes[at]
        if n.left < 0:
            order = sorted(seen)
            paths.append(Path(n.value, tuple(order), tuple(seen[f][0] for f in order), tuple(tuple(seen[f][1]) for f in order)))
            continue
        share, tests = seen.get(n.feature, (1.0, ()))
        for child, goes_left in ((n.left, True), (n.right, False)):
            kept = share * nodes[child].cover / n.cover
            stack.append((child, {**seen, n.feature: (kept, (*tests, (n.kind, n.bound, goes_left)))}))
    return paths


def mean_output(paths: Sequence[Path]) -> float:
    """What the trees say when no feature is known."""
    return sum(p.value * float(np.prod(p.shares)) for p in paths)


def read_paths(model, spark, doubled_margin: bool) -> tuple[list[Path], float]:
    """All leaves of a fitted forest or boosted model from its saved node table, and the mean output.

    The table has as many rows as the model has nodes, whatever the data it was trained on.
    """
    location = fresh_path(spark, "trees")
    model.write().overwrite().save(location)
    saved: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(f"{location}/data").select("treeID", "nodeData.*").collect():
        saved.setdefault(r["treeID"], {})[r["id"]] = r
    weights = list(model.treeWeights)
    paths: list[Path] = []
    for tree, table in saved.items():
        scale = 2.0 * weights[tree] if doubled_margin else weights[tree] / sum(weights)
        nodes = {}
        for i, n in table.items():
            stats, split = n["impurityStats"], n["split"]
            cover = stats[0] if doubled_margin else sum(stats)
            if n["leftChild"] < 0:
                nodes[i] = TreeNode(cover, scale * (n["prediction"] if doubled_margin else stats[1] / cover))
                continue
            kind = "in" if split["numCategories"] >= 0 else "le"
            bound = tuple(split["leftCategoriesOrThreshold"]) if kind == "in" else split["leftCategoriesOrThreshold"][0]
            nodes[i] = TreeNode(cover, 0.0, split["featureIndex"], kind, bound, n["leftChild"], n["rightChild"])
        paths += tree_paths(nodes)
    return paths, mean_output(paths)


def pattern_impacts(values: np.ndarray, shares: np.ndarray, passes: np.ndarray) -> np.ndarray:
    """Shapley values (leaf, feature on its path, pattern) of leaves whose paths test equally many features.

    Along one leaf's path every feature either lets a row through or not; an unknown one counts with its share of the training rows. The
    value of a set of known features is then a product, and the weighted sum over all sets comes from the coefficients
    of a product of linear terms, one per other feature of the path.
    ``shares`` is (leaf, feature), ``passes`` (pattern, feature) of zeros and ones.
    """
    leaves, d = shares.shape
    weights = [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]
    out = np.empty((leaves, d, len(passes)))
    for i in range(d):
        poly = [np.ones((leaves, len(passes)))]
        for j in range(d):
            if j == i:
                continue
            unknown = [p * shares[:, j, None] for p in poly]
            known = [p * passes[None, :, j] for p in poly]
            poly = [unknown[0], *[u + k for u, k in zip(unknown[1:], known[:-1])], known[-1]]
        total = sum(w * p for w, p in zip(weights, poly))
        out[:, i] = values[:, None] * (passes[None, :, i] - shares[:, i, None]) * total
    return out


def _patterns(numbers: np.ndarray, d: int) -> np.ndarray:
    return ((numbers[:, None] >> np.arange(d)) & 1).astype(float)


class TreeImpacts:
    """Impacts of a sum of trees, row by row, from tables over the patterns of passed tests.

    A row is, to a leaf, a number of as many bits as its path tests features. What each feature then adds is looked up: leaves of up to
    ``TABLE_BITS`` features have a table of all patterns, made once per process; of longer paths only the
    patterns that a batch has are worked out. Paths of more than 62 features are refused.
    """

    def __init__(self, paths: Sequence[Path]) -> None:
        self.paths = [p for p in paths if p.features]
        if any(len(p.features) > MOST_BITS for p in self.paths):
            raise ValueError(f"a path tests more than {MOST_BITS} features")
        self._tables: dict[int, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tables": None}

    @property
    def tables(self) -> dict[int, np.ndarray]:
        if self._tables is None:
            by_size: dict[int, list[int]] = {}
            for k, p in enumerate(self.paths):
                by_size.setdefault(len(p.features), []).append(k)
            self._tables = {}
            for d in range(1, TABLE_BITS + 1):
                every = _patterns(np.arange(1 << d), d)
                for start in range(0, len(by_size.get(d, ())), LEAVES_AT_ONCE):
                    some = by_size[d][start : start + LEAVES_AT_ONCE]
                    values = np.array([self.paths[k].value for k in some])
                    found = pattern_impacts(values, np.array([self.paths[k].shares for k in some]), every)
                    self._tables |= zip(some, found)
        return self._tables

    def of(self, x: np.ndarray) -> np.ndarray:
        """(row, feature) impacts of a batch of feature vectors."""
        out = np.zeros(x.shape[::-1])
        columns = np.ascontiguousarray(x.T)
        hits: dict[tuple, np.ndarray] = {}  # leaves of one tree share their tests
        for k, path in enumerate(self.paths):
            pattern = np.zeros(len(x), np.int64)
            for i, (f, tests) in enumerate(zip(path.features, path.tests)):
                passed = True
                for kind, bound, left in tests:
                    hit = hits.get((f, kind, bound))
                    if hit is None:
                        if len(hits) >= TESTS_KEPT:
                            hits.clear()
                        hit = hits[f, kind, bound] = np.isin(columns[f], bound) if kind == "in" else columns[f] <= bound
                    passed = passed & (hit if left else ~hit)
                pattern |= passed.astype(np.int64) << i
            table = self.tables.get(k)
            if table is None:
                seen, pattern = np.unique(pattern, return_inverse=True)
                d = len(path.features)
                table = pattern_impacts(np.array([path.value]), np.array([path.shares]), _patterns(seen, d))[0]
            for f, row in zip(path.features, table):
                out[f] += row[pattern]
        return out.T


def explain_tree(
    df: DataFrame, key: str, names: Sequence[str], model, boosted: bool, features: str = "features"
) -> tuple[DataFrame, float]:
    """(key, impacts) for a forest (in probability) or a boosted model (in log-odds), and the base."""
    paths, base = read_paths(model, df.sparkSession, boosted)
    return explain_paths(df.select(c(key), vector_to_array(c(features)).alias("x")), key, names, paths), base


def explain_paths(df: DataFrame, key: str, names: Sequence[str], paths: Sequence[Path]) -> DataFrame:
    """(key, impacts) of the sum of trees with these leaves, for rows with an array ``x`` of features.

    Rows stay where they are; each task works through its own batches with the leaves of the model, which are broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(TreeImpacts(paths))
    key_type = df.schema[key].dataType.simpleString()

    def impacts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"key": pdf["key"], "v": list(shared.value.of(np.stack(pdf["x"].to_numpy())))})

    labels = ", ".join(lit_text(n) for n in names)
    return df.select(c(key).alias("key"), "x").mapInPandas(impacts, f"key {key_type}, v array<double>").select(
        F.col("key").alias(key),
        F.expr(f"zip_with(array({labels}), v, (n, i) -> struct(n AS feature, i AS impact))").alias("impacts"),
    )


def top_impacts(explained: DataFrame, keys: Sequence[str], k: int = ROW_TOP) -> DataFrame:
    """(keys, kind, rank, feature, impact): the k largest impacts by size, and the k largest among
    the positive and among the negative ones."""
    kept = [c(x) for x in keys]
    keyed = "transform(impacts, i -> struct(-abs(i.impact) AS o, i.feature AS feature, i.impact AS impact))"
    ordered = explained.select(*kept, F.expr(f"array_sort({keyed}) AS ordered"))
    kinds = {"absolute": "ordered", "positive": "filter(ordered, i -> i.impact > 0)", "negative": "filter(ordered, i -> i.impact < 0)"}
    groups = ", ".join(f"struct({lit_text(name)} AS kind, slice({chosen}, 1, {k}) AS top)" for name, chosen in kinds.items())
    spread = ordered.select(*kept, F.expr(f"inline(array({groups}))"))
    return spread.select(*kept, "kind", F.posexplode("top").alias("pos", "t")).select(
        *kept, "kind", (F.col("pos") + 1).alias("rank"), "t.feature", "t.impact"
    )


def global_importance(explained: DataFrame, top: int | None = None) -> DataFrame:
    """(feature, importance): mean absolute impact over all rows, largest first."""
    mean = (
        explained.select(F.explode("impacts").alias("i"))
        .groupBy(F.col("i.feature").alias("feature"))
        .agg(F.avg(F.abs("i.impact")).alias("importance"))
    )
    ranked = mean.orderBy(F.col("importance").desc(), "feature")
    return ranked.limit(top) if top else ranked


def base_and_impacts(explained: DataFrame, base: float) -> DataFrame:
    """Add ``output``: the base plus all impacts, which is the model's own output for the row."""
    return explained.withColumn("output", F.expr(f"aggregate(impacts, {lit_double(base)}, (a, i) -> a + i.impact)"))
