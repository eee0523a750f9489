"""Boosted trees against a plain trainer on arrays, and what the passes and settings do."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from scorewell.operators import boosting
from scorewell.operators.boosting import Settings


def plain_fit(x, y, w, s):
    """The same trees, growing one leaf at a time and measuring every leaf from its rows."""
    cuts = [np.unique(x[:, j][~np.isnan(x[:, j])])[:-1] for j in range(x.shape[1])]
    raw, trees = np.zeros(len(x)), []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)

        def value(rows):
            v = -g[rows].sum() / (h[rows].sum() + s.l2)
            return float(np.clip(v, -s.delta, s.delta)) if s.delta else float(v)

        def worth(rows):
            v = value(rows)
            return -(g[rows].sum() * v + 0.5 * (h[rows].sum() + s.l2) * v * v)

        def split(rows):
            best = (0.0, None)
            for j in range(x.shape[1]):
                missing = np.isnan(x[rows, j])
                for left_missing in (False, True) if missing.any() else (False,):
                    for cut in cuts[j]:
                        go = np.where(missing, left_missing, x[rows, j] <= cut)
                        a, b = rows[go], rows[~go]
                        if min(len(a), len(b)) < s.least_rows or min(h[a].sum(), h[b].sum()) < s.least_hessian:
                            continue
                        gain = worth(a) + worth(b) - worth(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, (j, cut, a, b))
            return best

        leaves = [(np.arange(len(x)), split(np.arange(len(x))))]
        while len(leaves) < s.leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
            gain, found = leaves[k][1]
            if found is None:
                break
            leaves[k : k + 1] = [(part, split(part)) for part in found[2:]]
        for rows, _ in leaves:
            raw[rows] += s.rate * value(rows)
        trees.append(len(leaves))
    return raw, trees


def data(seed, n=400, missing=True):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 5, n), rng.integers(0, 30, n) / 4], 1).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 2] > 3) | (rng.random(n) < 0.1)).astype(float)
    if missing:
        x[rng.random(n) < 0.1, 0] = np.nan
    return x, y, rng.choice([1.0, 2.5], n)


def frame(spark, x, y, w):
    rows = [(i, Vectors.dense(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, ["id", "features", "label", "weight"]).repartition(4)


@pytest.mark.parametrize("s", [
    Settings(trees=3, leaves=6, least_rows=10), Settings(trees=2, leaves=9, rate=0.5, delta=0.4, l2=0.3, least_rows=1, least_hessian=2.0),
    Settings(trees=10, leaves=2, rate=1.0, least_rows=5),
])
def test_scores_equal_the_plain_trainer(spark, s):
    x, y, w = data(s.leaves)
    df = frame(spark, x, y, w)
    model = boosting.SecondOrderBoosting.of(s, weightCol="weight").fit(df)
    raw, leaves = plain_fit(x, y, w, s)
    got = {r.id: r.p for r in model.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-raw)), atol=1e-9)
    used = [r[0] for r in model.nodes() if r[2] is None]
    assert [used.count(t) for t in range(s.trees)] == leaves


def test_a_tree_takes_a_pass_per_level_and_measures_the_smaller_child(spark, monkeypatch):
    x, y, w = data(5, missing=False)
    y = np.where(np.random.default_rng(5).random(len(y)) < 0.25, 1 - y, y)
    passes = []
    measure = boosting._measure

    def counted(rows, done, growing, wanted, cuts, chosen):
        passes.append(len(wanted))
        return measure(rows, done, growing, wanted, cuts, chosen)

    monkeypatch.setattr(boosting, "_measure", counted)
    s = Settings(trees=1, leaves=12, least_rows=5)
    model = boosting.SecondOrderBoosting.of(s).fit(frame(spark, x, y, w))
    depth, left = {0: 0}, [r for r in model.nodes() if r[2] is not None]
    for _, i, _, _, a, b, _, _ in left:
        depth[a] = depth[b] = depth[i] + 1
    assert len(left) == 11 and len(passes) <= max(depth.values()) + 1 and sum(passes) < 2 * 11 + 12


def test_delta_columns_and_stop(spark):
    x, y, w = data(6, 200)
    df = frame(spark, x, y, w)
    bounded = boosting.SecondOrderBoosting.of(Settings(trees=4, rate=1.0, delta=0.05, least_rows=5)).fit(df)
    assert max(abs(r[-1]) for r in bounded.nodes() if r[-1] is not None) <= 0.05 + 1e-12
    few = boosting.SecondOrderBoosting.of(Settings(trees=8, columns=0.34, least_rows=5)).fit(df)
    assert all(len({r[2] for r in few.nodes() if r[0] == t and r[2] is not None}) <= 1 for t in range(8))
    assert len({r[2] for r in few.nodes() if r[2] is not None}) > 1
    flat = boosting.SecondOrderBoosting.of(Settings(trees=50, least_rows=5)).fit(frame(spark, x, np.ones(200), w).where("id < 3"))
    assert len(flat.trees) == 1  # too few rows to split
    with pytest.raises(ValueError):
        boosting.SecondOrderBoosting.of(Settings()).fit(df.where("false"))


def test_refreshed_scores_and_saved_models(spark, tmp_path, monkeypatch):
    x, y, w = data(7, 300)
    df = frame(spark, x, y, w)
    s = Settings(trees=7, leaves=4, least_rows=5)
    once = boosting.SecondOrderBoosting.of(s).fit(df)
    monkeypatch.setattr(boosting, "REFRESH_TREES", 2)
    again = Pipeline(stages=[boosting.SecondOrderBoosting.of(s)]).fit(df)
    again.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    p = lambda m: sorted((r.id, round(r.p, 12)) for r in m.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect())
    assert p(once) == p(again) == p(loaded)
