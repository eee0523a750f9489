import numpy as np
import pytest

from scorewell.operators.folds import fold_statistics, merged
from scorewell.plans import models


@pytest.fixture(scope="module")
def dealt(spark):
    rng = np.random.RandomState(3)
    rows = [
        (i % 4, float(x) if i % 5 else (None if i % 2 else float("nan")), 1e9 + float(x), None if i % 4 else 2.5, None, k if i % 7 else None)
        for i, (x, k) in enumerate(zip(rng.randn(400) * 3, rng.choice(list("aabbbcde"), 400)))
    ]
    rows += [(None, 1e6, 1e6, 1e6, 1e6, "only without a fold")]
    return spark.createDataFrame(rows, "fold int, x double, far double, one double, none double, `k d` string").repartition(3).cache()


def test_equal_to_a_fit_per_fold(spark, dealt):
    numeric, categorical = ["x", "far", "one", "none"], ["k d"]
    found = fold_statistics(dealt, "fold", range(4), numeric, categorical, 3)
    for f in range(4):
        inside = dealt.where(f"fold <> {f}")
        plain, names = models.build_preprocessor(inside, numeric, categorical, 3)
        known, same = models.build_preprocessor(inside, numeric, categorical, 3, found[f])
        assert names == same
        a, b = (np.array([r.features.toArray() for r in p.transform(dealt.orderBy("far")).collect()]) for p in (plain, known))
        assert a.shape[0] == dealt.count() and np.allclose(a, b, rtol=1e-6, atol=1e-6)
    # The column that has values in fold 0 alone: unknown where fold 0 is left out.
    assert found[0].medians["one"] is None and "one" not in found[0].scale
    assert found[1].scale["one"] == (2.5, 0.0) and found[1].medians["none"] is None


def test_parts_merge_without_loss():
    rng = np.random.RandomState(1)
    parts = [1e9 + rng.rand(k) for k in (5, 0, 1, 300)]
    n, mean, spread = merged((len(p), p.mean() if len(p) else 0.0, p.var() * len(p) if len(p) else 0.0) for p in parts)
    whole = np.concatenate(parts)
    assert n == 306 and mean == pytest.approx(whole.mean()) and spread / n == pytest.approx(whole.var(), rel=1e-6)


def test_empty_table(spark, dealt):
    found = fold_statistics(dealt.limit(0), "fold", range(2), ["x"], ["k d"])
    assert found[1].medians == {"x": None} and found[1].scale == {} and found[1].categories.kept == {"k d": []}


def test_scans_do_not_grow_with_folds(spark, dealt):
    def jobs(n):
        group = f"folds-{n}"
        spark.sparkContext.setJobGroup(group, group)
        fold_statistics(dealt, "fold", range(n), ["x", "far"], [])
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    assert jobs(4) <= jobs(2) + 1
