import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.operators import curves, evaluate, thresholds
from scorewell.operators.prefix import quantile_cuts, running_totals, with_ranges


def frame(spark, pairs):
    return spark.createDataFrame([(int(a), float(b)) for a, b in pairs], "label int, score double")


SMALL = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]


def noisy(n=400, seed=42, positives=0.2):
    rng = np.random.RandomState(seed)
    label = (rng.rand(n) < positives).astype(int)
    return list(zip(label, np.clip(label + rng.randn(n) * 0.3, 0, 1)))


def test_curve_counts_by_hand(spark):
    rows = curves.score_curve(frame(spark, SMALL)).orderBy("threshold").collect()
    assert [(r.tp, r.fp, r.fn, r.tn) for r in rows] == [(2, 2, 0, 0), (2, 1, 0, 1), (1, 1, 1, 1), (1, 0, 1, 2)]


def test_auc_by_hand_and_undefined(spark):
    assert curves.roc_auc(curves.score_curve(frame(spark, SMALL))).first().roc_auc == 0.75
    one_class = frame(spark, [(0, 0.1), (0, 0.2)])
    assert curves.roc_auc(curves.score_curve(one_class)).first().roc_auc is None


def test_auc_with_ties_counts_half(spark):
    assert curves.roc_auc(curves.score_curve(frame(spark, [(0, 0.5), (1, 0.5)]))).first().roc_auc == 0.5


def test_missing_scores_are_left_out(spark):
    df = frame(spark, SMALL).unionByName(
        spark.createDataFrame([(1, None), (0, float("nan"))], "label int, score double")
    )
    assert curves.roc_auc(curves.score_curve(df)).first().roc_auc == 0.75


def test_curves_match_brute_force(spark):
    pairs = noisy()
    got = {r.threshold: r for r in curves.score_curve(frame(spark, pairs)).collect()}
    y, s = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    assert set(got) == set(s)
    for t, r in got.items():
        assert (r.tp, r.fp) == (((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum())


def test_pr_auc_ends_at_precision_one(spark):
    # Points (recall, precision): (1, .5), (1, 2/3), (.5, .5), (.5, 1), then (0, 1).
    expected = 0.0 * 0 + 0.5 * (2 / 3 + 0.5) / 2 + 0 + 0.5 * 1
    assert curves.pr_auc(curves.score_curve(frame(spark, SMALL))).first().pr_auc == pytest.approx(expected)


def test_roc_start_point(spark):
    rows = curves.roc_curve(curves.score_curve(frame(spark, SMALL)), with_start=True).orderBy(F.col("threshold").desc()).collect()
    assert (rows[0].threshold, rows[0].fpr, rows[0].tpr) == (float("inf"), 0.0, 0.0)
    assert (rows[-1].fpr, rows[-1].tpr) == (1.0, 1.0)


def test_recall_strategy_takes_smallest_score(spark):
    pairs = noisy()
    row = thresholds.best_threshold(frame(spark, pairs), "maximize_recall").first()
    assert row.threshold == min(p[1] for p in pairs) and row.metric == 1.0


def test_unknown_strategy_raises(spark):
    with pytest.raises(ValueError):
        thresholds.best_threshold(frame(spark, SMALL), "maximize_luck")


def test_cost_threshold_matches_brute_force(spark):
    pairs = noisy(300, 7)
    y, s = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    grid = np.unique(np.concatenate([[0.0], s, [1.0]]))
    costs = [((s < t) & (y == 1)).sum() * 10_000 + ((s >= t) & (y == 0)).sum() * 200 for t in grid]
    row = thresholds.cost_threshold(frame(spark, pairs)).first()
    assert row.total_cost == min(costs) and row.threshold == grid[int(np.argmin(costs))]


def test_dearer_misses_never_raise_the_threshold(spark):
    df = frame(spark, noisy())
    cheap = thresholds.cost_threshold(df, miss_cost=100).first().threshold
    assert thresholds.cost_threshold(df, miss_cost=100_000).first().threshold <= cheap


def test_cost_threshold_of_one_class_flags_or_fails(spark):
    negatives = frame(spark, [(0, 0.2), (0, 0.6)])
    # Every threshold with a flagged row has both classes in label and prediction together.
    assert thresholds.cost_threshold(negatives).first().threshold == 0.6
    positives_unflagged_never = frame(spark, [(1, 0.0), (1, 0.0)])
    assert thresholds.cost_threshold(positives_unflagged_never).first().threshold == 1.0
    with pytest.raises(ValueError):
        thresholds.choose_threshold(frame(spark, [(1, 1.0)]), "cost")


def test_manual_threshold_wins(spark):
    assert thresholds.choose_threshold(frame(spark, SMALL), manual=0.42) == 0.42
    assert thresholds.choose_threshold(frame(spark, SMALL), "precision") == 0.8


def test_classification_rows(spark):
    report = {r["class"]: r for r in evaluate.classification_report(frame(spark, SMALL), 0.5).collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].support) == (1.0, 0.5, 2)
    assert report["accuracy"].f1 == 0.75
    assert report["macro avg"].recall == 0.75


def test_summary_zero_denominators(spark):
    row = evaluate.classification_summary(frame(spark, SMALL), 2.0).first()
    assert (row.precision, row.recall, row.f1, row.fn) == (0.0, 0.0, 0.0, 2)


def test_running_totals_over_groups(spark):
    rng = np.random.RandomState(0)
    rows = {(g, float(v)): int(n) for g, v, n in zip(rng.choice(list("ab"), 500), rng.randint(0, 90, 500), rng.randint(1, 9, 500))}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in rows.items()], "g string, v double, n long")
    ranged = with_ranges(df, quantile_cuts(df, ["v"], 7))
    got = running_totals(ranged, "v", ["n"], "v__range", by=["g"]).collect()
    for r in got:
        assert r.n_before == sum(n for (g, v), n in rows.items() if g == r.g and v < r.v)
        assert r.n_total == sum(n for (g, _), n in rows.items() if g == r.g)


def test_curve_never_sorts_rows_in_one_task(spark):
    """The only single-partition exchanges carry range sums or a final aggregate row."""
    df = curves.score_curve(spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("int(value > 60) AS label", "value / 500 AS score"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    for block in plan.split("Exchange SinglePartition")[1:]:
        below = next(line for line in block.split("\n")[1:] if line.strip())
        assert "HashAggregate(keys=[threshold__range" in below
