"""Threshold and evaluation queries."""

from __future__ import annotations


from scorewell.catalog.common import CURVE, RATES, SCORED, TIED, Catalog, rounded, scored_events, tied_lineitem
from scorewell.operators import curves, evaluate, thresholds

catalog = Catalog()
T = 0.3
GRID = ", ".join(repr(t) for t in curves.cost_grid())


@catalog.add(
    "score_curve",
    f"WITH {SCORED}, {CURVE} SELECT round(threshold, 6) AS threshold, CAST(pos AS BIGINT) AS pos, "
    "CAST(neg AS BIGINT) AS neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, "
    "CAST(tn AS BIGINT) AS tn FROM curve",
)
def score_curve(spark, sf_dir):
    return rounded(curves.score_curve(scored_events(spark, sf_dir)))


@catalog.add(
    "roc_curve",
    f"WITH {SCORED}, {CURVE} SELECT round(threshold, 6) AS threshold, round(fp / (fp + tn), 6) AS fpr, "
    "round(tp / (tp + fn), 6) AS tpr FROM curve",
)
def roc_curve(spark, sf_dir):
    return rounded(curves.roc_curve(curves.score_curve(scored_events(spark, sf_dir))))


AUC = (
    "SELECT round(sum(pos * (tn + neg / 2.0)) / (sum(pos) * sum(neg)), 8) AS roc_auc, "
    "CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM curve"
)


@catalog.add("roc_auc", f"WITH {SCORED}, {CURVE} {AUC}")
def roc_auc(spark, sf_dir):
    return rounded(curves.roc_auc(curves.score_curve(scored_events(spark, sf_dir))), 8)


@catalog.add("roc_auc_ties", f"WITH {TIED}, {CURVE} {AUC}")
def roc_auc_ties(spark, sf_dir):
    return rounded(curves.roc_auc(curves.score_curve(tied_lineitem(spark, sf_dir))), 8)


@catalog.add(
    "pr_curve",
    f"WITH {SCORED}, {CURVE}, {RATES} SELECT round(threshold, 6) AS threshold, round(p, 6) AS precision, "
    "round(r, 6) AS recall FROM rates UNION ALL SELECT NULL, 1.0, 0.0",
)
def pr_curve(spark, sf_dir):
    return rounded(curves.pr_curve(curves.score_curve(scored_events(spark, sf_dir)), with_end=True))


PR_AUC = """steps AS (
  SELECT r, p, coalesce(lead(r) OVER (ORDER BY threshold), 0) AS r2,
    coalesce(lead(p) OVER (ORDER BY threshold), 1) AS p2 FROM rates)"""


@catalog.add(
    "pr_auc",
    f"WITH {SCORED}, {CURVE}, {RATES}, {PR_AUC} SELECT round(sum((r - r2) * (p + p2) / 2), 8) AS pr_auc FROM steps",
)
def pr_auc(spark, sf_dir):
    return rounded(curves.pr_auc(curves.score_curve(scored_events(spark, sf_dir))), 8)


@catalog.add(
    "pr_summary",
    f"WITH {SCORED}, {CURVE}, {RATES}, {PR_AUC}, near AS (SELECT threshold, p, r FROM rates "
    f"ORDER BY abs(threshold - {T}), threshold LIMIT 1) "
    "SELECT round((SELECT sum((r - r2) * (p + p2) / 2) FROM steps), 6) AS pr_auc, "
    "round((SELECT avg(label) FROM scored), 6) AS baseline, round(threshold, 6) AS threshold, "
    "round(p, 6) AS precision, round(r, 6) AS recall FROM near",
)
def pr_summary(spark, sf_dir):
    return rounded(curves.pr_summary(curves.score_curve(scored_events(spark, sf_dir)), T))


BEST = """f AS (SELECT threshold, p, r, 2 * p * r / (p + r + 1e-8) AS f1 FROM rates)
SELECT strategy, round(threshold, 6) AS threshold, round(metric, 6) AS metric FROM (
  SELECT 'maximize_f1' AS strategy, threshold, f1 AS metric, row_number() OVER (ORDER BY f1 DESC, threshold) AS k FROM f
  UNION ALL SELECT 'maximize_recall', threshold, r, row_number() OVER (ORDER BY r DESC, threshold) FROM f
  UNION ALL SELECT 'maximize_precision', threshold, p, row_number() OVER (ORDER BY p DESC, threshold) FROM f)
WHERE k = 1"""


@catalog.add("best_threshold", f"WITH {SCORED}, {CURVE}, {RATES}, {BEST}")
def best_threshold(spark, sf_dir):
    return rounded(thresholds.best_thresholds(scored_events(spark, sf_dir)))


@catalog.add("best_threshold_ties", f"WITH {TIED}, {CURVE}, {RATES}, {BEST}")
def best_threshold_ties(spark, sf_dir):
    return rounded(thresholds.best_thresholds(tied_lineitem(spark, sf_dir)))


COST = """grid AS (SELECT score AS threshold FROM scored UNION SELECT 0.0 UNION SELECT 1.0),
ties2 AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
ext AS (SELECT g.threshold, coalesce(t.pos, 0) AS pos, coalesce(t.neg, 0) AS neg
  FROM grid g LEFT JOIN ties2 t ON t.score = g.threshold),
cum AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM ext),
best AS (SELECT *, (p - tp) * 10000 + fp * 200 AS cost FROM cum ORDER BY cost, threshold LIMIT 1)"""


@catalog.add(
    "cost_threshold",
    f"WITH {SCORED}, {COST} SELECT round(threshold, 6) AS threshold, CAST(cost AS DOUBLE) AS total_cost, "
    "CAST(tp AS BIGINT) AS tp, CAST(n - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, "
    "round(tp / (p + 1e-8), 6) AS recall, round(tp / (tp + fp + 1e-8), 6) AS precision FROM best",
)
def cost_threshold(spark, sf_dir):
    return rounded(thresholds.cost_threshold(scored_events(spark, sf_dir)))


@catalog.add(
    "cost_curve",
    f"WITH {SCORED}, g AS (SELECT CAST(unnest([{GRID}]) AS DOUBLE) AS threshold) SELECT round(threshold, 6) AS threshold, "
    "CAST(sum(CASE WHEN label = 1 AND score < threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
    "CAST(sum(CASE WHEN label = 0 AND score >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
    "CAST(sum(CASE WHEN label = 1 AND score < threshold THEN 10000 WHEN label = 0 AND score >= threshold THEN 200 "
    "ELSE 0 END) AS DOUBLE) AS total_cost FROM g CROSS JOIN scored GROUP BY threshold",
)
def cost_curve(spark, sf_dir):
    return rounded(thresholds.cost_curve(scored_events(spark, sf_dir)))


@catalog.add(
    "threshold_curves",
    f"WITH {SCORED}, {CURVE}, {RATES} SELECT round(threshold, 6) AS threshold, round(p, 6) AS precision, "
    "round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-8), 6) AS f1 FROM rates",
)
def threshold_curves(spark, sf_dir):
    return rounded(curves.threshold_curves(curves.score_curve(scored_events(spark, sf_dir))))


CONFUSION = f"""m AS (SELECT
  CAST(sum(CASE WHEN label = 1 AND score >= {T} THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN label = 0 AND score >= {T} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND score < {T} THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 0 AND score < {T} THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM scored)"""


@catalog.add("confusion_matrix", f"WITH {SCORED}, {CONFUSION} SELECT * FROM m")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(scored_events(spark, sf_dir), T)


@catalog.add(
    "classification_summary",
    f"WITH {SCORED}, {CURVE}, {CONFUSION}, a AS (SELECT sum(pos * (tn + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc "
    "FROM curve) SELECT round(auc, 6) AS roc_auc, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, "
    "round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, tp, tn, fp, fn FROM m, a",
)
def classification_summary(spark, sf_dir):
    return rounded(evaluate.classification_summary(scored_events(spark, sf_dir), T))


@catalog.add(
    "classification_report",
    f"""WITH {SCORED}, {CONFUSION}, per AS (
  SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fp + fn) AS f, tn + fp AS s FROM m
  UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM m),
rep AS (
  SELECT * FROM per
  UNION ALL SELECT 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn),
    (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM m
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM per
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM per)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM rep""",
)
def classification_report(spark, sf_dir):
    return rounded(evaluate.classification_report(scored_events(spark, sf_dir), T))


def histogram_sql(high: float) -> str:
    return f"""WITH {SCORED}, b AS (SELECT unnest(range(1, 101)) AS bin),
h AS (SELECT least(100, CAST(floor(score / {high / 100!r}) AS INTEGER) + 1) AS bin, count(*) AS n
  FROM scored WHERE score >= 0 AND score <= {high} GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, CAST(round((b.bin - 1) * {high / 100!r}, 6) AS DOUBLE) AS lo, CAST(round(b.bin * {high / 100!r}, 6) AS DOUBLE) AS hi,
  coalesce(h.n, 0) AS n FROM b LEFT JOIN h ON h.bin = b.bin"""


@catalog.add("score_histogram", histogram_sql(1.0))
def score_histogram(spark, sf_dir):
    return rounded(evaluate.score_histogram(scored_events(spark, sf_dir), 0.0, 1.0))


@catalog.add("score_histogram_low", histogram_sql(0.5))
def score_histogram_low(spark, sf_dir):
    return rounded(evaluate.score_histogram(scored_events(spark, sf_dir), 0.0, 0.5))


@catalog.add(
    "business_cost",
    f"WITH {SCORED}, {CONFUSION} SELECT fn AS missed, fp AS false_alarms, "
    "CAST(fn * 10000 + fp * 200 AS DOUBLE) AS business_cost FROM m",
)
def business_cost(spark, sf_dir):
    return thresholds.cost_at(scored_events(spark, sf_dir), T)
