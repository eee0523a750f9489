"""Score curves: confusion counts at every distinct score, and the curves read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.functions.exprs import c, even_edges, safe_divide
from scorewell.operators.prefix import quantile_cuts, running_totals, with_ranges

F1_EPSILON = 1e-8


def scored_frame(df: DataFrame, label: Column, score: Column, *keep: str) -> DataFrame:
    """The input of every metric here: ``label`` 0/1 and ``score`` in [0, 1], plus kept columns."""
    return df.select(*keep, label.cast("int").alias("label"), score.cast("double").alias("score"))


def score_curve(scored: DataFrame, label: str = "label", score: str = "score", add_scores: tuple = ()) -> DataFrame:
    """One row per distinct score with tp, fp, fn, tn for the rule ``score >= threshold``.

    Equal scores are folded before the shuffle, so a score shared by a third of the rows costs one
    row per task. ``add_scores`` puts further thresholds in, with no rows of their own.
    """
    rows = scored.select(
        c(score).cast("double").alias("threshold"),
        (c(label) == 1).cast("long").alias("pos"),
        (c(label) == 0).cast("long").alias("neg"),
    ).where(F.col("threshold").isNotNull() & ~F.isnan("threshold") & c(label).isNotNull())
    cuts = quantile_cuts(rows, ["threshold"])
    if add_scores:
        zero = F.lit(0).cast("long")
        extra = scored.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(float(v)) for v in add_scores])).alias("threshold"),
            zero.alias("pos"),
            zero.alias("neg"),
        )
        rows = rows.unionByName(extra)
    ties = rows.groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    run = running_totals(with_ranges(ties, cuts), "threshold", ["pos", "neg"], "threshold__range")
    return run.select(
        "threshold",
        "pos",
        "neg",
        (F.col("pos_total") - F.col("pos_before")).alias("tp"),
        (F.col("neg_total") - F.col("neg_before")).alias("fp"),
        F.col("pos_before").alias("fn"),
        F.col("neg_before").alias("tn"),
    )


def precision_of(tp: str = "tp", fp: str = "fp") -> Column:
    return safe_divide(F.col(tp), F.col(tp) + F.col(fp))


def recall_of(tp: str = "tp", fn: str = "fn") -> Column:
    """Recall; 1 at every threshold when there are no positives, as usual for PR curves."""
    return safe_divide(F.col(tp), F.col(tp) + F.col(fn), default=1.0)


def f1_of(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / (precision + recall + F1_EPSILON)


def roc_curve(curve: DataFrame, with_start: bool = False) -> DataFrame:
    """False and true positive rate per threshold; ``with_start`` adds the (0, 0) point at +inf."""
    points = curve.select(
        "threshold",
        safe_divide(F.col("fp"), F.col("fp") + F.col("tn"), float("nan")).alias("fpr"),
        safe_divide(F.col("tp"), F.col("tp") + F.col("fn"), float("nan")).alias("tpr"),
    )
    if not with_start:
        return points
    start = curve.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def auc_aggregate() -> Column:
    """Exact area under the ROC curve: ties count half; null when a class is absent."""
    wide = "decimal(38,0)"
    wins = F.sum(F.col("pos").cast(wide) * (2 * F.col("tn") + F.col("neg")).cast("decimal(20,0)"))
    pairs = 2.0 * F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.try_divide(wins.cast("double"), pairs))


def roc_auc(curve: DataFrame) -> DataFrame:
    return curve.agg(
        auc_aggregate().alias("roc_auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )


def pr_curve(curve: DataFrame, with_end: bool = False) -> DataFrame:
    """Precision and recall per threshold; ``with_end`` adds the closing point (recall 0, precision 1)."""
    points = curve.select("threshold", precision_of().alias("precision"), recall_of().alias("recall"))
    if not with_end:
        return points
    end = curve.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def pr_auc_aggregate() -> Column:
    """Trapezoid area under precision against recall.

    The next point up the score order is this row's own counts less its ties, so every slice
    needs its own row only. Above the top score the curve ends at precision 1.
    """
    ahead_tp, ahead_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    ahead = F.coalesce(F.try_divide(ahead_tp.cast("double"), (ahead_tp + ahead_fp).cast("double")), F.lit(1.0))
    slices = F.sum(F.col("pos") * (precision_of() + ahead) / 2)
    return F.try_divide(slices, F.sum("pos").cast("double"))


def pr_auc(curve: DataFrame) -> DataFrame:
    return curve.agg(pr_auc_aggregate().alias("pr_auc"))


def pr_summary(curve: DataFrame, threshold: float) -> DataFrame:
    """PR area, the share of positives as baseline, and the curve point next to ``threshold``."""
    point = F.struct(
        F.abs(F.col("threshold") - F.lit(float(threshold))).alias("gap"),
        "threshold",
        precision_of().alias("precision"),
        recall_of().alias("recall"),
    )
    return curve.agg(
        pr_auc_aggregate().alias("pr_auc"),
        safe_divide(F.sum("pos"), F.sum(F.col("pos") + F.col("neg"))).alias("baseline"),
        F.min(point).alias("near"),
    ).select(
        "pr_auc",
        "baseline",
        F.col("near.threshold").alias("threshold"),
        F.col("near.precision").alias("precision"),
        F.col("near.recall").alias("recall"),
    )


def threshold_curves(curve: DataFrame) -> DataFrame:
    """F1, precision and recall at every threshold."""
    p, r = precision_of(), recall_of()
    return curve.select("threshold", p.alias("precision"), r.alias("recall"), f1_of(p, r).alias("f1"))


def cost_grid(steps: int = 200, low: float = 0.01, high: float = 0.99) -> list[float]:
    """Evenly spaced thresholds from ``low`` to ``high``, both included."""
    return even_edges(low, high, steps - 1)
