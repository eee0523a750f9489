"""Evaluation of a scored frame at an operating threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.functions.exprs import count_if, even_edges, inline_sql, lit_double, safe_divide
from scorewell.operators.curves import auc_aggregate, score_curve


def confusion_counts(threshold: float) -> list[Column]:
    """tp, fp, fn, tn as aggregates over a (label, score) frame."""
    flagged = F.col("score") >= F.lit(float(threshold))
    positive, negative = F.col("label") == 1, F.col("label") == 0
    return [
        count_if(positive & flagged).alias("tp"),
        count_if(negative & flagged).alias("fp"),
        count_if(positive & ~flagged).alias("fn"),
        count_if(negative & ~flagged).alias("tn"),
    ]


def confusion_matrix(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.agg(*confusion_counts(threshold))


def rates() -> tuple[Column, Column, Column]:
    """precision, recall and f1 from tp, fp, fn; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return safe_divide(tp, tp + fp), safe_divide(tp, tp + fn), safe_divide(2 * tp, 2 * tp + fp + fn)


def classification_summary(scored: DataFrame, threshold: float) -> DataFrame:
    """ROC AUC, F1, recall, precision and the four counts in one row, from one curve."""
    flagged = F.col("threshold") >= F.lit(float(threshold))
    counts = score_curve(scored).agg(
        auc_aggregate().alias("roc_auc"),
        F.coalesce(F.sum(F.when(flagged, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(flagged, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~flagged, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(~flagged, F.col("neg"))), F.lit(0)).alias("tn"),
    )
    precision, recall, f1 = rates()
    return counts.select(
        "roc_auc", f1.alias("f1"), recall.alias("recall"), precision.alias("precision"), "tp", "tn", "fp", "fn"
    )


def classification_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted rows."""
    m = confusion_matrix(scored, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn), safe_divide(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = safe_divide(tn, tn + fn), safe_divide(tn, tn + fp), safe_divide(2 * tn, 2 * tn + fp + fn)
    n1, n0 = tp + fn, tn + fp
    n = n1 + n0
    accuracy = safe_divide(tp + tn, n)

    def weighted(a: Column, b: Column) -> Column:
        return safe_divide(a * n0 + b * n1, n)

    def row(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), support.alias("support")
        )

    return m.select(
        F.inline(
            F.array(
                row("0", p0, r0, f0, n0),
                row("1", p1, r1, f1, n1),
                row("accuracy", accuracy, accuracy, accuracy, n),
                row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
                row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n),
            )
        )
    )


def score_histogram(scored: DataFrame, low: float = 0.0, high: float = 1.0, bins: int = 100) -> DataFrame:
    """Scores counted in equal bins over [low, high]; empty bins are kept."""
    edges = even_edges(low, high, bins)
    width = (high - low) / bins
    slot = F.least(F.lit(bins), F.floor((F.col("score") - F.lit(low)) / F.lit(width)).cast("int") + 1)
    counted = (
        scored.where((F.col("score") >= low) & (F.col("score") <= high))
        .groupBy(slot.alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    rows = [f"struct({i + 1} AS bin, {lit_double(edges[i])} AS lo, {lit_double(edges[i + 1])} AS hi)" for i in range(bins)]
    frame = scored.sparkSession.range(1).selectExpr(inline_sql(rows))
    return frame.join(F.broadcast(counted), "bin", "left").select(
        "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n")
    )
