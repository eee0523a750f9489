"""Choosing a decision threshold: by F1, recall or precision, or by money."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewell.functions.exprs import c, count_if, lit_double
from scorewell.operators.curves import cost_grid, f1_of, precision_of, recall_of, score_curve

# Strategy names, default costs per missed positive and per false alarm, epsilon.
STRATEGIES = ["maximize_f1", "maximize_recall", "maximize_precision"]
MISS_COST = 10_000
FALSE_ALARM_COST = 200
RATE_EPSILON = 1e-8


def best_thresholds(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per strategy: its best threshold (the lowest among equals) and the metric there."""
    p, r = precision_of(), recall_of()
    metrics = dict(zip(STRATEGIES, [f1_of(p, r), r, p]))
    best = score_curve(scored, label, score).agg(
        *[
            F.max(F.struct(metric.alias("metric"), (-F.col("threshold")).alias("minus_threshold"))).alias(name)
            for name, metric in metrics.items()
        ]
    )
    rows = [
        F.struct(
            F.lit(name).alias("strategy"),
            (-F.col(f"{name}.minus_threshold")).alias("threshold"),
            F.col(f"{name}.metric").alias("metric"),
        )
        for name in STRATEGIES
    ]
    return best.select(F.inline(F.array(*rows)))


def best_threshold(
    scored: DataFrame, strategy: str = "maximize_f1", label: str = "label", score: str = "score"
) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    return best_thresholds(scored, label, score).where(F.col("strategy") == strategy)


def total_cost(fn: Column, fp: Column, miss_cost: float, alarm_cost: float) -> Column:
    return fn * F.lit(miss_cost) + fp * F.lit(alarm_cost)


def cost_threshold(
    scored: DataFrame,
    miss_cost: float = MISS_COST,
    alarm_cost: float = FALSE_ALARM_COST,
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """The threshold with the least total cost among 0, every score and 1; the lowest among equals.

    A threshold where labels and predictions are all of one class is passed over, so the result
    is empty when no threshold qualifies.
    """
    curve = score_curve(scored, label, score, add_scores=(0.0, 1.0))
    positives, negatives = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    one_class = ((positives == 0) & (F.col("fp") == 0)) | ((negatives == 0) & (F.col("fn") == 0))
    ranked = F.struct(
        total_cost(F.col("fn"), F.col("fp"), miss_cost, alarm_cost).alias("cost"), "threshold", "tp", "tn", "fp", "fn"
    )
    best = curve.where(~one_class).agg(F.min(ranked).alias("b")).where(F.col("b").isNotNull()).select("b.*")
    return best.select(
        "threshold",
        F.col("cost").cast("double").alias("total_cost"),
        "tp",
        "tn",
        "fp",
        "fn",
        (F.col("tp") / (F.col("tp") + F.col("fn") + RATE_EPSILON)).alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp") + RATE_EPSILON)).alias("precision"),
    )


def choose_threshold(
    scored: DataFrame,
    objective: str = "cost",
    manual: float | None = None,
    miss_cost: float = MISS_COST,
    alarm_cost: float = FALSE_ALARM_COST,
) -> float:
    """The operating threshold: a manual one first, else by cost, else by the named metric."""
    if manual is not None:
        return float(manual)
    if objective == "cost":
        row = cost_threshold(scored, miss_cost, alarm_cost).first()
        if row is None:
            raise ValueError("no valid threshold: the labels do not hold both classes")
    else:
        row = best_threshold(scored, f"maximize_{objective}").first()
    return float(row["threshold"])


def cost_curve(
    scored: DataFrame,
    miss_cost: float = MISS_COST,
    alarm_cost: float = FALSE_ALARM_COST,
    steps: int = 200,
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """Total cost at evenly spaced thresholds, from one aggregation to ``steps + 1`` rows."""
    grid = cost_grid(steps)
    slotted = Bucketizer(
        splits=[float("-inf"), *grid, float("inf")], inputCol="score", outputCol="slot", handleInvalid="skip"
    ).transform(scored.select(c(label).alias("label"), c(score).cast("double").alias("score")))
    counts = slotted.groupBy(F.col("slot").cast("int").alias("slot")).agg(
        count_if(F.col("label") == 1).alias("pos"), count_if(F.col("label") == 0).alias("neg")
    )
    marks = ", ".join(lit_double(t) for t in [float("-inf"), *grid])
    points = scored.sparkSession.range(1).selectExpr(f"posexplode(array({marks})) AS (slot, threshold)")
    # At most steps + 1 rows from here on.
    filled = points.join(F.broadcast(counts), "slot", "left").na.fill(0, ["pos", "neg"])
    below = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy("slot").rowsBetween(0, Window.unboundedFollowing)
    totals = filled.select(
        "slot", "threshold", F.sum("pos").over(below).alias("fn"), F.sum("neg").over(above).alias("fp")
    )
    return totals.where(F.col("slot") > 0).select(
        "threshold", "fn", "fp", total_cost(F.col("fn"), F.col("fp"), miss_cost, alarm_cost).cast("double").alias("total_cost")
    )


def cost_at(scored: DataFrame, threshold: float, miss_cost: float = MISS_COST, alarm_cost: float = FALSE_ALARM_COST) -> DataFrame:
    """Money lost at one threshold: missed positives and false alarms."""
    flagged = F.col("score") >= F.lit(float(threshold))
    counts = scored.agg(
        count_if((F.col("label") == 1) & ~flagged).alias("missed"),
        count_if((F.col("label") == 0) & flagged).alias("false_alarms"),
    )
    return counts.withColumn(
        "business_cost", total_cost(F.col("missed"), F.col("false_alarms"), miss_cost, alarm_cost).cast("double")
    )

