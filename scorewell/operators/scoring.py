"""Decisions, bands and batch summaries on scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.functions.bands import class_label, risk_band_fixed, risk_band_local, risk_band_relative, score_percent
from scorewell.functions.exprs import count_if

DEGENERATE_STD = 0.01
LOSS_PER_POSITIVE = 10_000
BANDS = {"fixed": risk_band_fixed, "local": risk_band_local}


def decide(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Add ``prediction``: 1 where the score reaches the threshold."""
    return scored.withColumn("prediction", (F.col(score) >= F.lit(float(threshold))).cast("int"))


def add_risk_band(scored: DataFrame, kind: str = "relative", threshold: float = 0.5, score: str = "score") -> DataFrame:
    """Add ``risk_level`` on the scale relative to the threshold, the fixed or the local one."""
    if kind == "relative":
        band = risk_band_relative(F.col(score), threshold)
    else:
        band = BANDS[kind](F.col(score))
    return scored.withColumn("risk_level", band)


def format_scores(predicted: DataFrame, style: str = "universal", digits: int = 4, score: str = "score") -> DataFrame:
    """Add the score in percent and the text of the predicted class."""
    return predicted.withColumns(
        {"score_percent": score_percent(F.col(score), digits), "label_text": class_label(F.col("prediction"), style)}
    )


def batch_summary(predicted: DataFrame, loss: float = LOSS_PER_POSITIVE, score: str = "score") -> DataFrame:
    """Rows, positives, their share in percent, money at risk, and whether all scores are alike."""
    positives = count_if(F.col("prediction") == 1)
    return predicted.agg(
        F.count("*").alias("total"),
        positives.alias("positives"),
        F.coalesce(F.try_divide(positives * 100.0, F.count("*")), F.lit(0.0)).alias("positive_rate_pct"),
        (positives * F.lit(loss)).cast("double").alias("estimated_risk"),
        F.stddev_pop(score).alias("score_std"),
        F.coalesce(F.stddev_pop(score) < DEGENERATE_STD, F.lit(False)).alias("degenerate"),
    )


def top_risky(scored: DataFrame, keys: Sequence[str], n: int = 100, score: str = "score") -> DataFrame:
    """The ``n`` rows with the highest score; the key columns settle ties."""
    return scored.orderBy(F.col(score).desc(), *[F.col(k) for k in keys]).limit(n)
