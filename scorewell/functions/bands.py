"""Risk bands and display columns for scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut points and labels of the three risk scales.
RELATIVE_CUTS = {"low": 0.25, "medium": 0.75}
FIXED_EDGES = [0.2, 0.5, 0.8, 1.0]
FIXED_LABELS = ["Low", "Medium", "High", "Critical"]
LOCAL_CUTS = {"high": 0.7, "medium": 0.3}
CLASS_LABELS = {"universal": ("NEGATIVE", "POSITIVE"), "fraud": ("Legitimate", "Fraud")}


def risk_band_relative(score: Column, threshold: float | Column) -> Column:
    """Low / Medium / High, cut at a quarter and three quarters of the decision threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (
        F.when(score < t * RELATIVE_CUTS["low"], "Low")
        .when(score < t * RELATIVE_CUTS["medium"], "Medium")
        .otherwise("High")
    )


def risk_band_fixed(score: Column) -> Column:
    """Low to Critical over right-closed ranges, 0 counted as Low; "nan" outside [0, 1]."""
    band = F.when(score.isNull() | F.isnan(score) | (score < 0), "nan")
    for edge, label in zip(FIXED_EDGES, FIXED_LABELS):
        band = band.when(score <= edge, label)
    return band.otherwise("nan")


def risk_band_local(score: Column) -> Column:
    return F.when(score > LOCAL_CUTS["high"], "HIGH").when(score > LOCAL_CUTS["medium"], "MEDIUM").otherwise("LOW")


def class_label(prediction: Column, style: str = "universal") -> Column:
    negative, positive = CLASS_LABELS[style]
    return F.when(prediction == 1, positive).otherwise(negative)


def score_percent(score: Column, digits: int = 4) -> Column:
    return F.round(score * 100, digits)
