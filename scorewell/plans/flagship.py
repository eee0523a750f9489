"""Which threshold costs least, and what does it flag?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.operators.scoring import add_risk_band, decide
from scorewell.operators.thresholds import FALSE_ALARM_COST, MISS_COST, choose_threshold


def cheapest_threshold_report(
    scored: DataFrame, miss_cost: float = MISS_COST, alarm_cost: float = FALSE_ALARM_COST
) -> DataFrame:
    """Rows, positives and money at risk per risk band, decided at the threshold of least cost."""
    threshold = choose_threshold(scored, "cost", miss_cost=miss_cost, alarm_cost=alarm_cost)
    banded = add_risk_band(decide(scored, threshold), "relative", threshold)
    return (
        banded.groupBy("risk_level")
        .agg(
            F.count("*").alias("total"),
            F.sum("prediction").alias("flagged"),
            F.sum("label").alias("positives"),
            F.avg("score").alias("avg_score"),
        )
        .withColumn("threshold", F.lit(threshold))
    )


