"""Transaction features from a time in seconds and an amount."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.functions.exprs import as_double

# Seconds in a day and an hour, the night hours, the high amount.
DAY_SECONDS = 86_400
HOUR_SECONDS = 3_600
NIGHT_BEFORE, NIGHT_AFTER = 6, 22
HIGH_AMOUNT = 1_000
SCORING_EPSILON = 1e-8


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 of a timestamp's wall clock, in any session time zone."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * DAY_SECONDS + F.hour(ts) * HOUR_SECONDS + F.minute(ts) * 60 + F.second(ts)


def hour_of_day(seconds: Column) -> Column:
    return F.pmod(seconds.cast("double"), F.lit(float(DAY_SECONDS))) / HOUR_SECONDS


def night_flag(hour: Column) -> Column:
    return ((hour < NIGHT_BEFORE) | (hour > NIGHT_AFTER)).cast("int")


def high_amount(amount: Column) -> Column:
    return (amount > HIGH_AMOUNT).cast("int")


@dataclass(frozen=True)
class AmountScale:
    """Mean and sample deviation of the amounts a model was trained on."""

    mean: float | None
    std: float | None
    epsilon: float = 0.0

    def zscore(self, amount: Column) -> Column:
        centre, spread = F.lit(self.mean).cast("double"), F.lit(self.std).cast("double")
        return F.try_divide(amount - centre, spread + F.lit(self.epsilon))


def fit_amount_scale(df: DataFrame, amount: str = "Amount", epsilon: float = 0.0) -> AmountScale:
    """One aggregation over the amount column alone. A single row has no deviation: read as 0."""
    value = as_double(df, amount)
    row = df.agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std")).first()
    return AmountScale(row["mean"], row["std"], epsilon)


def engineer_features(
    df: DataFrame, time: str = "Time", amount: str = "Amount", scale: AmountScale | None = None
) -> DataFrame:
    """Add Hour, Night_txn, Amount_log, Amount_zscore and High_amount.

    Pass the ``scale`` fitted on training rows when scoring; without it the frame's own is fitted.
    """
    scale = scale or fit_amount_scale(df, amount)
    value = as_double(df, amount)
    hour = hour_of_day(F.col(time))
    return df.select(
        "*",
        hour.alias("Hour"),
        night_flag(hour).alias("Night_txn"),
        F.log1p(value).alias("Amount_log"),
        scale.zscore(value).alias("Amount_zscore"),
        high_amount(value).alias("High_amount"),
    )
