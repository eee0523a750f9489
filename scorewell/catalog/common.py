"""Input frames shared by the registered queries, and the same frames as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewell.operators.curves import scored_frame

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name, each with the SQL it must agree with (or none)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that the order in which floats were summed does not show."""
    return df.select(
        *[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def scored_events(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Events as a scored frame: the score is the value as a share of 500, a positive a large
    value that is no error."""
    events = table(spark, sf_dir, "events")
    label = (F.col("value") > 60) & (F.col("event_type") != "error")
    return scored_frame(events, label, F.col("value") / 500, *keep)


SCORED = """scored AS (
  SELECT event_id, CAST(value > 60 AND event_type <> 'error' AS INTEGER) AS label, value / 500 AS score FROM events)"""


def tied_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a scored frame with eleven distinct scores, so that nearly all rows tie."""
    items = table(spark, sf_dir, "lineitem")
    return scored_frame(items, F.col("l_returnflag") == "R", F.col("l_discount") * 10)


TIED = """scored AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_discount * 10 AS score FROM lineitem)"""

CURVE = """ties AS (
  SELECT score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
curve AS (
  SELECT threshold, pos, neg,
    sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
    sum(pos) OVER () - sum(pos) OVER (ORDER BY threshold DESC) AS fn,
    sum(neg) OVER () - sum(neg) OVER (ORDER BY threshold DESC) AS tn
  FROM ties)"""

RATES = """rates AS (
  SELECT *, tp / (tp + fp) AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS r FROM curve)"""
