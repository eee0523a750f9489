"""The prediction log and the alert log: append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewell.sources.tables import as_json

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("input_json", T.StringType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("probability", T.DoubleType()),
    ]
)
ALERT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The log, or an empty frame when nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def next_id(spark: SparkSession, path: str, schema: T.StructType) -> int:
    row = read_log(spark, path, schema).agg(F.max("id").alias("top")).first()
    return 0 if row["top"] is None else row["top"] + 1


def prediction_rows(
    scored: DataFrame,
    features: Sequence[str],
    score: str = "score",
    prediction: str = "prediction",
    ts: str | None = None,
    id_col: str | None = None,
    start_id: int = 0,
) -> DataFrame:
    """Scored rows in the shape of the log. Ids rise within a batch but are not dense; pass
    ``id_col`` to keep the rows' own."""
    ident = F.col(id_col) if id_col else F.monotonically_increasing_id() + F.lit(start_id)
    stamp = F.col(ts) if ts else F.localtimestamp()
    return scored.select(
        ident.cast("long").alias("id"),
        stamp.cast("timestamp_ntz").alias("ts"),
        as_json(scored, features).alias("input_json"),
        F.col(prediction).cast("int").alias("prediction"),
        F.col(score).cast("double").alias("probability"),
    )


def append_prediction_log(scored: DataFrame, path: str, features: Sequence[str], **columns) -> None:
    """Append a scored batch as one write, after the ids already there unless it has its own."""
    spark = scored.sparkSession
    if not columns.get("id_col"):
        columns.setdefault("start_id", next_id(spark, path, PREDICTION_SCHEMA))
    prediction_rows(scored, features, **columns).write.mode("append").parquet(path)


def append_alert_log(alerts: DataFrame, path: str) -> None:
    """Append alerts (ts, name, severity, message, extra) with new ids."""
    start = next_id(alerts.sparkSession, path, ALERT_SCHEMA)
    ident = (F.monotonically_increasing_id() + F.lit(start)).alias("id")
    alerts.select(ident, F.col("ts").cast("timestamp_ntz").alias("ts"), "name", "severity", "message", "extra").write.mode(
        "append"
    ).parquet(path)


def write_alert_lines(alerts: DataFrame, path: str) -> None:
    """Append alerts as JSON lines, the extra facts as a nested object."""
    alerts.select("ts", "name", "severity", "message", "extra").write.mode("append").json(path)


def clear_log(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """Empty a log; returns how many rows it had."""
    n = read_log(spark, path, schema).count()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return n
