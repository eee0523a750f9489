"""A stream that scores rows, logs them, and raises alerts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from scorewell.operators.monitor import COOLDOWN_SECONDS, LAST_PREDICTIONS, alert_rules, rolling_summary, route_alerts
from scorewell.sources.logs import PREDICTION_SCHEMA, prediction_rows, read_log

ALERT_COLUMNS = ["ts", "name", "severity", "message", "extra"]
SENT_SCHEMA = "name string, last_sent timestamp_ntz"


@dataclass
class ScoringStream:
    """Micro-batches: score, append to the log, evaluate the rules on the newest predictions,
    route by severity, hold back repeats within the cooldown, write what goes out.

    Everything a micro-batch writes goes into its own partition, which a rerun after a failure
    replaces, so no prediction or alert is written twice.
    """

    scorer: Callable[[DataFrame], DataFrame]
    folder: str
    features: Sequence[str]
    id_col: str
    ts_col: str
    last_n: int = LAST_PREDICTIONS
    min_severity: str = "INFO"
    cooldown_seconds: int = COOLDOWN_SECONDS

    @property
    def log_path(self) -> str:
        return f"{self.folder}/predictions"

    @property
    def alert_path(self) -> str:
        return f"{self.folder}/alerts"

    def log(self, spark: SparkSession) -> DataFrame:
        return read_log(spark, self.log_path, PREDICTION_SCHEMA)

    def alerts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(
            "ts timestamp_ntz, name string, severity string, message string, extra map<string,string>, epoch long"
        ).json(self.alert_path)

    def _carried(self, spark: SparkSession, name: str, schema: T.StructType | str, epoch: int) -> DataFrame:
        """What the micro-batch before this one left under ``name``."""
        try:
            return spark.read.schema(schema).parquet(f"{self.folder}/{name}/epoch={epoch - 1}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    def handle(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = prediction_rows(self.scorer(batch), self.features, ts=self.ts_col, id_col=self.id_col)
        rows.write.mode("overwrite").parquet(f"{self.log_path}/epoch={epoch}")
        # The newest predictions are carried along, so the growing log is never read again.
        written = spark.read.schema(PREDICTION_SCHEMA).parquet(f"{self.log_path}/epoch={epoch}").drop("input_json")
        tail_schema = written.schema
        both = written.unionByName(self._carried(spark, "tail", tail_schema, epoch))
        tail_path = f"{self.folder}/tail/epoch={epoch}"
        both.orderBy(F.col("id").desc()).limit(self.last_n).coalesce(1).write.mode("overwrite").parquet(tail_path)
        summary = rolling_summary(spark.read.schema(tail_schema).parquet(tail_path), self.last_n)
        fired = alert_rules(summary, last_n=self.last_n)
        routed = route_alerts(fired.withColumn("ts", summary.select("window_end").scalar()), self.min_severity).where("routed")
        before = self._carried(spark, "sent", SENT_SCHEMA, epoch)
        seconds = F.expr(f"INTERVAL '{self.cooldown_seconds}' SECOND")
        held = F.col("last_sent").isNotNull() & (F.col("ts") < F.col("last_sent") + seconds)
        # At most one alert per rule, joined with one row per rule that has gone out before.
        alert_path = f"{self.alert_path}/epoch={epoch}"
        out = routed.join(before, "name", "left").where(~held).select(*ALERT_COLUMNS)
        out.coalesce(1).write.mode("overwrite").json(alert_path)
        sent = spark.read.schema("name string, ts timestamp_ntz").json(alert_path).withColumnRenamed("ts", "last_sent")
        latest = before.unionByName(sent).groupBy("name").agg(F.max("last_sent").alias("last_sent"))
        latest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sent/epoch={epoch}")

    def start(self, stream: DataFrame) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.handle)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
