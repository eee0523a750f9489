"""Prediction streams by key: statistics and drift per event-time window, rules on closed windows, cooldown with timers.

Two stateful steps. The first is a windowed aggregation: tasks fold their rows before the shuffle, so a key with most of
the predictions costs a row per task and window, and a window leaves the state when the watermark has passed its end.
The second sees one row per closed window and fired rule, and keeps one time per (key, rule) until a timer
says that its cooldown is over.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scorewell.functions.exprs import c, lit_double, lit_text
from scorewell.operators.drift import MIN_VALUES, PSI_BINS, PSI_THRESHOLD, drift_status, psi_sql, with_bins
from scorewell.operators.monitor import COOLDOWN_SECONDS, DRIFT_FIELDS, fired_rules, micros, summary_aggregates
from scorewell.streaming.alerts import sends

#: Processors with timers need a state store that keeps several variables a key.
STORE = "spark.sql.streaming.stateStore.providerClass"
STORE_CLASS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERTS = "key string, name string, severity string, message string, extra string, window_end timestamp, t long, sent boolean"


def drift_struct(facts: dict[str, dict], psi_threshold: float = PSI_THRESHOLD) -> str:
    """A drift summary as SQL, from the columns ``c0``, ``c1``, ... (counts in the reference's bins) and ``n0``, ... (values).

    A feature drifts by its PSI alone; one with few values in the window is not counted.
    """
    each = ", ".join(
        f"if(n{i} >= {MIN_VALUES}, struct({lit_text(f)} AS feature, round({psi_sql(f'c{i}', f'n{i}', fact)}, 4) AS psi), null)"
        for i, (f, fact) in enumerate(facts.items())
    )
    return f"transform(array_compact(array({each})), x -> struct(x.feature AS feature, x.psi >= {lit_double(psi_threshold)} AS drifted))"


def keyed_windows(log: DataFrame, key: str, facts: dict[str, dict], width: str, psi_threshold: float = PSI_THRESHOLD) -> DataFrame:
    """(key, w, statistics, d) per key and tumbling window of ``ts``; for tables and streams.

    ``log`` has prediction, probability, ts and the features of ``facts``, the facts of a drift reference. ``d`` is the drift summary of
    the window against it. Rows without a time are in no window; a null key is a key of its own.
    """
    rows = with_bins(log, facts, [key, "ts", "prediction", "probability"])
    counts = []
    for i in range(len(facts)):
        bins = ", ".join(f"count_if(b{i} = {k})" for k in range(1, PSI_BINS + 1))
        counts += [F.expr(f"array({bins})").alias(f"c{i}"), F.expr(f"count(v{i})").alias(f"n{i}")]
    statistics = summary_aggregates()[:6]
    found = rows.groupBy(c(key).cast("string").alias("key"), F.window("ts", width).alias("w")).agg(*statistics, *counts)
    kept = [x for x in found.columns if x[1:] not in {str(i) for i in range(len(facts))}]
    if not facts:
        return found.select(*kept)
    known = found.select(*kept, F.expr(drift_struct(facts, psi_threshold)).alias("per"))
    names = "transform(filter(per, x -> x.drifted), x -> x.feature)"
    named = known.select(*kept, F.expr(f"array_sort({names})").alias("names"), F.size("per").cast("long").alias("total_features"))
    ratio = F.coalesce(F.try_divide(F.size("names").cast("double"), F.col("total_features")), F.lit(0.0))
    fields = {
        "drift_ratio": F.round(ratio, 3), "drifted_count": F.size("names").cast("long"), "total_features": F.col("total_features"),
        "drifted_features": F.array_join("names", ","), "status": drift_status(ratio),
    }
    return named.select(*kept, F.struct(*[fields[x].alias(x) for x in DRIFT_FIELDS]).alias("d"))


class Cooldown(StatefulProcessor):
    """Marks the alerts of one (key, rule) that go out; the time of the newest send is forgotten when it holds nothing back any more."""

    def __init__(self, seconds: int) -> None:
        self.cooldown = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        alerts = pd.concat(list(rows)).sort_values("t", kind="stable")
        before = self.last.get()[0] if self.last.exists() else None
        sent, last = sends(alerts["t"].to_numpy(), before, self.cooldown)
        if last != before:
            self.last.update((last,))
            self.handle.registerTimer(-(-(last + self.cooldown) // 1000))
        yield alerts.assign(sent=sent)[[x.split()[0] for x in ALERTS.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A later send has set a timer of its own.
        if self.last.exists() and self.last.get()[0] + self.cooldown <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def monitored_alerts(
    stream: DataFrame,
    key: str,
    facts: dict[str, dict],
    width: str,
    watermark: str,
    cooldown_seconds: int = COOLDOWN_SECONDS,
    psi_threshold: float = PSI_THRESHOLD,
    **limits: float,
) -> DataFrame:
    """A stream of alerts, one row per closed window and fired rule, with ``sent`` false for those within the cooldown of an earlier one.

    A prediction whose window the watermark had passed before its micro-batch began is dropped. ``limits`` are those of ``fired_rules``.
    """
    windows = keyed_windows(stream.withWatermark("ts", watermark), key, facts, width, psi_threshold)
    fired = fired_rules(windows.where("key IS NOT NULL"), width, ["key", "w"], **limits)
    rows = fired.select(
        "key", "name", "severity", "message", F.to_json("extra").alias("extra"), F.col("w.end").alias("window_end"),
        micros(F.col("w.end")).alias("t"), F.window_time("w").alias("closed"),
    )
    return rows.groupBy("key", "name").transformWithStateInPandas(
        statefulProcessor=Cooldown(cooldown_seconds), outputStructType=ALERTS, outputMode="Append", timeMode="EventTime"
    )


@contextmanager
def _keyed_store(spark: SparkSession) -> Iterator[None]:
    """A query takes the settings of its session when it starts."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, STORE_CLASS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def write_alerts(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the alerts to parquet files; a query that starts again goes on where the last one ended."""
    with _keyed_store(alerts.sparkSession):
        return (
            alerts.writeStream.outputMode("append")
            .format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
