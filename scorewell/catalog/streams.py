"""Streaming queries, each run to the end of its input and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewell.catalog import monitoring as m
from scorewell.catalog.common import Catalog, rounded, table
from scorewell.operators.drift import drift_fit
from scorewell.session import fresh_path
from scorewell.streaming.alerts import stream_cooldown
from scorewell.streaming.monitored import monitored_alerts, write_alerts
from scorewell.streaming.scoring import ScoringStream
from scorewell.streaming.windows import read_stream, read_windows, stream_windows, write_all_windows, write_closed_windows

catalog = Catalog()


def event_stream(spark, sf_dir):
    return read_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")


def log_stream(spark, sf_dir):
    e = event_stream(spark, sf_dir)
    p = F.col("value") / 500
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (p >= 0.3).cast("int").alias("prediction"),
        p.alias("probability"),
    )


@catalog.add("windowed_fraud_rate_stream", m.catalog.sql["windowed_fraud_rate"])
def windowed_fraud_rate_stream(spark, sf_dir):
    path, check = fresh_path(spark, "windows"), fresh_path(spark, "check")
    windows = stream_windows(log_stream(spark, sf_dir), "1 hour")
    write_all_windows(windows, path, check).awaitTermination()
    return rounded(m.text_times(read_windows(spark, path, windows.schema), "window_start", "window_end"))


def closed_sql(name):
    """Of a query over windows, those that end an hour or more before the last event."""
    return (
        f"SELECT w.* FROM ({m.catalog.sql[name]}) w "
        "WHERE CAST(w.window_end AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
    )


def closed_windows(spark, sf_dir, slide=None):
    path, check = fresh_path(spark, "windows"), fresh_path(spark, "check")
    windows = stream_windows(log_stream(spark, sf_dir), "1 hour", slide, "1 hour")
    write_closed_windows(windows, path, check).awaitTermination()
    return rounded(m.text_times(spark.read.schema(windows.schema).parquet(path), "window_start", "window_end"))


@catalog.add("closed_windows_stream", closed_sql("windowed_fraud_rate"))
def closed_windows_stream(spark, sf_dir):
    return closed_windows(spark, sf_dir)


@catalog.add("closed_windows_sliding_stream", closed_sql("windowed_fraud_rate_sliding"))
def closed_windows_sliding_stream(spark, sf_dir):
    return closed_windows(spark, sf_dir, "15 minutes")


@catalog.add("alert_cooldown_stream", m.catalog.sql["alert_cooldown"])
def alert_cooldown_stream(spark, sf_dir):
    e = event_stream(spark, sf_dir)
    alerts = e.select(F.col("event_type").alias("name"), F.col("event_id").alias("id"), "ts")
    path, check = fresh_path(spark, "cooldown"), fresh_path(spark, "check")
    query = (
        stream_cooldown(alerts, 3000)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", check)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(path).select("id", "name", "sent")


@catalog.add(
    "scoring_stream",
    "SELECT (SELECT count(*) FROM events) AS predictions, CAST((SELECT sum(CASE WHEN value / 500 >= 0.3 THEN 1 ELSE 0 END) FROM events) AS BIGINT) AS positives, "
    "(SELECT CAST(avg(CASE WHEN value / 500 >= 0.3 THEN 1 ELSE 0 END) > 0.3 AS BIGINT) + CAST(avg(value / 500) < 0.6 AS BIGINT) "
    "FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 100)) AS alerts",
)
def scoring_stream(spark, sf_dir):
    job = ScoringStream(
        scorer=lambda df: df.withColumn("score", F.col("value") / 500).withColumn("prediction", (F.col("score") >= 0.3).cast("int")),
        folder=fresh_path(spark, "scoring"),
        features=["value", "event_type"],
        id_col="event_id",
        ts_col="ts",
    )
    job.start(event_stream(spark, sf_dir)).awaitTermination()
    log = job.log(spark).agg(F.count("*").alias("predictions"), F.sum("prediction").alias("positives"))
    return log.withColumn("alerts", job.alerts(spark).agg(F.count("*").alias("n")).scalar())


# The events reach the monitored stream in three deliveries of ten days each; a tenth of each comes with the next one.
DELIVERIES = 3
OWN_DELIVERY = "CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 1 WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 2 ELSE 3 END"
DELIVERY = f"least({DELIVERIES}, {OWN_DELIVERY} + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)"
#: What the stream sees: purchases are dearer than in the reference.
STREAMED = "value * CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END"
MONITORED = ["value", "user_id"]

MONITORED_SQL = f"""WITH RECURSIVE refs AS (
  SELECT 'value' AS feature, value AS x FROM events UNION ALL SELECT 'user_id', user_id FROM events),
ends AS (SELECT feature, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi, count(*) AS n_ref FROM refs GROUP BY feature),
edges AS (SELECT feature, i, CASE WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10) END AS e FROM ends, (SELECT unnest(range(0, 11)) AS i)),
bins AS (SELECT a.feature, a.i + 1 AS bin, a.e AS low, b.e AS high FROM edges a JOIN edges b ON b.feature = a.feature AND b.i = a.i + 1),
ref AS (SELECT b.feature, b.bin, count(x) AS n FROM bins b LEFT JOIN refs r
  ON r.feature = b.feature AND x >= low AND (x < high OR bin = 10 AND x <= high) GROUP BY ALL),
sent AS (SELECT event_type AS key, ts, {DELIVERY} AS delivery, {STREAMED} AS value, user_id,
  make_timestamp(CAST((floor(epoch(ts) / 432000) + 1) * 432000000000 AS BIGINT)) AS window_end FROM events),
marks AS (SELECT d AS delivery, (SELECT max(ts) FROM sent WHERE delivery < d) - INTERVAL 1 DAY AS mark FROM range(1, {DELIVERIES + 2}) t(d)),
timely AS (SELECT s.* FROM sent s JOIN marks m USING (delivery) WHERE mark IS NULL OR window_end > mark),
closed AS (SELECT t.* FROM timely t, marks m WHERE m.delivery = {DELIVERIES + 1} AND window_end <= mark),
facts AS (SELECT key, window_end, count(*) AS total, avg(CAST(value >= 50 AS INTEGER)) AS rate, avg(value / 500) AS confidence FROM closed GROUP BY ALL),
cur AS (SELECT key, window_end, 'value' AS feature, value AS x FROM closed UNION ALL SELECT key, window_end, 'user_id', user_id FROM closed),
counted AS (SELECT c.key, c.window_end, b.feature, b.bin, count(*) AS n FROM cur c JOIN bins b
  ON c.feature = b.feature AND x >= low AND (x < high OR bin = 10 AND x <= high) GROUP BY ALL),
psi AS (SELECT f.key, f.window_end, r.feature, round(abs(sum(((coalesce(k.n, 0) + 1e-6) / total - (r.n + 1e-6) / n_ref)
    * ln(((coalesce(k.n, 0) + 1e-6) / total) / ((r.n + 1e-6) / n_ref)))), 4) AS psi
  FROM facts f CROSS JOIN ref r JOIN ends e ON e.feature = r.feature
  LEFT JOIN counted k ON k.key = f.key AND k.window_end = f.window_end AND k.feature = r.feature AND k.bin = r.bin
  WHERE total >= 10 GROUP BY ALL),
drift AS (SELECT key, window_end, round(avg(CAST(psi >= 0.2 AS INTEGER)), 3) AS ratio FROM psi GROUP BY ALL),
fired AS (
  SELECT key, window_end, 'high_fraud_rate' AS name, rate AS value FROM facts WHERE total >= 10 AND rate > 0.3
  UNION ALL SELECT key, window_end, 'low_confidence', confidence FROM facts WHERE total >= 10 AND confidence < 0.6
  UNION ALL SELECT key, window_end, 'drift_detected', ratio FROM drift WHERE ratio >= 0.1),
walk AS (SELECT key, name, min(window_end) AS at FROM fired GROUP BY ALL
  UNION ALL SELECT w.key, w.name, min(f.window_end) FROM walk w JOIN fired f
    ON f.key = w.key AND f.name = w.name AND f.window_end >= w.at + INTERVAL 7 DAY GROUP BY w.key, w.name)
SELECT f.key, f.name, strftime(f.window_end, '%Y-%m-%d %H:%M:%S') AS window_end, round(f.value, 6) AS value, w.at IS NOT NULL AS sent
FROM fired f LEFT JOIN walk w ON w.key = f.key AND w.name = f.name AND w.at = f.window_end"""


@catalog.add("monitored_stream", MONITORED_SQL)
def monitored_stream(spark, sf_dir):
    """Alerts on windows of five days by event type, with late deliveries, drift and a cooldown of a week; the query starts again for
    each delivery and goes on from its checkpoint."""
    events = table(spark, sf_dir, "events")
    facts = drift_fit(events, MONITORED).facts
    folder, path, check = (fresh_path(spark, x) for x in ("deliveries", "alerts", "check"))
    sent = events.selectExpr(
        "event_type AS key", "CAST(ts AS TIMESTAMP) AS ts", f"{DELIVERY} AS delivery", f"{STREAMED} AS value", "user_id"
    ).selectExpr("*", "int(value >= 50) AS prediction", "value / 500 AS probability")
    for d in range(1, DELIVERIES + 1):
        sent.where(F.col("delivery") == d).write.mode("append").parquet(folder)
        alerts = monitored_alerts(
            read_stream(spark, folder, sent.schema), "key", facts, "5 days", "1 day", cooldown_seconds=7 * 86_400
        )
        write_alerts(alerts, path, check).awaitTermination()
    found = spark.read.parquet(path)
    extra = [F.get_json_object("extra", f"$.{x}") for x in ("fraud_rate", "avg_probability", "drift_ratio")]
    return m.text_times(found, "window_end").select(
        "key", "name", "window_end", F.round(F.coalesce(*extra).cast("double"), 6).alias("value"), "sent"
    )
