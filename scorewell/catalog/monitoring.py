"""Drift, monitoring and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewell.catalog.common import Catalog, rounded, table
from scorewell.operators import drift, monitor
from scorewell.session import fresh_path
from scorewell.sources import logs

catalog = Catalog()

HALF = "TIMESTAMP '1998-01-01 00:00:00'"
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SHIFT_FROM = 1.1


def halves(spark, sf_dir):
    """Line items shipped before 1998 as the reference, later ones as the batch; the batch's
    prices are raised so that one feature drifts."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", *FEATURES)
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return items.where(early), items.where(~early).withColumn("l_extendedprice", F.col("l_extendedprice") * SHIFT_FROM)


SIDES = f"""ref AS (SELECT * FROM (UNPIVOT (SELECT {', '.join(FEATURES)} FROM lineitem WHERE l_shipdate < {HALF})
  ON {', '.join(FEATURES)} INTO NAME feature VALUE value)),
cur AS (SELECT * FROM (UNPIVOT (SELECT l_quantity, l_extendedprice * {SHIFT_FROM}::DOUBLE AS l_extendedprice, l_discount, l_tax
  FROM lineitem WHERE l_shipdate >= {HALF}) ON {', '.join(FEATURES)} INTO NAME feature VALUE value))"""

PSI = f"""{SIDES}, ends AS (SELECT feature, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi,
  count(*) AS n_ref FROM ref GROUP BY feature),
edges AS (SELECT feature, i, CASE WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10) END AS e
  FROM ends, (SELECT unnest(range(0, 11)) AS i)),
slot_ref AS (SELECT feature, least(10, (SELECT count(*) FROM edges x WHERE x.feature = r.feature AND x.e <= r.value)) AS bin, count(*) AS n
  FROM (SELECT r.feature, r.value FROM ref r JOIN ends USING (feature) WHERE value BETWEEN lo AND hi) r GROUP BY 1, 2),
slot_cur AS (SELECT feature, least(10, (SELECT count(*) FROM edges x WHERE x.feature = r.feature AND x.e <= r.value)) AS bin, count(*) AS n
  FROM (SELECT c.feature, c.value FROM cur c JOIN ends USING (feature) WHERE value BETWEEN lo AND hi) r GROUP BY 1, 2),
shares AS (SELECT e.feature, (coalesce(a.n, 0) + 1e-6) / s.n_ref AS r, (coalesce(b.n, 0) + 1e-6) / t.n_cur AS q
  FROM (SELECT feature, unnest(range(1, 11)) AS bin FROM ends) e
  LEFT JOIN slot_ref a ON a.feature = e.feature AND a.bin = e.bin LEFT JOIN slot_cur b ON b.feature = e.feature AND b.bin = e.bin
  JOIN ends s ON s.feature = e.feature JOIN (SELECT feature, count(*) AS n_cur FROM cur GROUP BY 1) t ON t.feature = e.feature),
psi AS (SELECT feature, abs(sum((q - r) * ln(q / r))) AS psi FROM shares GROUP BY feature)"""

KS = """steps AS (SELECT feature, value, sum(a) AS a, sum(b) AS b FROM (
    SELECT feature, value, 1 AS a, 0 AS b FROM ref UNION ALL SELECT feature, value, 0, 1 FROM cur) GROUP BY 1, 2),
gaps AS (SELECT feature, sum(a) OVER w / sum(a) OVER p AS fa, sum(b) OVER w / sum(b) OVER p AS fb, sum(a) OVER p AS n_ref, sum(b) OVER p AS n_cur
  FROM steps WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)),
ksd AS (SELECT feature, CAST(max(n_ref) AS BIGINT) AS n_ref, CAST(max(n_cur) AS BIGINT) AS n_cur, max(abs(fa - fb)) AS d FROM gaps GROUP BY feature),
lam AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS lam FROM (SELECT *, n_ref * n_cur / (n_ref + n_cur) AS n FROM ksd)),
ks AS (SELECT feature, n_ref, n_cur, d, CASE WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0,
  2 * (SELECT sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * lam * lam)) FROM (SELECT unnest(range(1, 101)) AS j)))) END AS pvalue FROM lam)"""

REPORT = f"""{PSI}, {KS}, report AS (SELECT feature, round(psi, 4) AS psi, pvalue, d,
  round(psi, 4) >= 0.2 OR pvalue < 0.05 AS drifted,
  CASE WHEN round(psi, 4) >= 0.2 THEN 'HIGH' WHEN round(psi, 4) >= 0.1 THEN 'MODERATE' ELSE 'OK' END AS status
  FROM psi JOIN ks USING (feature))"""


@catalog.add(
    "drift_fit",
    f"WITH {SIDES} SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_pop, "
    "round(quantile_cont(value, 0.01), 6) AS lo, round(quantile_cont(value, 0.99), 6) AS hi FROM ref GROUP BY feature",
)
def drift_fit(spark, sf_dir):
    return rounded(drift.drift_fit(halves(spark, sf_dir)[0], FEATURES).facts_frame(spark).drop("bins"))


@catalog.add("psi", f"WITH {PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def psi(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    return rounded(drift.psi(drift.drift_fit(ref, FEATURES), cur))


@catalog.add(
    "ks_2samp",
    f"WITH {SIDES}, {KS} SELECT feature, n_ref, n_cur, round(d, 8) AS d, CAST(round(pvalue, 6) AS DOUBLE) AS pvalue FROM ks",
)
def ks_2samp(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    found = drift.ks_two_sample(drift.drift_fit(ref, FEATURES), cur)
    return found.select("feature", "n_ref", "n_cur", F.round("d", 8).alias("d"), F.round("pvalue", 6).alias("pvalue"))


@catalog.add(
    "drift_report",
    f"WITH {REPORT} SELECT feature, psi, CAST(round(pvalue, 4) AS DOUBLE) AS pvalue, round(d, 6) AS d, drifted, status FROM report",
)
def drift_report(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    return rounded(drift.drift_report(drift.drift_fit(ref, FEATURES), cur))


SUMMARY_SQL = f"""{REPORT}, dsum AS (SELECT
  CASE WHEN ratio >= 0.3 THEN 'HIGH DRIFT' WHEN ratio >= 0.1 THEN 'MODERATE DRIFT' ELSE 'NO DRIFT' END AS status,
  round(ratio, 3) AS drift_ratio, drifted_count, total_features, drifted_features FROM (
  SELECT CAST(count(*) FILTER (drifted) AS BIGINT) AS drifted_count, count(*) AS total_features,
    count(*) FILTER (drifted) / count(*) AS ratio,
    coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (drifted), '') AS drifted_features FROM report))"""


@catalog.add("drift_summary", f"WITH {SUMMARY_SQL} SELECT * FROM dsum")
def drift_summary(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    return drift.drift_summary(drift.drift_report(drift.drift_fit(ref, FEATURES), cur))


@catalog.add("drift_report_exact")
def drift_report_exact(spark, sf_dir):
    """The report with exact p-values where the samples are small."""
    ref, cur = halves(spark, sf_dir)
    return drift.drift_report(drift.drift_fit(ref, FEATURES), cur, exact_below=10_000)


@catalog.add(
    "top_drifted",
    f"WITH {REPORT} SELECT feature, psi, status FROM report ORDER BY psi DESC, feature LIMIT 2",
)
def top_drifted(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    report = drift.drift_report(drift.drift_fit(ref, FEATURES), cur)
    return drift.top_drifted(report, 2).select("feature", "psi", "status")


@catalog.add(
    "save_load_reference",
    f"WITH {PSI} SELECT feature, round(psi, 6) AS psi FROM psi",
)
def save_load_reference(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    path = fresh_path(spark, "reference")
    drift.save_reference(drift.drift_fit(ref, FEATURES), path)
    return rounded(drift.psi(drift.load_reference(spark, path), cur))


def prediction_log(spark, sf_dir):
    """Events as a prediction log: the share of 500 as probability, positive from 0.3 on."""
    e = table(spark, sf_dir, "events")
    p = F.col("value") / 500
    return e.select(
        F.col("event_id").alias("id"), "ts", F.col("props").alias("input_json"),
        (p >= 0.3).cast("int").alias("prediction"), p.alias("probability"),
    )


LOG = """log AS (SELECT event_id AS id, ts, props AS input_json, CAST(value / 500 >= 0.3 AS INTEGER) AS prediction,
  value / 500 AS probability FROM events)"""
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def text_times(df, *names):
    """Timestamps as text, so that the two engines' types compare."""
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


SUMMARY_COLS = """count(*) AS total_count, CAST(coalesce(sum(prediction), 0) AS BIGINT) AS fraud_count, round(coalesce(avg(prediction), 0), 6) AS fraud_rate,
  round(coalesce(avg(probability), 0), 6) AS avg_probability, round(coalesce(min(probability), 0), 6) AS min_probability,
  round(coalesce(max(probability), 0), 6) AS max_probability"""


@catalog.add(
    "rolling_summary",
    f"WITH {LOG} SELECT {SUMMARY_COLS}, {STAMP.format('min(ts)')} AS window_start, {STAMP.format('max(ts)')} AS window_end "
    "FROM (SELECT * FROM log ORDER BY id DESC LIMIT 100)",
)
def rolling_summary(spark, sf_dir):
    return rounded(text_times(monitor.rolling_summary(prediction_log(spark, sf_dir)), "window_start", "window_end"))


@catalog.add(
    "log_totals",
    f"WITH {LOG} SELECT count(*) AS total_predictions, {STAMP.format('arg_max(ts, id)')} AS last_prediction_ts FROM log",
)
def log_totals(spark, sf_dir):
    return text_times(monitor.log_totals(prediction_log(spark, sf_dir)), "last_prediction_ts")


RULES = f"""k AS (SELECT count(*) AS total_count, avg(prediction) AS fraud_rate, avg(probability) AS avg_probability
  FROM (SELECT * FROM log ORDER BY id DESC LIMIT 100)),
fired AS (
  SELECT 'high_fraud_rate' AS name, 'CRITICAL' AS severity, round(fraud_rate, 6) AS value FROM k WHERE total_count >= 10 AND fraud_rate > 0.3
  UNION ALL SELECT 'low_confidence', 'WARNING', round(avg_probability, 6) FROM k WHERE total_count >= 10 AND avg_probability < 0.6
  UNION ALL SELECT 'drift_detected', 'WARNING', drift_ratio FROM k, dsum WHERE total_count >= 10 AND drift_ratio >= 0.1)"""


def fired_alerts(spark, sf_dir):
    ref, cur = halves(spark, sf_dir)
    report = drift.drift_report(drift.drift_fit(ref, FEATURES), cur)
    return monitor.alert_rules(monitor.rolling_summary(prediction_log(spark, sf_dir)), drift.drift_summary(report))


@catalog.add("alert_rules", f"WITH {SUMMARY_SQL}, {LOG}, {RULES} SELECT * FROM fired")
def alert_rules(spark, sf_dir):
    fired = fired_alerts(spark, sf_dir)
    value = F.coalesce(F.col("extra")["fraud_rate"], F.col("extra")["avg_probability"], F.col("extra")["drift_ratio"])
    return fired.select("name", "severity", F.round(value.cast("double"), 6).alias("value"))


def event_alerts(spark, sf_dir):
    """One alert per event with a large value, named by its type: severity by size."""
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("value") > 300, "CRITICAL").when(F.col("value") > 100, "WARNING").otherwise("INFO")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("name"), severity.alias("severity"),
        F.concat(F.lit("value of user "), F.col("user_id").cast("string")).alias("message"),
        F.create_map(F.lit("props"), F.col("props")).alias("extra"),
    )


ALERTS = """alerts AS (SELECT event_id AS id, ts, event_type AS name,
  CASE WHEN value > 300 THEN 'CRITICAL' WHEN value > 100 THEN 'WARNING' ELSE 'INFO' END AS severity,
  'value of user ' || user_id AS message, props FROM events)"""


@catalog.add(
    "alert_history",
    f"WITH {ALERTS} SELECT id, {STAMP.format('ts')} AS ts, name, severity, message, props FROM alerts ORDER BY id DESC LIMIT 50",
)
def alert_history(spark, sf_dir):
    newest = monitor.alert_history(event_alerts(spark, sf_dir))
    return text_times(newest.select("id", "ts", "name", "severity", "message", F.col("extra")["props"].alias("props")), "ts")


@catalog.add(
    "alert_route",
    f"WITH {ALERTS} SELECT id, name, severity, severity <> 'INFO' AS routed, "
    "CASE WHEN severity = 'INFO' THEN 'severity INFO below minimum WARNING' END AS skipped_reason FROM alerts",
)
def alert_route(spark, sf_dir):
    routed = monitor.route_alerts(event_alerts(spark, sf_dir), "WARNING")
    return routed.select("id", "name", "severity", "routed", "skipped_reason")


@catalog.add(
    "alert_cooldown",
    f"""WITH RECURSIVE {ALERTS}, hop AS (SELECT name, id, first_value(id) OVER (PARTITION BY name ORDER BY ts
    RANGE BETWEEN INTERVAL 3000 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM alerts),
sent AS (SELECT arg_min(id, ts) AS id FROM alerts GROUP BY name
  UNION ALL SELECT h.nxt FROM sent s JOIN hop h ON h.id = s.id WHERE h.nxt IS NOT NULL)
SELECT a.id, a.name, s.id IS NOT NULL AS sent FROM alerts a LEFT JOIN sent s ON s.id = a.id""",
)
def alert_cooldown(spark, sf_dir):
    marked = monitor.cooldown_filter(event_alerts(spark, sf_dir), seconds=3000)
    return marked.select("id", "name", "sent")


def windows_sql(offsets: str, width: str) -> str:
    return f"""WITH {LOG}, w AS (SELECT *, time_bucket(INTERVAL '15 minutes', ts) AS slot FROM log),
x AS (SELECT *, slot - o * INTERVAL '15 minutes' AS s FROM w, (SELECT unnest({offsets}) AS o))
SELECT {STAMP.format('s')} AS window_start, {STAMP.format("s + INTERVAL '1 hour'")} AS window_end, {SUMMARY_COLS} FROM x GROUP BY s"""


@catalog.add(
    "windowed_fraud_rate",
    f"WITH {LOG} SELECT {STAMP.format('s')} AS window_start, {STAMP.format(chr(115) + ' + INTERVAL 1 HOUR')} AS window_end, "
    f"{SUMMARY_COLS} FROM (SELECT *, date_trunc('hour', ts) AS s FROM log) GROUP BY s",
)
def windowed_fraud_rate(spark, sf_dir):
    per = monitor.windowed_summary(prediction_log(spark, sf_dir), "1 hour")
    return rounded(text_times(per, "window_start", "window_end"))


@catalog.add("windowed_fraud_rate_sliding", windows_sql("range(0, 4)", "1 hour"))
def windowed_fraud_rate_sliding(spark, sf_dir):
    per = monitor.windowed_summary(prediction_log(spark, sf_dir), "1 hour", "15 minutes")
    return rounded(text_times(per, "window_start", "window_end"))


@catalog.add(
    "append_log",
    f"WITH {LOG} SELECT count(*) AS n, count(DISTINCT id) AS ids, CAST(sum(prediction) AS BIGINT) AS positives, "
    "round(avg(probability), 6) AS avg_probability, count(input_json) AS with_json FROM (SELECT * FROM log)",
)
def append_log(spark, sf_dir):
    """Two appended batches; ids stay unique across them."""
    log = prediction_log(spark, sf_dir).withColumnRenamed("probability", "score")
    path = fresh_path(spark, "predictions")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (log.where(early), log.where(~early)):
        logs.append_prediction_log(part, path, ["id", "input_json"], ts="ts")
    stored = logs.read_log(spark, path, logs.PREDICTION_SCHEMA)
    return rounded(
        stored.agg(
            F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("prediction").alias("positives"),
            F.avg("probability").alias("avg_probability"),
            F.count(F.get_json_object("input_json", "$.id")).alias("with_json"),
        )
    )


@catalog.add("clear_log", "SELECT count(*) AS deleted, CAST(0 AS BIGINT) AS left_over FROM events")
def clear_log(spark, sf_dir):
    path = fresh_path(spark, "predictions")
    log = prediction_log(spark, sf_dir).withColumnRenamed("probability", "score")
    logs.append_prediction_log(log, path, ["id"], ts="ts", id_col="id")
    n = logs.clear_log(spark, path, logs.PREDICTION_SCHEMA)
    left = logs.read_log(spark, path, logs.PREDICTION_SCHEMA).agg(F.count("*").alias("left_over"))
    return left.select(F.lit(n).cast("long").alias("deleted"), "left_over")


@catalog.add(
    "write_alert_log",
    f"WITH {ALERTS} SELECT name, severity, count(*) AS n, count(props) AS with_props FROM alerts GROUP BY 1, 2",
)
def write_alert_log(spark, sf_dir):
    path = fresh_path(spark, "alerts")
    logs.write_alert_lines(event_alerts(spark, sf_dir), path)
    lines = spark.read.schema("ts timestamp, name string, severity string, message string, extra map<string,string>").json(path)
    return lines.groupBy("name", "severity").agg(F.count("*").alias("n"), F.count(F.col("extra")["props"]).alias("with_props"))
