import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.operators import drift, monitor
from scorewell.sources import logs


def normal(spark, shift=0.0, n=600, seed=1):
    rng = np.random.RandomState(seed)
    rows = [(float(a), float(b), 1.0) for a, b in zip(rng.randn(n) + shift, rng.rand(n))]
    return spark.createDataFrame(rows, "normal double, even double, const double")


def brute_psi(ref, cur):
    edges = np.linspace(np.percentile(ref, 1), np.percentile(ref, 99), 11)
    r, c = np.histogram(ref, edges)[0], np.histogram(cur, edges)[0]
    r, c = (r + 1e-6) / len(ref), (c + 1e-6) / len(cur)
    return abs(np.sum((c - r) * np.log(c / r)))


def brute_ks(ref, cur):
    grid = np.concatenate([ref, cur])
    f = np.searchsorted(np.sort(ref), grid, side="right") / len(ref)
    g = np.searchsorted(np.sort(cur), grid, side="right") / len(cur)
    return np.max(np.abs(f - g))


def column(df, name):
    return np.array([r[0] for r in df.select(name).collect()])


def test_psi_and_ks_match_brute_force(spark):
    ref, cur = normal(spark), normal(spark, 0.4, 500, 2)
    fitted = drift.drift_fit(ref, ["normal", "even", "const"])
    psi = {r.feature: r.psi for r in drift.psi(fitted, cur).collect()}
    ks = {r.feature: r for r in drift.ks_two_sample(fitted, cur).collect()}
    for name in ("normal", "even"):
        a, b = column(ref, name), column(cur, name)
        assert psi[name] == pytest.approx(brute_psi(a, b))
        assert ks[name].d == pytest.approx(brute_ks(a, b)) and (ks[name].n_ref, ks[name].n_cur) == (600, 500)
    assert psi["const"] == 0.0 and ks["const"].pvalue == 1.0


def test_same_data_is_quiet_and_shifted_data_is_not(spark):
    ref = normal(spark)
    fitted = drift.drift_fit(ref, ["normal", "even", "const"])
    quiet = drift.drift_summary(drift.drift_report(fitted, ref)).first()
    assert quiet.drift_ratio < 0.3 and quiet.status == "NO DRIFT"
    moved = ref.select((F.col("normal") + 5).alias("normal"), (F.col("even") * 9).alias("even"), "const")
    loud = drift.drift_summary(drift.drift_report(fitted, moved)).first()
    assert loud.drift_ratio > 0.5 and loud.drifted_features == "even,normal"


def test_small_or_absent_features_are_left_out(spark):
    fitted = drift.drift_fit(normal(spark), ["normal", "even"])
    few = spark.createDataFrame([(0.1, float(i)) for i in range(9)], "even double, other double")
    report = drift.drift_report(fitted, few)
    assert report.count() == 0
    assert drift.drift_summary(report).first().total_features == 0


def test_sampled_reference_round_trip(spark, tmp_path):
    ref = normal(spark).withColumn("id", F.monotonically_increasing_id())
    fitted = drift.drift_fit(ref, ["normal"], sample=500, keys=["id"], psi_threshold=0.3)
    assert fitted.facts["normal"]["n"] == 500 and fitted.values.agg(F.sum("n")).first()[0] == 500
    drift.save_reference(fitted, str(tmp_path / "ref"))
    back = drift.load_reference(spark, str(tmp_path / "ref"))
    assert back.facts == fitted.facts and (back.psi_threshold, back.ks_alpha) == (0.3, 0.05)


@pytest.mark.parametrize("d, n, p", [(0.05, 1000, 0.164), (0.08, 1000, 0.0033), (0.01, 500, 1.0)])
def test_ks_pvalue_near_the_exact_law(spark, d, n, p):
    """The series is asymptotic: within half a percent of the exact two-sample law at these sizes."""
    row = spark.range(1).select(drift.ks_pvalue(F.lit(d), F.lit(n), F.lit(n)).alias("p")).first()
    assert row.p == pytest.approx(p, abs=5e-3)


@pytest.mark.parametrize("m, n", [(3, 4), (5, 5), (2, 7)])
def test_exact_ks_pvalue_by_listing_every_order(m, n):
    gaps = []
    for places in itertools.combinations(range(m + n), m):
        a = b = 0
        worst = 0.0
        for i in range(m + n):
            a, b = (a + 1, b) if i in places else (a, b + 1)
            worst = max(worst, abs(a / m - b / n))
        gaps.append(worst)
    for d in sorted(set(round(g, 9) for g in gaps)):
        expected = sum(g >= d - 1e-7 for g in gaps) / len(gaps)
        assert drift.exact_ks_pvalue(d, m, n) == pytest.approx(expected)


def test_exact_law_and_series_agree_on_large_samples(spark):
    row = spark.range(1).select(drift.ks_pvalue(F.lit(0.02), F.lit(9_000), F.lit(10_000)).alias("p")).first()
    assert drift.exact_ks_pvalue(0.02, 9_000, 10_000) == pytest.approx(row.p, abs=2e-3)


def test_exact_law_on_request(spark):
    ref, cur = normal(spark, n=60), normal(spark, 0.5, 50, 2)
    fitted = drift.drift_fit(ref, ["normal"])
    row = drift.ks_two_sample(fitted, cur, exact_below=60).first()
    assert row.pvalue == pytest.approx(drift.exact_ks_pvalue(row.d, 60, 50))
    # One rule at every size unless asked: neither a limit that is too low nor the default gives the exact law.
    series = drift.ks_two_sample(fitted, cur).first().pvalue
    assert drift.ks_two_sample(fitted, cur, exact_below=55).first().pvalue == pytest.approx(series, abs=1e-9)
    assert series != pytest.approx(row.pvalue, abs=1e-6)


def prediction_frame(spark, rows):
    stamped = [(i, dt.datetime(2024, 1, 1, 0, 0, i % 60), None, p, s) for i, p, s in rows]
    return spark.createDataFrame(stamped, logs.PREDICTION_SCHEMA)


def test_empty_log_gives_zeros(spark):
    row = monitor.rolling_summary(prediction_frame(spark, [])).first()
    assert (row.total_count, row.fraud_count, row.fraud_rate, row.max_probability, row.window_start) == (0, 0, 0.0, 0.0, None)


def test_summary_takes_the_newest_only(spark):
    df = prediction_frame(spark, [(i, int(i >= 15), 0.5) for i in range(20)])
    row = monitor.rolling_summary(df, 10).first()
    assert (row.total_count, row.fraud_count, row.fraud_rate) == (10, 5, 0.5)


def fired(spark, rows, **limits):
    return {r.name: r for r in monitor.alert_rules(monitor.rolling_summary(prediction_frame(spark, rows)), **limits).collect()}


def test_rules_need_enough_predictions(spark):
    assert fired(spark, [(i, 1, 0.97) for i in range(9)]) == {}
    assert set(fired(spark, [(i, 1, 0.97) for i in range(10)])) == {"high_fraud_rate"}


def test_fraud_rate_limit_is_strict_and_low_confidence_fires(spark):
    rows = [(i, int(i < 3), 0.1) for i in range(10)]
    got = fired(spark, rows)
    assert set(got) == {"low_confidence"} and got["low_confidence"].severity == "WARNING"
    assert "high_fraud_rate" in fired(spark, rows, fraud_rate_limit=0.29)
    assert got["low_confidence"].extra["threshold"] == "0.6"


def test_drift_rule_includes_its_limit(spark):
    summary = monitor.rolling_summary(prediction_frame(spark, [(i, 0, 0.9) for i in range(10)]))
    report = spark.createDataFrame([("MODERATE DRIFT", 0.1, 1, 10, "a")], "status string, drift_ratio double, drifted_count long, total_features long, drifted_features string")
    rows = monitor.alert_rules(summary, report).collect()
    assert [r.name for r in rows] == ["drift_detected"] and rows[0].extra["drifted_features"] == "a"


def test_routing(spark):
    df = spark.createDataFrame([("INFO",), ("WARNING",), ("CRITICAL",), ("ODD",)], "severity string")
    got = {r.severity: (r.routed, r.skipped_reason) for r in monitor.route_alerts(df, "WARNING").collect()}
    assert got["CRITICAL"] == (True, None) and got["ODD"][0] is False
    assert got["INFO"] == (False, "severity INFO below minimum WARNING")


def brute_cooldown(alerts, seconds):
    last, out = {}, {}
    for i, ts, name in sorted(alerts, key=lambda a: (a[1], a[0])):
        out[i] = name not in last or (ts - last[name]).total_seconds() >= seconds
        if out[i]:
            last[name] = ts
    return out


@pytest.mark.parametrize("slot,fan", [(40, 2), (300, 2), (300, 256), (3_600, 3), (10**6, 256)])
def test_cooldown_matches_brute_force_whatever_the_slots(spark, slot, fan, monkeypatch):
    monkeypatch.setattr(monitor, "FAN", fan)
    rng = np.random.RandomState(slot)
    start = dt.datetime(2024, 1, 1)
    gaps = np.cumsum(rng.choice([0.0, 0.5, 30.0, 299.999999, 300.0, 900.0], 400, p=[0.1, 0.4, 0.3, 0.05, 0.05, 0.1]))
    names = rng.choice(["busy", "rare"], 400, p=[0.9, 0.1])
    alerts = [(i, start + dt.timedelta(seconds=float(g)), n) for i, (g, n) in enumerate(zip(gaps, names))]
    df = spark.createDataFrame([(i, t, str(n)) for i, t, n in alerts], "id long, ts timestamp_ntz, name string")
    got = {r.id: r.sent for r in monitor.cooldown_filter(df, 300, slot).collect()}
    assert got == brute_cooldown(alerts, 300)


def test_step_functions_compose_in_any_grouping():
    rng = np.random.default_rng(2)
    for _ in range(50):
        parts, at = [], 0
        for _ in range(3):
            times = at + np.sort(rng.choice(1000, rng.integers(0, 30), replace=False))
            parts.append((times, monitor._free_after(times, 90)))
            at += 1000
        a, b, c = parts
        entries = np.arange(-100, 3200, 7)
        left, right = monitor._composed(monitor._composed(a, b), c), monitor._composed(a, monitor._composed(b, c))
        one_by_one = entries
        for p in parts:
            one_by_one = monitor._apply(*p, one_by_one)
        assert monitor._apply(*left, entries).tolist() == monitor._apply(*right, entries).tolist() == one_by_one.tolist()


def test_a_name_with_all_alerts_spreads_over_tasks(spark, monkeypatch):
    """No group holds more than a slot's instants, or FAN step functions of few steps."""
    monkeypatch.setattr(monitor, "FAN", 8)
    df = spark.range(20_000).selectExpr("id", "timestampadd(SECOND, cast(id * 7 AS int), timestamp_ntz'2024-01-01 00:00:00') AS ts", "'hot' AS name")
    assert sorted(r.id for r in monitor.cooldown_filter(df, 300).where("sent").collect()) == list(range(0, 20_000, 43))
    times = spark.range(20_000).selectExpr("'hot' AS name", "id * 7000000 div 3600000000 AS slot", "id * 7000000 AS t")
    levels = monitor._levels(times, 300_000_000, 3_600_000_000, 0, 39)
    assert [x.count() for x in levels] == [39, 5, 1]
    assert all(x.selectExpr("max(size(upto)) AS n").first()["n"] <= 45 for x in levels)


def test_send_counts(spark):
    df = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1, 0, m), "a") for i, m in enumerate([0, 2, 5, 6])], "id long, ts timestamp_ntz, name string"
    )
    row = monitor.send_counts(monitor.cooldown_filter(df)).first()
    assert (row.name, row.send_count, row.last_sent) == ("a", 2, dt.datetime(2024, 1, 1, 0, 5))


def test_log_append_clear(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logs.read_log(spark, path, logs.PREDICTION_SCHEMA).count() == 0
    scored = spark.createDataFrame([(1.5, 0.9, 1), (None, 0.1, 0)], "a double, score double, prediction int")
    logs.append_prediction_log(scored, path, ["a"])
    logs.append_prediction_log(scored, path, ["a"])
    rows = logs.read_log(spark, path, logs.PREDICTION_SCHEMA).collect()
    assert len({r.id for r in rows}) == 4 and {r.input_json for r in rows} == {'{"a":1.5}', '{"a":null}'}
    assert logs.clear_log(spark, path, logs.PREDICTION_SCHEMA) == 4
    assert logs.read_log(spark, path, logs.PREDICTION_SCHEMA).count() == 0


def test_alert_log_and_history(spark, tmp_path):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), "a", "INFO", "m", {"k": "v"})], "ts timestamp_ntz, name string, severity string, message string, extra map<string,string>"
    )
    path = str(tmp_path / "alerts")
    for _ in range(3):
        logs.append_alert_log(df, path)
    newest = monitor.alert_history(logs.read_log(spark, path, logs.ALERT_SCHEMA), 2).collect()
    assert len(newest) == 2 and newest[0].id > newest[1].id and newest[0].extra == {"k": "v"}
