import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewell import session
from scorewell.operators.drift import drift_fit
from scorewell.streaming import alerts
from scorewell.streaming.alerts import stream_cooldown
from scorewell.streaming.monitored import keyed_windows, monitored_alerts, write_alerts
from scorewell.streaming.scoring import ScoringStream
from scorewell.streaming.windows import read_stream, read_windows, stream_windows, write_all_windows, write_closed_windows

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, prediction int, probability double"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def put(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_windows_close_once_the_watermark_has_passed(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, source, [(1, at(60), 1, 0.9), (2, at(120), 0, 0.1), (3, at(5 * 3600), 0, 0.2)])
    windows = stream_windows(read_stream(spark, source, spark.read.parquet(source).schema), "1 hour", watermark="1 hour")
    write_closed_windows(windows, sink, check).awaitTermination()
    rows = spark.read.parquet(sink).collect()
    assert [(r.total_count, r.fraud_count, r.fraud_rate) for r in rows] == [(2, 1, 0.5)]
    # A row of the closed window comes too late; the run goes on from its checkpoint.
    put(spark, source, [(4, at(180), 1, 0.9), (5, at(9 * 3600), 1, 0.9)])
    write_closed_windows(windows, sink, check).awaitTermination()
    assert sorted(r.total_count for r in spark.read.parquet(sink).collect()) == [1, 2]


def test_open_windows_show_their_newest_state(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, source, [(1, at(60), 1, 0.9), (2, at(3 * 3600), 0, 0.1)])
    windows = stream_windows(read_stream(spark, source, spark.read.parquet(source).schema), "1 hour", watermark="1 hour")
    write_all_windows(windows, sink, check).awaitTermination()
    # One more row of an open window, and one of a window that the watermark has passed.
    put(spark, source, [(3, at(3 * 3600 + 5), 1, 0.3), (4, at(90), 1, 0.9)])
    write_all_windows(windows, sink, check).awaitTermination()
    rows = read_windows(spark, sink, windows.schema).orderBy("window_start").collect()
    assert [(r.total_count, r.fraud_count) for r in rows] == [(1, 1), (2, 1)]


def test_cooldown_state_outlives_a_restart(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "name string, id long, ts timestamp"

    def run():
        stream = read_stream(spark, source, spark.read.parquet(source).schema)
        query = stream_cooldown(stream).writeStream.format("parquet").option("path", sink)
        query.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return {r.id: r.sent for r in spark.read.parquet(sink).collect()}

    put(spark, source, [("a", 1, at(0)), ("a", 2, at(100)), ("b", 3, at(100))], schema)
    assert run() == {1: True, 2: False, 3: True}
    put(spark, source, [("a", 4, at(299)), ("a", 5, at(300)), ("b", 6, at(399))], schema)
    assert run() == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_cooldown_holds_two_numbers_an_alert(spark, monkeypatch):
    """A name's alerts come out in parts, counted through, as one table of them would."""
    monkeypatch.setattr(alerts, "ROWS_AT_ONCE", 1000)
    times = [(i * 7919) % 20_000 for i in range(5000)]
    got = {}

    class Stream:
        """Stands for the stream, and takes the fold it is given."""

        def select(self, *columns):
            return self

        def groupBy(self, name):
            return self

        def applyInPandasWithState(self, fn, *rest):
            got["fold"] = fn

    class State:
        exists = False

        def update(self, value):
            got["state"] = value

    stream_cooldown(Stream(), 300)
    pieces = [pd.DataFrame({"name": "a", "id": range(i, i + 500), "t": [t * 1_000_000 for t in times[i : i + 500]]}) for i in range(0, 5000, 500)]
    parts = list(got["fold"](("a",), iter(pieces), State()))
    assert max(map(len, parts)) == 1000
    whole = pd.concat(parts)
    sent, last = alerts.sends(np.sort(np.array(times) * 1_000_000), None, 300 * 1_000_000)
    assert whole["sent"].tolist() == sent.tolist() and whole["send_count"].tolist() == np.cumsum(sent).tolist()
    assert [times[i] for i in whole["id"]] == sorted(times) and got["state"] == (last, int(sent.sum()))


@pytest.fixture
def job(tmp_path):
    return ScoringStream(
        scorer=lambda df: df.withColumn("score", F.col("x")).withColumn("prediction", (F.col("x") >= 0.5).cast("int")),
        folder=str(tmp_path / "job"), features=["x"], id_col="id", ts_col="ts", last_n=20,
    )


def test_scoring_stream_logs_alerts_and_cools_down(spark, tmp_path, job):
    source = str(tmp_path / "in")
    schema = "id long, ts timestamp_ntz, x double"

    def run():
        job.start(read_stream(spark, source, spark.read.parquet(source).schema)).awaitTermination()
        return sorted((r.name, r.ts) for r in job.alerts(spark).collect())

    put(spark, source, [(i, at(i), 0.9) for i in range(30)], schema)
    assert run() == [("high_fraud_rate", at(29))]
    put(spark, source, [(i, at(i), 0.9) for i in range(100, 130)], schema)
    assert run() == [("high_fraud_rate", at(29))]
    put(spark, source, [(i, at(i), 0.1) for i in range(400, 410)], schema)
    # The last twenty are half positive: both rules fire, and the first one's cooldown is over.
    assert run() == [("high_fraud_rate", at(29)), ("high_fraud_rate", at(409)), ("low_confidence", at(409))]
    log = job.log(spark)
    assert log.count() == log.select("id").distinct().count() == 70


def test_a_repeated_micro_batch_replaces_itself(spark, job):
    batch = spark.createDataFrame([(i, at(i), 0.9) for i in range(12)], "id long, ts timestamp_ntz, x double")
    for _ in range(2):
        job.handle(batch, 0)
    assert job.log(spark).count() == 12 and job.alerts(spark).count() == 1


def test_stages_go_to_the_shared_folder_and_can_be_discarded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    df = session.materialize(spark.range(5), "five")
    assert session.fresh_path(spark, "x").startswith(str(tmp_path)) and df.count() == 5
    assert session.discard_stages(spark)
    assert not list((tmp_path / "scorewell").iterdir())


class FakeSession:
    """Enough of a session to ask for its shared folder."""

    def __init__(self, master, named):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()
        self.conf = type("Conf", (), {"get": lambda _, key, default: named})()


def test_only_local_sessions_may_go_without_a_shared_folder():
    assert session.shared_dir(FakeSession("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession("yarn", None))
    local = FakeSession("local[2]", None)
    assert session.shared_dir(local) == session.shared_dir(local)


def test_monitored_alerts_late_rows_cooldown_and_forgotten_state(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "key string, ts timestamp, prediction int, probability double, x double"

    def run():
        stream = read_stream(spark, source, spark.read.parquet(source).schema)
        alerts = monitored_alerts(stream, "key", {}, "1 hour", "30 minutes", cooldown_seconds=5400, min_predictions=2)
        write_alerts(alerts, sink, check).awaitTermination()
        return sorted((r.key, r.name, r.window_end.hour, r.sent) for r in spark.read.parquet(sink).collect())

    def hour(h, key="a", p=0.9):
        return [(key, at(3600 * h + 60 * i), 1, p, 1.0) for i in (1, 2)]

    put(spark, source, [*hour(0), *hour(1), *hour(2), *hour(3, "b", 0.5), (None, at(60), 1, 0.9, 1.0)], schema)
    # Hour 3 is open: the watermark stands half an hour before 03:02. One hour after a send is within its cooldown, two are not.
    first = [("a", "high_fraud_rate", 1, True), ("a", "high_fraud_rate", 2, False)]
    assert run() == first
    # Rows of closed windows come too late; those of hour 2 are in time, and make it quiet.
    put(spark, source, [*hour(0, "b"), *[("a", at(7200 + i), 0, 0.9, 1.0) for i in range(9)], *hour(9)], schema)
    second = [*first, ("b", "high_fraud_rate", 4, True), ("b", "low_confidence", 4, True)]
    assert run() == sorted(second)
    put(spark, source, [*hour(12, "c")], schema)
    assert run() == sorted([*second, ("a", "high_fraud_rate", 10, True)])
    # Cooldowns of 01:00 and 04:00 are over and forgotten; that of 10:00 ends at 11:30, when the watermark is at 11:32.
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "last").load(check)
    assert state.count() == 0


def test_windows_with_drift_by_key(spark):
    rows = [("a", at(i), 0, 0.7, float(i % 50)) for i in range(200)] + [("b", at(i), 0, 0.7, float(i % 50) / 4) for i in range(200)]
    log = spark.createDataFrame([*rows, ("b", None, 0, 0.7, 1.0)], "key string, ts timestamp, prediction int, probability double, x double")
    facts = drift_fit(spark.range(1000).selectExpr("double(id % 50) AS x", "1.0D AS flat"), ["x", "flat"]).facts
    found = {r.key: r.d for r in keyed_windows(log.withColumn("flat", F.lit(1.0)), "key", facts, "1 hour").collect()}
    assert (found["a"].drifted_count, found["a"].total_features, found["a"].status) == (0, 2, "NO DRIFT")
    assert (found["b"].drifted_features, found["b"].drift_ratio, found["b"].status) == ("x", 0.5, "HIGH DRIFT")
