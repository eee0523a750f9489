"""Statistics over the prediction log, alert rules, routing and cooldown."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.operators.features import epoch_seconds
from scorewell.session import materialize

# Alert limits, severity order and cooldown.
LAST_PREDICTIONS, LAST_ALERTS = 100, 50
MIN_PREDICTIONS = 10
FRAUD_RATE_LIMIT = 0.30
LOW_CONFIDENCE_LIMIT = 0.60
DRIFT_RATIO_LIMIT = 0.10
SEVERITY = {"INFO": 0, "WARNING": 1, "CRITICAL": 2}
COOLDOWN_SECONDS = 300


def summary_aggregates() -> list[Column]:
    zero = F.lit(0.0)
    return [
        F.count("*").alias("total_count"),
        F.coalesce(F.sum(F.col("prediction").cast("long")), F.lit(0)).alias("fraud_count"),
        F.coalesce(F.avg("prediction"), zero).alias("fraud_rate"),
        F.coalesce(F.avg("probability"), zero).alias("avg_probability"),
        F.coalesce(F.min("probability"), zero).alias("min_probability"),
        F.coalesce(F.max("probability"), zero).alias("max_probability"),
        F.min("ts").alias("window_start"),
        F.max("ts").alias("window_end"),
    ]


def rolling_summary(log: DataFrame, last_n: int = LAST_PREDICTIONS) -> DataFrame:
    """Statistics over the newest ``last_n`` predictions by id: a top-k, then one row."""
    newest = log.select("id", "ts", "prediction", "probability").orderBy(F.col("id").desc()).limit(last_n)
    return newest.agg(*summary_aggregates())


def log_totals(log: DataFrame) -> DataFrame:
    """Number of predictions and the time of the newest."""
    return log.agg(F.count("*").alias("total_predictions"), F.max_by("ts", "id").alias("last_prediction_ts"))


def windowed_summary(log: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """The rolling statistics per event-time window, tumbling or sliding; for tables and streams."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    kept = [m for m in summary_aggregates()][:6]
    return log.groupBy(window.alias("w")).agg(*kept).select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "total_count", "fraud_count", "fraud_rate", "avg_probability", "min_probability", "max_probability",
    )


DRIFT_FIELDS = ["drift_ratio", "drifted_count", "total_features", "drifted_features", "status"]


def alert_rules(
    summary: DataFrame,
    drift: DataFrame | None = None,
    fraud_rate_limit: float = FRAUD_RATE_LIMIT,
    low_confidence_limit: float = LOW_CONFIDENCE_LIMIT,
    drift_ratio_limit: float = DRIFT_RATIO_LIMIT,
    min_predictions: int = MIN_PREDICTIONS,
    last_n: int = LAST_PREDICTIONS,
) -> DataFrame:
    """Fired rules as (name, severity, message, extra) rows, from the one-row summaries."""
    facts = summary
    if drift is not None:
        facts = summary.withColumn("d", drift.select(F.struct(*DRIFT_FIELDS).alias("d")).scalar())
    return fired_rules(facts, last_n, (), fraud_rate_limit, low_confidence_limit, drift_ratio_limit, min_predictions)


def fired_rules(
    facts: DataFrame,
    window: object,
    keys: Sequence[str] = (),
    fraud_rate_limit: float = FRAUD_RATE_LIMIT,
    low_confidence_limit: float = LOW_CONFIDENCE_LIMIT,
    drift_ratio_limit: float = DRIFT_RATIO_LIMIT,
    min_predictions: int = MIN_PREDICTIONS,
) -> DataFrame:
    """(keys, name, severity, message, extra): the rules that fire on each row of statistics.

    The drift rule is there where the rows have a struct ``d`` with the fields of a drift summary. Mean confidence is the mean probability
    of the positive class, so quiet traffic also counts as low confidence. ``window`` is what the statistics cover, for the report.
    """

    def fact(value: Column | float) -> Column:
        return (F.lit(value) if not isinstance(value, Column) else value).cast("string")

    def rule(fires: Column, name: str, severity: str, message: Column, extra: dict) -> Column:
        pairs = [x for k, v in extra.items() for x in (F.lit(k), fact(v))]
        row = F.struct(
            F.lit(name).alias("name"), F.lit(severity).alias("severity"), message.alias("message"),
            F.create_map(*pairs).alias("extra"),
        )
        return F.when(fires, row)

    rate, confidence = F.col("fraud_rate"), F.col("avg_probability")
    rules = [
        rule(
            rate > fraud_rate_limit,
            "high_fraud_rate",
            "CRITICAL",
            F.format_string(f"Fraud rate %.1f%% is above {100 * fraud_rate_limit:.1f}%% (%d of %d).", rate * 100, F.col("fraud_count"), F.col("total_count")),
            {"fraud_rate": rate, "fraud_count": F.col("fraud_count"), "total_count": F.col("total_count"),
             "threshold": fraud_rate_limit, "window": window},
        ),
        rule(
            confidence < low_confidence_limit,
            "low_confidence",
            "WARNING",
            F.format_string(f"Mean probability %.3f is below {low_confidence_limit}.", confidence),
            {"avg_probability": confidence, "threshold": low_confidence_limit},
        ),
    ]
    if "d" in facts.columns:
        rules.append(
            rule(
                F.col("d.drift_ratio") >= drift_ratio_limit,
                "drift_detected",
                "WARNING",
                F.format_string("%d of %d features drifted.", F.col("d.drifted_count"), F.col("d.total_features")),
                {**{k: F.col(f"d.{k}") for k in DRIFT_FIELDS}, "threshold": drift_ratio_limit},
            )
        )
    fires = F.explode(F.array_compact(F.array(*rules))).alias("r")
    fired = facts.where(F.col("total_count") >= min_predictions).select(*keys, fires)
    return fired.select(*keys, "r.name", "r.severity", "r.message", "r.extra")


def alert_history(alerts: DataFrame, last_n: int = LAST_ALERTS) -> DataFrame:
    return alerts.orderBy(F.col("id").desc()).limit(last_n)


def severity_level(severity: Column) -> Column:
    """Numeric level; an unknown severity counts as the lowest."""
    out = F.lit(0)
    for name, level in SEVERITY.items():
        out = F.when(severity == name, level).otherwise(out)
    return out


def route_alerts(alerts: DataFrame, min_severity: str = "INFO") -> DataFrame:
    """Add ``routed`` and, where not routed, the reason."""
    passes = severity_level(F.col("severity")) >= SEVERITY.get(min_severity, 0)
    reason = F.when(~passes, F.concat(F.lit("severity "), F.col("severity"), F.lit(f" below minimum {min_severity}")))
    return alerts.withColumns({"routed": passes, "skipped_reason": reason})


STEPS = "name string, slot long, upto array<long>, free_at array<long>"
ENTRIES = "name string, slot long, free_from long"
NEVER = -(1 << 62)
#: Step functions that one task composes at a time.
FAN = 256


def _free_after(times: np.ndarray, cooldown: int) -> np.ndarray:
    """For a chain of sends that starts at each time: when the name is free again after the last."""
    following = np.searchsorted(times, times + cooldown, side="left")
    last = np.where(following < len(times), following, np.arange(len(times)))
    # Every jump doubles the sends passed over.
    while True:
        further = last[last]
        if (further == last).all():
            return times[last] + cooldown
        last = further


def _apply(upto: np.ndarray, free_at: np.ndarray, free: np.ndarray) -> np.ndarray:
    """A step function at each time: entering free from at most ``upto[i]`` it leaves ``free_at[i]``; beyond the last, nothing is sent."""
    i = np.searchsorted(upto, free, side="left")
    return np.where(i < len(upto), np.append(free_at, 0)[i], free)


def _trimmed(upto: np.ndarray, free_at: np.ndarray, latest: int) -> tuple[np.ndarray, np.ndarray]:
    """The same function for entries up to ``latest``, equal neighbours as one step."""
    reach = int(np.searchsorted(upto, latest, side="left")) + 1
    upto, free_at = upto[:reach], free_at[:reach]
    last = np.append(free_at[1:] != free_at[:-1], True)[: len(upto)]
    return upto[last], free_at[last]


def _composed(first: tuple, then: tuple) -> tuple[np.ndarray, np.ndarray]:
    """One step function after the other. Composition is associative, so any grouping of neighbours gives the same."""
    beyond = then[0] > first[0][-1] if len(first[0]) else np.ones(len(then[0]), bool)
    return np.append(first[0], then[0][beyond]), np.append(_apply(*then, first[1]), then[1][beyond])


def _slot_steps(cooldown: int, width: int, origin: int):
    """A slot's effect as a step function."""

    def steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["t"].to_numpy())
        # No name enters later than a cooldown after the slot's start.
        upto, free_at = _trimmed(times, _free_after(times, cooldown), (origin + key[1]) * width + cooldown)
        return pd.DataFrame({"name": [key[0]], "slot": [key[1]], "upto": [upto], "free_at": [free_at]})

    return steps


def _in_order(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf.sort_values("slot")
    return [(s, np.asarray(u), np.asarray(f)) for s, u, f in zip(pdf["slot"], pdf["upto"], pdf["free_at"])]


def _group_steps(cooldown: int, width: int, origin: int, span: int):
    """The effect of up to FAN neighbouring slots (of ``span`` first slots each, together) as one step function."""

    def steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        latest = (origin + key[1] * span) * width + cooldown
        for _, upto, free_at in _in_order(pdf):
            whole = _trimmed(*_composed(whole, (upto, free_at)), latest)
        return pd.DataFrame({"name": [key[0]], "slot": [key[1]], "upto": [whole[0]], "free_at": [whole[1]]})

    return steps


def _enter_slots(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Hand a group's entry time down to its slots, in order."""
    rows, free = [], np.array([right["free_from"].iloc[0]])
    for slot, upto, free_at in _in_order(left):
        rows.append((key[0], slot, int(free[0])))
        free = _apply(upto, free_at, free)
    return pd.DataFrame(rows, columns=["name", "slot", "free_from"])


def _levels(times: DataFrame, cooldown: int, width: int, origin: int, slots: int) -> list[DataFrame]:
    """Step functions of single slots, of FAN slots, of FAN * FAN slots and so on, until one holds all ``slots``."""
    levels = [materialize(times.groupBy("name", "slot").applyInPandas(_slot_steps(cooldown, width, origin), STEPS), "steps")]
    span = 1
    while span < slots:
        span *= FAN
        grouped = levels[-1].groupBy("name", F.floor(F.col("slot") / FAN).alias("group"))
        levels.append(materialize(grouped.applyInPandas(_group_steps(cooldown, width, origin, span), STEPS), "steps"))
    return levels


def _entries(levels: list[DataFrame]) -> DataFrame:
    """(name, slot, free_from): what is known from before on entry to each slot of the first level."""
    entries = levels[-1].select("name", "slot", F.lit(NEVER).alias("free_from"))  # one group per name
    for level in reversed(levels[:-1]):
        child = level.withColumn("parent", F.floor(F.col("slot") / FAN))
        above = entries.select(F.col("name").alias("n"), F.col("slot").alias("p"), "free_from")
        entries = child.groupBy("name", "parent").cogroup(above.groupBy("n", "p")).applyInPandas(_enter_slots, ENTRIES)
    return entries


def _mark_sends(cooldown: int):
    def mark(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["t"].to_numpy())
        sent = []
        i = int(np.searchsorted(times, pdf["free_from"].iloc[0], side="left"))
        while i < len(times):
            sent.append(times[i])
            i = int(np.searchsorted(times, times[i] + cooldown, side="left"))
        return pd.DataFrame({"name": key[0], "t": np.array(sent, dtype="int64")})

    return mark


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp's wall clock."""
    whole = epoch_seconds(ts) - F.second(ts)
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def cooldown_filter(
    alerts: DataFrame, seconds: int = COOLDOWN_SECONDS, slot_seconds: int | None = None, keys: tuple = ("id",)
) -> DataFrame:
    """Add ``sent``: an alert goes out unless one of its name did within the cooldown before it.

    Which alerts go out depends on the one sent before, so time is cut into slots per name. Each
    slot is reduced, on its own, to a step function from "free from" on entry to "free from" on
    exit. Neighbouring functions are composed, FAN at a time, until one is left per name; entry times are handed
    down the same way; then each slot marks its sends. A name with most
    of the alerts is thereby spread over its slots. Alerts at one instant are folded beforehand.
    """
    cooldown = seconds * 1_000_000
    width = (slot_seconds or 12 * seconds) * 1_000_000
    timed = alerts.withColumn("__t", micros(F.col("ts")))
    instants = (
        timed.groupBy("name", F.col("__t").alias("t"))
        .agg(F.min(F.struct(*keys)).alias("first"))
        .withColumn("slot", F.floor(F.col("t") / F.lit(width)))
    )
    # Read three times below.
    instants = materialize(instants, "instants")
    found = instants.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).first()
    origin, slots = found["a"] or 0, (found["b"] or 0) - (found["a"] or 0) + 1
    times = instants.select("name", (F.col("slot") - origin).alias("slot"), "t")
    entries = _entries(_levels(times, cooldown, width, origin, slots))
    sends = (
        times.join(entries, ["name", "slot"])
        .groupBy("name", "slot")
        .applyInPandas(_mark_sends(cooldown), "name string, t long")
    )
    marks = instants.join(sends, ["name", "t"], "left_semi").select("name", F.col("t").alias("__t"), "first.*", F.lit(True).alias("sent"))
    joined = timed.join(marks, ["name", "__t", *keys], "left")
    reason = F.when(F.col("sent").isNull(), F.lit("duplicate within cooldown window"))
    return joined.select(*alerts.columns, F.coalesce("sent", F.lit(False)).alias("sent"), reason.alias("cooldown_reason"))


def send_counts(marked: DataFrame) -> DataFrame:
    """(name, last_sent, send_count) over the alerts that went out."""
    return marked.where("sent").groupBy("name").agg(F.max("ts").alias("last_sent"), F.count("*").alias("send_count"))


def fraud_alerts(log: DataFrame, width: str = "1 hour", **limits) -> DataFrame:
    """Rules evaluated per event-time window, for a log that grows without end."""
    per = windowed_summary(log, width)
    rate, conf = F.col("fraud_rate"), F.col("avg_probability")
    enough = F.col("total_count") >= limits.get("min_predictions", MIN_PREDICTIONS)
    high = F.when(enough & (rate > limits.get("fraud_rate_limit", FRAUD_RATE_LIMIT)), F.lit("high_fraud_rate"))
    low = F.when(enough & (conf < limits.get("low_confidence_limit", LOW_CONFIDENCE_LIMIT)), F.lit("low_confidence"))
    fired = per.select(
        F.col("window_end").alias("ts"), F.explode(F.array_compact(F.array(high, low))).alias("name"), "fraud_rate", "avg_probability"
    )
    return fired.withColumn("severity", F.when(F.col("name") == "high_fraud_rate", "CRITICAL").otherwise("WARNING"))

