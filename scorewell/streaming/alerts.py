"""Alert cooldown over a stream of alerts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scorewell.operators.monitor import COOLDOWN_SECONDS, micros

OUTPUT = "name string, id long, t long, sent boolean, send_count long"
ROWS_AT_ONCE = 1 << 16


def _numbers(ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Ids as whole numbers (0 for a null), and which are known."""
    known = ids.notna().to_numpy()
    return ids.where(known, 0).to_numpy(np.int64), known


def sends(times: np.ndarray, last: int | None, cooldown: int) -> tuple[np.ndarray, int | None]:
    """Which of the sorted times go out after the send at ``last`` (None: there was none), and the newest send."""
    sent = np.zeros(len(times), bool)
    # From one send to the next: what lies between is never looked at one by one.
    at = 0 if last is None else int(np.searchsorted(times, last + cooldown, side="left"))
    while at < len(times):
        sent[at], last = True, int(times[at])
        at = int(np.searchsorted(times, last + cooldown, side="left"))
    return sent, last


def stream_cooldown(alerts: DataFrame, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """(name, id, t, sent, send_count) for a stream with (name, id, ts).

    The state is two numbers per alert name: when it last went out and how often it has. Within
    a micro-batch the alerts of a name are taken in time order; one that arrives after a later
    one has gone out counts as within its cooldown.
    """
    cooldown = seconds * 1_000_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (None, 0)
        # Of a name's alerts only two numbers each are held; an id may be null.
        parts = [(b["t"].to_numpy(np.int64), *_numbers(b["id"])) for b in batches]
        times, ids, known = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((ids, ~known, times))
        times, ids, known = times[order], ids[order], known[order]
        del order
        sent, last = sends(times, last, cooldown)
        state.update((last, int(count + sent.sum())))
        for i in range(0, len(times), ROWS_AT_ONCE):
            part = slice(i, i + ROWS_AT_ONCE)
            counts = count + np.cumsum(sent[part])
            count = int(counts[-1])
            named = pd.Series(pd.array(ids[part], "Int64")).where(known[part])
            yield pd.DataFrame({"name": key[0], "id": named, "t": times[part], "sent": sent[part], "send_count": counts})

    timed = alerts.select("name", F.col("id").cast("long").alias("id"), micros(F.col("ts")).alias("t"))
    return timed.groupBy("name").applyInPandasWithState(
        fold, OUTPUT, "last long, count long", "append", GroupStateTimeout.NoTimeout
    )
