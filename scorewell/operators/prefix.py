"""Running totals over a sorted column without sending the rows through one task.

The order column is cut into ranges at quantiles read from a sketch. Each range is summed, the
few range sums are accumulated, and a window inside each range adds its start. Ranges are a
function of the value itself, so a recomputed task always lands in the same range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewell.functions.exprs import lit_double, q

MAX_RANGES = 20_000
MIN_RANGES = 4
ROWS_PER_RANGE = 5_000_000


def range_count(df: DataFrame) -> int:
    """How many ranges to start from: some per shuffle partition, within a fixed bound."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(MIN_RANGES, min(MAX_RANGES, 2 * partitions))


def quantile_cuts(df: DataFrame, cols: Sequence[str], ranges: int | None = None) -> dict[str, list[float]]:
    """Sketched quantile cut points per column, from one aggregation over ``df``.

    A table with more than ``ROWS_PER_RANGE`` rows per range is sketched once more, more finely,
    so that a range stays within what one task sorts well.
    """
    n = ranges or range_count(df)

    def sketch(parts: int):
        at = ", ".join(lit_double(i / parts) for i in range(1, parts))
        accuracy = max(1_000, 10 * parts)
        return df.selectExpr(
            "count(1) AS n", *[f"percentile_approx({q(x)}, array({at}), {accuracy}) AS q{i}" for i, x in enumerate(cols)]
        ).first()

    row = sketch(n)
    if row["n"] > n * ROWS_PER_RANGE and n < MAX_RANGES:
        row = sketch(min(MAX_RANGES, -(-row["n"] // ROWS_PER_RANGE)))
    return {x: sorted({float(v) for v in row[f"q{i}"] or []}) for i, x in enumerate(cols)}


def splits_of(cuts: Sequence[float]) -> list[float]:
    inner = [v for v in cuts if math.isfinite(v)] or [0.0]
    return [-math.inf, *inner, math.inf]


def with_ranges(df: DataFrame, cuts: dict[str, list[float]], suffix: str = "__range") -> DataFrame:
    """Add ``<column>__range``: the number of cut points at or below the value."""
    cols = list(cuts)
    ranged = Bucketizer(
        splitsArray=[splits_of(cuts[col]) for col in cols],
        inputCols=cols,
        outputCols=[col + suffix for col in cols],
        handleInvalid="keep",
    ).transform(df)
    # Never null, so that the later join on the range adds no filter to one of its sides only and
    # both sides read the same shuffle.
    kept = [q(x) for x in df.columns]
    return ranged.selectExpr(*kept, *[f"coalesce(int({q(x + suffix)}), 0) AS {q(x + suffix)}" for x in cols])


def running_totals(
    df: DataFrame, order: str, sums: Sequence[str], range_col: str, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``<s>_before`` (sum over smaller ``order``) and ``<s>_total`` for each column of ``sums``.

    ``df`` holds one row per (``by``, ``order``) and the range of ``order`` in ``range_col``. The
    frame of range starts has at most ranges x groups rows, so it is broadcast.
    """
    by = list(by)
    starts_of = Window.partitionBy(*by).orderBy(range_col) if by else Window.orderBy(range_col)
    earlier = starts_of.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    starts = df.groupBy(*by, range_col).agg(*[F.sum(s).alias(s) for s in sums])
    starts = starts.select(
        *by,
        range_col,
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}__start") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
    )
    inside = (
        Window.partitionBy(*by, range_col).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = df.withColumns({f"{s}__local": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    joined = local.join(F.broadcast(starts), [*by, range_col])
    return joined.select(
        *df.columns,
        *[(F.col(f"{s}__start") + F.col(f"{s}__local")).alias(f"{s}_before") for s in sums],
        *[F.col(f"{s}_total") for s in sums],
    )
