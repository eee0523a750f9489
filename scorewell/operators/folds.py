"""What a preprocessor learns, for every cross-validation fold at once.

A fold's training rows are all rows but its own. Counts and moments are kept per fold and put together from the other
folds' parts; quantiles of all folds are narrowed side by side. The number of scans is that of one fit, whatever the number of folds.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.functions.exprs import c, double_sql, q
from scorewell.operators.encode import MAX_CATEGORIES, OneHot, fit_medians, one_hot_of
from scorewell.operators.stats import value_counts

Moments = tuple[int, float, float]


@dataclass(frozen=True)
class ColumnStatistics:
    """Medians, (mean, population deviation) after the median has filled missing cells, and categories of some rows."""

    medians: dict[str, float | None]
    scale: dict[str, tuple[float, float]]
    categories: OneHot | None

    def rows(self) -> list[tuple[str, str, float | None, str | None]]:
        """(column, statistic, value, text)."""
        out = [(x, "median", v, None) for x, v in self.medians.items()]
        for x, pair in self.scale.items():
            out += [(x, name, v, None) for name, v in zip(("mean", "std"), pair)]
        if self.categories:
            out += [(x, "mode", None, self.categories.modes.get(x)) for x in self.categories.kept]
            out += [(x, "kept", None, json.dumps(v)) for x, v in self.categories.kept.items()]
        return out


def merged(parts: Iterable[Moments]) -> Moments:
    """(count, mean, sum of squared deviations) of rows whose parts have these; nothing is subtracted, so no digits cancel."""
    n, mean, spread = 0, 0.0, 0.0
    for k, m, s in parts:
        if k:
            gap = m - mean
            spread += s + gap * gap * n * k / (n + k)
            mean += gap * k / (n + k)
            n += k
    return n, mean, spread


def fold_moments(dealt: DataFrame, fold: str, cols: Sequence[str]) -> dict[str, dict[int, tuple[Moments, int]]]:
    """Per column and fold: the moments of its values, and how many are missing. One scan, one row per fold."""
    facts = []
    for i, x in enumerate(cols):
        v = double_sql(dealt, x)
        facts += [F.expr(f"count({v})").alias(f"n{i}"), F.expr(f"avg({v})").alias(f"m{i}"), F.expr(f"var_pop({v})").alias(f"v{i}")]
    rows = dealt.groupBy(c(fold).alias("__fold")).agg(F.count("*").alias("rows"), *facts).collect() if cols else []
    return {
        x: {r["__fold"]: ((r[f"n{i}"], r[f"m{i}"] or 0.0, (r[f"v{i}"] or 0.0) * r[f"n{i}"]), r["rows"] - r[f"n{i}"]) for r in rows}
        for i, x in enumerate(cols)
    }


def fold_medians(dealt: DataFrame, fold: str, folds: Sequence[int], cols: Sequence[str]) -> dict[int, dict[str, float | None]]:
    """Per fold and column: the median over the other folds' rows."""
    names = {(f, x): f"m{i}_{j}" for i, f in enumerate(folds) for j, x in enumerate(cols)}
    wide = dealt.selectExpr(*[f"if({q(fold)} <> {int(f)}, {double_sql(dealt, x)}, null) AS {name}" for (f, x), name in names.items()])
    found = fit_medians(wide, list(names.values())).values if names else {}
    return {f: {x: found.get(names[f, x]) for x in cols} for f in folds}


def fold_statistics(
    dealt: DataFrame, fold: str, folds: Sequence[int], numeric: Sequence[str], categorical: Sequence[str],
    max_categories: int | None = MAX_CATEGORIES,
) -> dict[int, ColumnStatistics]:
    """For each of ``folds`` what all rows outside it say of the columns; rows without a fold are in no training part.

    A column with no value outside a fold has no median and no scale there, and no categories.
    """
    folds, numeric, categorical = list(folds), list(numeric), list(categorical)
    dealt = dealt.where(c(fold).isin(folds))
    moments, medians = fold_moments(dealt, fold, numeric), fold_medians(dealt, fold, folds, numeric)
    counts = None
    if categorical:
        # One row per distinct value, with its count in each fold: folded in the tasks before the shuffle.
        texts = dealt.selectExpr(f"{q(fold)} AS __fold", *[f"cast({q(x)} AS string) AS {q(x)}" for x in categorical])
        inside = {f"n{i}": F.count_if(F.col("__fold") == f) for i, f in enumerate(folds)}
        counts = value_counts(texts, categorical, extra=inside, keep=["__fold"]).persist(StorageLevel.MEMORY_AND_DISK)
    out = {}
    for i, f in enumerate(folds):
        scale = {}
        for x in numeric:
            others = [part for g, part in moments[x].items() if g != f]
            if medians[f][x] is not None:
                filled = (sum(missing for _, missing in others), medians[f][x], 0.0)
                n, mean, spread = merged([*(part for part, _ in others), filled])
                scale[x] = (mean, (spread / n) ** 0.5)
        outside = counts.select("feature", "value", (F.col("n") - F.col(f"n{i}")).alias("n")).where("n > 0") if categorical else None
        out[f] = ColumnStatistics(medians[f], scale, one_hot_of(outside, categorical, max_categories) if categorical else None)
    if counts is not None:
        counts.unpersist()
    return out


def statistics_frame(spark, found: dict[int, ColumnStatistics]) -> DataFrame:
    """(fold, column, statistic, value, text) of all folds: a few rows per column."""
    rows = [(f, *row) for f, stats in found.items() for row in stats.rows()]
    return spark.createDataFrame(rows, "fold int, column string, statistic string, value double, text string")
