"""Cleaning steps, each usable alone, and the two chains made of them.

A step that has to look at the data first reads bounded statistics (one row) and then returns a
lazy projection, so a chain of steps stays one select over the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewell.functions.exprs import (
    as_double,
    c,
    clamp,
    count_sql,
    double_sql,
    is_numeric,
    lit_double,
    numeric_columns,
    parse_boolean,
    parse_number,
    present,
    string_columns,
    strip_text,
)
from scorewell.operators.duplicates import without_duplicates
from scorewell.operators.stats import aggregate, duplicate_count, exact_modes, exact_quantiles, summarize
from scorewell.session import materialize

# The limits of the cleaning rules.
MISSING_DROP_RATE = 0.95
NUMERIC_STRING_RATE = 0.85
MAX_BOOLEAN_WORDS = 4
OUTLIER_WIDTH = 3.0
OUTLIER_COUNT_WIDTH = 1.5
MIN_OUTLIER_VALUES = 10


@dataclass
class CleaningReport:
    """What a chain changed: (step, column, n) rows, column null for whole-table steps."""

    steps: list[tuple[str, str | None, int]] = field(default_factory=list)

    def add(self, step: str, column: str | None, n: int) -> None:
        self.steps.append((step, column, int(n)))

    def columns(self, step: str) -> list[str]:
        return [col for s, col, _ in self.steps if s == step and col is not None]

    def to_frame(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.createDataFrame(self.steps, "step string, column string, n long")


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Equal rows once; NaN counts as missing. Rows that have no equal are not shuffled."""
    return without_duplicates(df)[0]


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(present(target, df.schema[target].dataType).isNotNull())


def high_missing_columns(df: DataFrame, limit: float = MISSING_DROP_RATE, target: str | None = None) -> list[str]:
    cols = [name for name in df.columns if name != target]
    n, stats = summarize(df, ["missing"], cols)
    return [name for name in cols if n and stats[name]["missing"] / n > limit]


def drop_high_missing(df: DataFrame, limit: float = MISSING_DROP_RATE, target: str | None = None) -> DataFrame:
    return df.drop(*high_missing_columns(df, limit, target))


def constant_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """Columns with at most one distinct value: their smallest is their largest."""
    cols = [name for name in df.columns if name != target]
    _, stats = summarize(df, ["constant"], cols)
    return [name for name in cols if stats[name]["constant"]]


def drop_constant(df: DataFrame, target: str | None = None) -> DataFrame:
    return df.drop(*constant_columns(df, target))


def _replace(df: DataFrame, new: dict) -> DataFrame:
    """One select that swaps some columns and keeps the order of all."""
    return df.select([new[name].alias(name) if name in new else c(name) for name in df.columns])


def boolean_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """Text columns whose every value is a yes/no word, in at most four spellings."""
    cols = string_columns(df, [target] if target else [])
    if not cols:
        return []
    n, stats = summarize(df, ["missing", "boolean_like"], cols)
    return [name for name in cols if _is_boolean(n, stats[name])]


def _is_boolean(n: int, s: dict) -> bool:
    return s["boolean_like"] == n - s["missing"] and s["boolean_words"] <= MAX_BOOLEAN_WORDS


def coerce_boolean(df: DataFrame, target: str | None = None) -> DataFrame:
    return _replace(df, {name: parse_boolean(c(name)) for name in boolean_columns(df, target)})


def numeric_string_columns(df: DataFrame, target: str | None = None, rate: float = NUMERIC_STRING_RATE) -> list[str]:
    """Text columns where at least ``rate`` of the values read as numbers."""
    cols = string_columns(df, [target] if target else [])
    if not cols:
        return []
    n, stats = summarize(df, ["missing", "numeric_like"], cols)
    return [name for name in cols if _is_numeric_text(n, stats[name], rate)]


def _is_numeric_text(n: int, s: dict, rate: float = NUMERIC_STRING_RATE) -> bool:
    values = n - s["missing"]
    return values > 0 and s["numeric_like"] / values >= rate


def coerce_numeric_strings(df: DataFrame, target: str | None = None, rate: float = NUMERIC_STRING_RATE) -> DataFrame:
    return _replace(df, {name: parse_number(c(name)) for name in numeric_string_columns(df, target, rate)})


def strip_whitespace(df: DataFrame, target: str | None = None) -> DataFrame:
    return _replace(df, {name: strip_text(c(name)) for name in string_columns(df, [target] if target else [])})


def outlier_bounds(
    df: DataFrame, cols: Sequence[str], method: str = "iqr", width: float = OUTLIER_WIDTH
) -> dict[str, tuple[float, float]]:
    """[low, high] per column; columns with few values or no spread are left out."""
    if not cols:
        return {}
    if method == "iqr":
        bounds = {}
        for name, (q1, q3) in exact_quantiles(df, cols, [0.25, 0.75], min_values=MIN_OUTLIER_VALUES).items():
            if q3 != q1:
                bounds[name] = (q1 - width * (q3 - q1), q3 + width * (q3 - q1))
        return bounds
    if method == "zscore":
        n, stats = summarize(df, ["missing", "moments"], cols)
        return {
            name: (s["mean"] - width * s["std"], s["mean"] + width * s["std"])
            for name, s in stats.items()
            if n - s["missing"] >= MIN_OUTLIER_VALUES and s["std"]
        }
    raise ValueError(f"unknown outlier method {method!r}")


def cap_outliers(
    df: DataFrame, method: str = "iqr", width: float = OUTLIER_WIDTH, cols: Sequence[str] | None = None
) -> DataFrame:
    """Clip numeric columns to their outlier bounds."""
    cols = numeric_columns(df) if cols is None else cols
    bounds = outlier_bounds(df, cols, method, width)
    return _replace(df, {name: clamp(as_double(df, name), *b) for name, b in bounds.items()})


def count_outside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    if not bounds:
        return {}
    exprs = {}
    for i, (name, (low, high)) in enumerate(bounds.items()):
        x = double_sql(df, name)
        exprs[f"o{i}"] = count_sql(f"{x} < {lit_double(low)} OR {x} > {lit_double(high)}")
    row = aggregate(df, exprs)
    return {name: row[f"o{i}"] for i, name in enumerate(bounds)}


def count_outliers_iqr(df: DataFrame, width: float = OUTLIER_COUNT_WIDTH) -> DataFrame:
    """(column, outliers): values strictly outside the quartile fences. Rows are not changed."""
    cols = numeric_columns(df)
    fences = {}
    for name, (q1, q3) in exact_quantiles(df, cols, [0.25, 0.75]).items():
        if q1 is not None:
            fences[name] = (q1 - width * (q3 - q1), q3 + width * (q3 - q1))
    counts = count_outside(df, fences)
    return df.sparkSession.createDataFrame(
        [(name, int(counts.get(name, 0))) for name in cols], "column string, outliers long"
    )


@dataclass(frozen=True)
class FillValues:
    """Replacement per column for missing cells, fitted once and usable on other frames."""

    values: dict[str, object]

    def apply(self, df: DataFrame) -> DataFrame:
        new = {}
        for name, value in self.values.items():
            if name in df.columns and value is not None:
                col = present(name, df.schema[name].dataType)
                dtype = "double" if is_numeric(df.schema[name].dataType) else df.schema[name].dataType.simpleString()
                new[name] = F.coalesce(col.cast(dtype), F.lit(value).cast(dtype))
        return _replace(df, new)


def fit_mean_mode(df: DataFrame) -> FillValues:
    """Mean for numeric columns, mode for the rest; only for columns with missing cells."""
    n, stats = summarize(df, ["missing", "moments"])
    holes = [name for name in df.columns if stats[name]["missing"]]
    means = {name: stats[name]["mean"] for name in holes if is_numeric(df.schema[name].dataType)}
    modes = exact_modes(df, [name for name in holes if name not in means])
    return FillValues({**means, **modes})


def impute_mean_mode(df: DataFrame, fill: FillValues | None = None) -> DataFrame:
    return (fill or fit_mean_mode(df)).apply(df)


def clean_basic(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Drop duplicates, then fill missing cells; ``fit_on`` gives the rows to take means from.

    The deduplicated table is written once: means, modes and the result read it back.
    """
    unique = materialize(drop_duplicates(df), "unique")
    return impute_mean_mode(unique, fit_mean_mode(fit_on if fit_on is not None else unique))


def clean_smart(
    df: DataFrame,
    target: str | None = None,
    outlier_method: str = "iqr",
    outlier_width: float = OUTLIER_WIDTH,
    missing_limit: float = MISSING_DROP_RATE,
    protect: Sequence[str] = (),
) -> tuple[DataFrame, CleaningReport]:
    """The whole chain, in order: names, duplicates, sparse and constant columns, yes/no words,
    written numbers, white space, outliers. The target and the columns in ``protect`` stay as they are.

    The deduplicated table is written once; two passes of statistics read it back column by
    column, and the result is one lazy select over it.
    """
    report = CleaningReport()
    named = strip_column_names(df)
    rows, n_before = without_duplicates(named)
    unique = materialize(rows, "unique")
    cols = [name for name in unique.columns if name != target and name not in protect]
    n, stats = summarize(unique, ["missing", "constant", "numeric_like", "boolean_like", "padded"], cols)
    report.add("rows_before", None, n_before)
    report.add("duplicates_removed", None, n_before - n)

    sparse = [name for name in cols if n and stats[name]["missing"] / n > missing_limit]
    constant = [name for name in cols if name not in sparse and stats[name]["constant"]]
    kept = [name for name in cols if name not in sparse and name not in constant]
    texts = [name for name in kept if isinstance(unique.schema[name].dataType, T.StringType)]
    booleans = [name for name in texts if _is_boolean(n, stats[name])]
    numbers = [name for name in texts if name not in booleans and _is_numeric_text(n, stats[name])]
    plain = [name for name in texts if name not in booleans and name not in numbers]
    for name in sparse:
        report.add("high_missing_dropped", name, stats[name]["missing"])
    for step, names in [("constant_dropped", constant), ("boolean_coerced", booleans), ("numeric_string_coerced", numbers)]:
        for name in names:
            report.add(step, name, n - stats[name]["missing"])

    new = {name: parse_boolean(c(name)) for name in booleans}
    new |= {name: parse_number(c(name)) for name in numbers}
    new |= {name: strip_text(c(name)) for name in plain}
    for name in plain:
        if stats[name]["padded"]:
            report.add("whitespace_stripped", name, stats[name]["padded"])
    typed = _replace(unique.drop(*sparse, *constant), new)

    result = typed
    if outlier_method != "none":
        numeric = numeric_columns(typed, [*protect, target])
        bounds = outlier_bounds(typed, numeric, outlier_method, outlier_width)
        outside = {name: k for name, k in count_outside(typed, bounds).items() if k}
        for name, k in outside.items():
            report.add("outliers_capped", name, k)
        result = _replace(typed, {name: clamp(as_double(typed, name), *bounds[name]) for name in outside})
    report.add("rows_after", None, n)
    return result, report


def duplicates_removed(df: DataFrame) -> DataFrame:
    """(rows_before, duplicates, rows_after) without moving whole rows."""
    extra = duplicate_count(df)
    return df.agg(F.count(F.lit(1)).alias("rows_before")).select(
        "rows_before", F.lit(extra).cast("long").alias("duplicates"), (F.col("rows_before") - extra).alias("rows_after")
    )


@dataclass(frozen=True)
class Alignment:
    matched: list[str]
    missing: list[str]
    extra: list[str]


def alignment(df: DataFrame, features: Sequence[str]) -> Alignment:
    have = set(df.columns)
    return Alignment(
        [f for f in features if f in have],
        [f for f in features if f not in have],
        [name for name in df.columns if name not in set(features)],
    )


def align_columns(
    df: DataFrame, features: Sequence[str], fill: float = 0, strict: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """The expected features in order. Absent ones become a literal, or raise when ``strict``;
    others are dropped apart from ``keep``. Null cells are not touched."""
    match = alignment(df, features)
    if strict and match.missing:
        raise ValueError(f"missing features: {match.missing}")
    return df.select(*[c(k) for k in keep], *[c(f) if f in match.matched else F.lit(fill).alias(f) for f in features])
