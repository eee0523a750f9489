"""Target encoding, imputation, scaling and one-hot columns: fitted once, applied lazily."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewell.functions.exprs import as_double, c, is_numeric
from scorewell.operators.cleaning import FillValues
from scorewell.operators.sampling import class_sizes
from scorewell.operators.stats import exact_modes, exact_quantiles, summarize, value_counts

MAX_CATEGORIES = 50
LITERAL_CATEGORIES = 10_000
#: Flags that one column may become; beyond, fitting refuses.
MOST_FLAGS = 5_000
POOLED = "infrequent"


@dataclass(frozen=True)
class TargetEncoding:
    """Class value to label."""

    labels: dict[object, int]

    def column(self, target: str) -> Column:
        out = F.lit(None).cast("int")
        for value, label in self.labels.items():
            out = F.when(c(target) == F.lit(value), F.lit(label)).otherwise(out)
        return out


def fit_target(df: DataFrame, target: str, positive_label: object = None) -> TargetEncoding:
    """0/1 targets stay; a given positive label becomes 1 and the rest 0; otherwise classes are
    numbered in sorted order."""
    values = sorted(v for v in class_sizes(df, target) if v is not None)
    if set(values) <= {0, 1}:
        return TargetEncoding({v: int(v) for v in values})
    if positive_label is not None:
        wanted = type(values[0])(positive_label)
        return TargetEncoding({v: int(v == wanted) for v in values})
    return TargetEncoding({v: i for i, v in enumerate(values)})


def encode_target(df: DataFrame, target: str, positive_label: object = None, name: str = "label") -> DataFrame:
    return df.withColumn(name, fit_target(df, target, positive_label).column(target))


def fit_medians(df: DataFrame, cols: Sequence[str]) -> FillValues:
    return FillValues({name: q[0] for name, q in exact_quantiles(df, cols, [0.5]).items()})


def fit_most_frequent(df: DataFrame, cols: Sequence[str]) -> FillValues:
    return FillValues(exact_modes(df, cols))


@dataclass(frozen=True)
class StandardScale:
    """Mean and population deviation per column; a constant column scales to 0."""

    stats: dict[str, tuple[float, float]]

    def column(self, df: DataFrame, name: str) -> Column:
        mean, std = self.stats[name]
        return (as_double(df, name) - F.lit(mean)) / F.lit(std or 1.0)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select([self.column(df, x).alias(x) if x in self.stats else c(x) for x in df.columns])


def fit_standard_scale(df: DataFrame, cols: Sequence[str]) -> StandardScale:
    _, stats = summarize(df, ["moments"], cols)
    return StandardScale({name: (stats[name]["mean"], stats[name]["std_pop"]) for name in cols if stats[name]["mean"] is not None})


@dataclass(frozen=True)
class OneHot:
    """Kept categories per column, and the table of all categories where some are pooled.

    Unseen values get zeros everywhere. Pooled ones are told from unseen ones by a literal set
    while they are few, and by a join with the table of seen categories beyond that.
    """

    kept: dict[str, list[str]]
    pooled: dict[str, list[str] | None]
    seen: DataFrame
    modes: dict[str, str]

    def names(self, column: str) -> list[str]:
        extra = [f"{column}={POOLED}"] if self.pooled[column] != [] else []
        return [f"{column}={value}" for value in self.kept[column]] + extra

    def apply(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        out = df
        flags: list[Column] = []
        for name, values in self.kept.items():
            text = c(name).cast("string")
            flags += [F.coalesce(text == F.lit(v), F.lit(False)).cast("int").alias(f"{name}={v}") for v in values]
            rest = self.pooled[name]
            if rest is None:
                mark = f"__{name}_seen"
                known = self.seen.where(F.col("feature") == name).select(
                    F.col("value").alias(f"__{name}_value"), F.lit(True).alias(mark)
                )
                out = out.join(known, text == F.col(f"__{name}_value"), "left").drop(f"__{name}_value")
                is_rest = F.coalesce(F.col(mark), F.lit(False)) & ~text.isin(values)
                flags.append(F.coalesce(is_rest, F.lit(False)).cast("int").alias(f"{name}={POOLED}"))
            elif rest:
                flags.append(F.coalesce(text.isin(rest), F.lit(False)).cast("int").alias(f"{name}={POOLED}"))
        others = keep if keep is not None else [x for x in df.columns if x not in self.kept]
        return out.select(*[c(x) for x in others], *flags)


def fit_one_hot(
    df: DataFrame,
    cols: Sequence[str],
    max_categories: int | None = MAX_CATEGORIES,
    literal_categories: int = LITERAL_CATEGORIES,
) -> OneHot:
    """Categories in sorted order. Beyond ``max_categories`` the most frequent stay (the later
    value among equals) and one more column takes the rest."""
    return one_hot_of(value_counts(df, cols), cols, max_categories, literal_categories)


def one_hot_of(
    counts: DataFrame,
    cols: Sequence[str],
    max_categories: int | None = MAX_CATEGORIES,
    literal_categories: int = LITERAL_CATEGORIES,
) -> OneHot:
    """``fit_one_hot`` from the (feature, value, n) rows of the columns."""
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    facts = counts.groupBy("feature").agg(
        F.count("*").alias("n"), F.expr("min_by(value, struct(-n, value)) AS mode")
    ).collect()
    totals = {r["feature"]: r["n"] for r in facts}
    keep = {
        x: totals.get(x, 0) if max_categories is None or totals.get(x, 0) <= max_categories else max_categories - 1
        for x in cols
    }
    if too_many := {x: n for x, n in keep.items() if n > MOST_FLAGS}:
        raise ValueError(f"more than {MOST_FLAGS} flags from one column: {too_many}; set max_categories")
    # Only columns within the limit are gathered in full.
    limit = max(keep.values(), default=0)
    order = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value").desc())
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    kept: dict[str, list[str]] = {x: [] for x in cols}
    for r in ranked.collect():
        if r["rank"] <= keep[r["feature"]]:
            kept[r["feature"]].append(r["value"])
    pooled: dict[str, list[str] | None] = {}
    for x in cols:
        rest = totals.get(x, 0) - keep[x]
        if rest == 0:
            pooled[x] = []
        elif rest > literal_categories:
            pooled[x] = None
        else:
            seen = counts.where((F.col("feature") == x) & ~F.col("value").isin(kept[x]))
            pooled[x] = sorted(r["value"] for r in seen.select("value").collect())
    counts.unpersist()
    modes = {r["feature"]: r["mode"] for r in facts}
    return OneHot({x: sorted(v) for x, v in kept.items()}, pooled, counts.select("feature", "value"), modes)


def one_hot(df: DataFrame, cols: Sequence[str], max_categories: int | None = MAX_CATEGORIES) -> DataFrame:
    return fit_one_hot(df, cols, max_categories).apply(df)


def feature_kinds(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and other columns among ``features``, by type."""
    numeric = [x for x in features if is_numeric(df.schema[x].dataType)]
    return numeric, [x for x in features if x not in numeric]
