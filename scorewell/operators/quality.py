"""Quality issues, column roles and dataset profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scorewell.functions.exprs import c, count_if, is_integer, present
from scorewell.operators.stats import (
    adjusted_skew,
    correlation_pairs,
    duplicate_count,
    exact_distinct,
    exact_quantiles,
    missing_counts,
    settle_distinct,
    summarize,
    value_counts,
)

# Limits of the quality rules and the name patterns that mark ids and dates.
MISSING_WARNING, MISSING_ERROR = 0.3, 0.7
NUMERIC_STRING_RATE = 0.85
CARDINALITY_MIN, CARDINALITY_RATIO = 50, 0.5
IMBALANCE_LIMIT, LOADER_IMBALANCE_LIMIT = 0.2, 0.1
HIGH_CORRELATION, HIGH_CORRELATION_PAIRS = 0.95, 5
TOP_VALUES = 5
TEXT_LENGTH, TEXT_UNIQUE = 50, 50
ID_STRING_RATIO, ID_STRING_UNIQUE = 0.5, 100
ID_INT_RATIO, ID_INT_UNIQUE = 0.9, 10_000
CATEGORY_INTS = 10
DATE_RATE = 0.8
ID_PATTERNS = (
    "id _id id_ uuid guid key index rownum row_num record seq sequence customerid userid accountid transactionid "
    "customer_id user_id account_id transaction_id phone mobile ssn passport"
).split()
DATE_PATTERNS = "date time timestamp created updated datetime dt year month day dob birth".split()

# Row counts where a size tier ends, with its label and its training plan.
TIERS = [
    (1_000, "TINY", "Tiny    (<1K rows)"),
    (50_000, "SMALL", "Small   (1K - 50K rows)"),
    (200_000, "MEDIUM", "Medium  (50K - 200K rows)"),
    (500_000, "LARGE", "Large   (200K - 500K rows)"),
    (2_000_000, "XLARGE", "XLarge  (500K - 2M rows)"),
    (None, "MASSIVE", "Massive (2M+ rows)"),
]

ISSUE_SCHEMA = "type string, severity string, column string, count long, message string"


def tier_of(n_rows: int) -> int:
    return next(i for i, (end, _, _) in enumerate(TIERS) if end is None or n_rows < end)


def size_tier(df: DataFrame) -> DataFrame:
    """(n_rows, tier, name, label) of a table."""
    n = F.col("n_rows")
    tier = F.lit(len(TIERS) - 1)
    for i in reversed(range(len(TIERS) - 1)):
        tier = F.when(n < TIERS[i][0], F.lit(i)).otherwise(tier)
    names = F.array(*[F.lit(name) for _, name, _ in TIERS])
    labels = F.array(*[F.lit(label) for _, _, label in TIERS])
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("tier", tier)
        .select("n_rows", "tier", names[F.col("tier")].alias("name"), labels[F.col("tier")].alias("label"))
    )


def quality_issues(df: DataFrame, target: str | None = None) -> list[Row]:
    """Every issue of the table, from one fused aggregation, a duplicate count, and one more pass
    for the columns whose distinct count lies near a limit."""
    issue = Row("type", "severity", "column", "count", "message")
    others = [name for name in df.columns if name != target]
    n, stats = summarize(df, ["missing", "constant", "numeric_like", "distinct"])
    if n == 0:
        return [issue("empty", "error", None, None, "the table has no rows")]
    texts = [name for name in others if isinstance(df.schema[name].dataType, T.StringType)]
    cutoffs = {name: [CARDINALITY_MIN, CARDINALITY_RATIO * n] for name in texts}
    if target in df.columns:
        cutoffs[target] = [1, 2]
    counted = [name for name in texts if not stats[name]["constant"]] + ([target] if target in df.columns else [])
    approx = {name: stats[name]["distinct"] for name in counted}
    unique = settle_distinct(df, approx, cutoffs)
    found = []
    extra = duplicate_count(df)
    if extra:
        found.append(issue("duplicates", "warning", None, extra, f"{extra} duplicate rows"))
    for name in others:
        missing = stats[name]["missing"]
        if missing / n > MISSING_WARNING:
            severity = "error" if missing / n > MISSING_ERROR else "warning"
            found.append(issue("high_missing", severity, name, missing, f"{name}: {missing} of {n} values missing"))
    for name in others:
        if stats[name]["constant"]:
            found.append(issue("constant_col", "warning", name, None, f"{name}: at most one distinct value"))
    if target in df.columns:
        missing = stats[target]["missing"]
        if missing:
            found.append(issue("target_missing", "error", target, missing, f"target has {missing} missing values"))
        classes = unique[target]
        if classes > 2:
            found.append(issue("multiclass", "error", target, classes, "target has more than two classes"))
        elif classes == 1:
            found.append(issue("single_class", "error", target, None, "target has one class only"))
    for name in texts:
        if unique.get(name, 0) > CARDINALITY_MIN and unique[name] / n < CARDINALITY_RATIO:
            found.append(issue("high_cardinality", "warning", name, None, f"{name}: many distinct values"))
    for name in texts:
        values = n - stats[name]["missing"]
        if values and stats[name]["numeric_like"] / values >= NUMERIC_STRING_RATE:
            found.append(issue("numeric_string", "info", name, None, f"{name}: numbers stored as text"))
    return found


def quality_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row per issue: (type, severity, column, count, message)."""
    return df.sparkSession.createDataFrame(quality_issues(df, target), ISSUE_SCHEMA)


def quality_grade(report: DataFrame) -> DataFrame:
    """Counts per severity, the overall grade, and whether anything blocks training."""
    counts = report.agg(
        *[count_if(F.col("severity") == s).alias(name) for s, name in
          [("error", "n_errors"), ("warning", "n_warnings"), ("info", "n_info")]]
    )
    grade = (
        F.when(F.col("n_errors") > 0, "poor")
        .when(F.col("n_warnings") > 3, "fair")
        .when(F.col("n_warnings") > 0, "good")
        .otherwise("excellent")
    )
    return counts.select("*", grade.alias("overall_quality"), (F.col("n_errors") > 0).alias("has_blockers"))


def _named_like(name: str, patterns: Sequence[str]) -> bool:
    lowered = name.lower().replace(" ", "_").replace("-", "_")
    return any(p in lowered for p in patterns)


def column_roles(
    df: DataFrame,
    target: str | None = None,
    overrides: dict[str, str] | None = None,
    id_patterns: Sequence[str] = ID_PATTERNS,
    date_patterns: Sequence[str] = DATE_PATTERNS,
    id_ints: int | None = None,
) -> dict[str, str]:
    """Column name to role: id, date, text, numeric or cat. ``overrides`` win over the rules.

    An integer column is an id when nearly all its values differ; with ``id_ints`` also when it has more different
    values than that, however many rows there are.
    """
    cols = [name for name in df.columns if name != target]
    n, stats = summarize(df, ["missing", "distinct", "text", "date_like"], cols)
    cutoffs = {}
    for name in cols:
        dtype = df.schema[name].dataType
        if is_integer(dtype):
            cutoffs[name] = [CATEGORY_INTS, _id_from(n, id_ints)]
        elif isinstance(dtype, T.StringType):
            cutoffs[name] = [ID_STRING_UNIQUE, ID_STRING_RATIO * n, TEXT_UNIQUE]
    unique = settle_distinct(df, {name: stats[name]["distinct"] for name in cols}, cutoffs)
    return {
        name: (overrides or {}).get(name)
        or _role(name, df.schema[name].dataType, n, unique[name], stats[name], id_patterns, date_patterns, id_ints)
        for name in cols
    }


def _id_from(n: int, id_ints: int | None) -> float:
    return min(ID_INT_RATIO * n, id_ints) if id_ints else ID_INT_RATIO * n


def _role(name, dtype, n, n_unique, s, id_patterns, date_patterns, id_ints) -> str:
    values = n - s["missing"]
    if values == 0:
        return "id"
    date_name = _named_like(name, date_patterns)
    text = isinstance(dtype, T.StringType)
    many_ints = is_integer(dtype) and n_unique > _id_from(n, id_ints)
    many_words = text and n_unique / n > ID_STRING_RATIO and n_unique > ID_STRING_UNIQUE
    if _named_like(name, id_patterns) or many_ints or many_words:
        return "date" if date_name else "id"
    if date_name or isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if text:
        if s["date_like"] / values > DATE_RATE:
            return "date"
        return "text" if s["avg_len"] > TEXT_LENGTH and n_unique > TEXT_UNIQUE else "cat"
    if isinstance(dtype, T.BooleanType) or (is_integer(dtype) and n_unique <= CATEGORY_INTS):
        return "cat"
    return "numeric"


def detect_column_roles(df: DataFrame, target: str | None = None, overrides: dict[str, str] | None = None, id_ints: int | None = None) -> DataFrame:
    """(column, role) with ``is_feature`` for the numeric and categorical ones."""
    rows = [(name, role, role in ("numeric", "cat")) for name, role in column_roles(df, target, overrides, id_ints=id_ints).items()]
    return df.sparkSession.createDataFrame(rows, "column string, role string, is_feature boolean")


PROFILE_SCHEMA = (
    "column string, missing long, missing_pct double, mean double, std double, min double, max double, "
    "median double, skew double"
)


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing cells, mean, deviation, extremes, median and skew of numeric columns, all rows counted."""
    n, stats = summarize(df, ["missing", "range", "moments"], cols)
    medians = exact_quantiles(df, cols, [0.5])
    rows = []
    for name in cols:
        s = stats[name]
        values = n - s["missing"]
        rows.append(
            (
                name,
                s["missing"],
                100.0 * s["missing"] / n if n else 0.0,
                s["mean"],
                s["std"],
                None if s["min"] is None else float(s["min"]),
                None if s["max"] is None else float(s["max"]),
                medians[name][0],
                adjusted_skew(s["skew_pop"], values),
            )
        )
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def categorical_profile(df: DataFrame, cols: Sequence[str], top: int = TOP_VALUES) -> DataFrame:
    """(column, n_unique, rank, value, n): the most frequent values of each column, ties by value.

    The per-column ranking keeps ``top`` rows per task before its shuffle, so a column with very
    many values does not send them all to one task.
    """
    counts = value_counts(df, cols)
    order = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value"))
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    # The condition keeps the counts in this branch too, so that both read one shuffle.
    unique = counts.groupBy("feature").agg(count_if(F.col("n") > 0).alias("n_unique"))
    return best.join(F.broadcast(unique), "feature").select(
        F.col("feature").alias("column"), "n_unique", "rank", "value", "n"
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(value, n, pct, minority_ratio, is_imbalanced, n_classes), missing targets left out of the classes."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    counts = df.groupBy(c(target).cast("string").alias("value")).agg(F.count("*").alias("n"))
    classes = counts.where(F.col("value").isNotNull())
    overall = counts.agg(F.struct(
        F.sum("n").alias("rows"),
        F.min(F.when(F.col("value").isNotNull(), F.col("n"))).alias("least"),
        count_if(F.col("value").isNotNull()).alias("n_classes"),
    ).alias("o"))
    total = overall.scalar()
    ratio = total.getField("least") / total.getField("rows")
    return classes.select(
        "value",
        "n",
        (F.col("n") * 100.0 / total.getField("rows")).alias("pct"),
        ratio.alias("minority_ratio"),
        (ratio < IMBALANCE_LIMIT).alias("is_imbalanced"),
        total.getField("n_classes").alias("n_classes"),
    )


def target_balance(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, rows with a target, minority ratio, and the loader's imbalance flag."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    counts = drop_null(df, target).groupBy(c(target)).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_classes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.try_divide(F.min("n").cast("double"), F.sum("n")).alias("minority_ratio"),
    ).withColumn(
        "high_imbalance",
        F.coalesce((F.col("n_classes") == 2) & (F.col("minority_ratio") < LOADER_IMBALANCE_LIMIT), F.lit(False)),
    )


def drop_null(df: DataFrame, name: str) -> DataFrame:
    return df.where(present(name, df.schema[name].dataType).isNotNull())


def missing_summary(df: DataFrame) -> DataFrame:
    """Share of missing cells in percent over the whole table, and the columns that have any."""
    per = missing_counts(df)
    return per.agg(
        F.sum("missing").alias("missing_cells"),
        (F.avg("rate") * 100).alias("missing_pct"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("missing") > 0, F.col("column")))), ",").alias("missing_cols"),
    )


def high_corr_pairs(
    df: DataFrame, cols: Sequence[str], limit: float = HIGH_CORRELATION, top: int = HIGH_CORRELATION_PAIRS
) -> DataFrame:
    """The strongest pairs by absolute correlation above ``limit``."""
    strong = correlation_pairs(df, cols).withColumn("abs_corr", F.abs("corr")).where(F.col("abs_corr") > limit)
    return strong.orderBy(F.col("abs_corr").desc(), "a", "b").limit(top).select("a", "b", "abs_corr")


def dataset_metadata(df: DataFrame) -> DataFrame:
    """One row: row and column counts and the names of the numeric and text columns."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(numeric)).alias("numeric_columns"),
        F.lit(",".join(texts)).alias("categorical_columns"),
    )


def dataset_profile(df: DataFrame, target: str, overrides: dict[str, str] | None = None) -> dict:
    """Roles, statistics, classes, correlations and quality of a table.

    Bounded facts come back as plain values, reports with one row per column as DataFrames.
    """
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    features = [name for name in df.columns if name != target]
    n, stats = summarize(df, ["missing"])
    if n == 0:
        raise ValueError("cannot profile a table without rows")
    roles = column_roles(df, target, overrides)
    by_role = {r: [x for x in features if roles[x] == r] for r in ("id", "date", "text", "numeric", "cat")}
    classes = {row["value"]: row["n"] for row in class_distribution(df, target).collect()}
    ratio = min(classes.values(), default=0) / n
    tier = tier_of(n)
    cells = sum(stats[name]["missing"] for name in features)
    return {
        "n_rows": n,
        "n_cols": len(features),
        "tier": tier,
        "tier_name": TIERS[tier][1],
        "tier_label": TIERS[tier][2],
        "roles": roles,
        "numeric_cols": by_role["numeric"],
        "categorical_cols": by_role["cat"],
        "id_cols": by_role["id"],
        "date_cols": by_role["date"],
        "text_cols": by_role["text"],
        "target_col": target,
        "n_classes": len(classes),
        "class_counts": classes,
        "minority_ratio": ratio,
        "is_imbalanced": ratio < IMBALANCE_LIMIT,
        "missing_pct": 100.0 * cells / (n * len(features)) if features else 0.0,
        "missing_cols": [name for name in df.columns if stats[name]["missing"]],
        "id_unique": exact_distinct(df, by_role["id"]),
        "numeric_stats": numeric_profile(df, by_role["numeric"]),
        "categorical_stats": categorical_profile(df, by_role["cat"]) if by_role["cat"] else None,
        "high_corr_pairs": high_corr_pairs(df, by_role["numeric"]),
        "quality": quality_report(df, target),
    }


def profile_frame(df: DataFrame, target: str) -> DataFrame:
    """The one-row facts of ``dataset_profile`` as a DataFrame."""
    p = dataset_profile(df, target)
    columns = "numeric_cols categorical_cols id_cols date_cols text_cols missing_cols".split()
    row = [p["n_rows"], p["n_cols"], p["tier_name"], p["n_classes"], float(p["minority_ratio"]),
           bool(p["is_imbalanced"]), float(p["missing_pct"])] + [",".join(p[k]) for k in columns]
    schema = (
        "n_rows long, n_cols int, tier_name string, n_classes int, minority_ratio double, is_imbalanced boolean, "
        "missing_pct double, " + ", ".join(f"{k} string" for k in columns)
    )
    return df.sparkSession.createDataFrame([tuple(row)], schema)

