"""Cleaning queries. Dirty columns are derived from events the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewell.catalog.common import Catalog, rounded, table
from scorewell.operators import cleaning, quality, stats

catalog = Catalog()

NUMBER_SQL = r"try_cast(regexp_replace(amount, '[$,€£¥%\s]', '', 'g') AS DOUBLE)"


def dirty_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    return e.select(
        "event_id",
        F.when(kind != "error", value).alias("holey"),
        F.when((value < 8) & (kind == "view"), value).alias("sparse"),
        F.lit("same").alias("fixed"),
        F.when(kind == "click", "Yes").when(kind == "view", "no").when(kind == "error", "Y").alias("flag"),
        F.concat(F.lit("$ "), value.cast("decimal(10,2)").cast("string"), F.when(kind == "signup", " %").otherwise("")).alias("amount"),
        F.concat(F.lit("  "), kind, F.lit("\t")).alias("padded"),
        F.when(kind != "signup", kind).alias("kind"),
        (value > 60).cast("int").alias("target"),
    )


DIRTY = """dirty AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS holey,
  CASE WHEN value < 8 AND event_type = 'view' THEN value END AS sparse, 'same' AS fixed,
  CASE event_type WHEN 'click' THEN 'Yes' WHEN 'view' THEN 'no' WHEN 'error' THEN 'Y' END AS flag,
  '$ ' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) || CASE WHEN event_type = 'signup' THEN ' %' ELSE '' END AS amount,
  '  ' || event_type || chr(9) AS padded, CASE WHEN event_type <> 'signup' THEN event_type END AS kind,
  CAST(value > 60 AS INTEGER) AS target FROM events)"""


@catalog.add(
    "strip_column_names",
    "SELECT c_custkey AS custkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer",
)
def strip_column_names(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return cleaning.strip_column_names(
        customer.select(
            F.col("c_custkey").alias(" custkey"), F.col("c_acctbal").alias("acctbal "), F.col("c_mktsegment").alias(" mktsegment ")
        )
    )


REPEATED = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@catalog.add("drop_duplicates", f"SELECT DISTINCT {', '.join(REPEATED)} FROM lineitem")
def drop_duplicates(spark, sf_dir):
    return cleaning.drop_duplicates(table(spark, sf_dir, "lineitem").select(*REPEATED))


TWICE = "SELECT *, NULL::INTEGER AS l_note FROM lineitem"


@catalog.add("drop_duplicates_wide", f"SELECT DISTINCT * FROM ({TWICE} UNION ALL SELECT * FROM ({TWICE}) WHERE l_quantity = 7)")
def drop_duplicates_wide(spark, sf_dir):
    """Whole rows of line items, a fiftieth of which is there twice."""
    items = table(spark, sf_dir, "lineitem").withColumn("l_note", F.lit(None).cast("int"))
    return cleaning.drop_duplicates(items.union(items.where("l_quantity = 7")))


@catalog.add(
    "duplicates_removed",
    f"SELECT (SELECT count(*) FROM lineitem) AS rows_before, (SELECT count(*) FROM lineitem) - count(*) AS duplicates, "
    f"count(*) AS rows_after FROM (SELECT DISTINCT {', '.join(REPEATED)} FROM lineitem)",
)
def duplicates_removed(spark, sf_dir):
    return cleaning.duplicates_removed(table(spark, sf_dir, "lineitem").select(*REPEATED))


DIRTY_COLS = "event_id holey sparse fixed flag amount padded kind target".split()


@catalog.add(
    "missing_counts",
    f"WITH {DIRTY} "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", count(*) - count({x}) AS missing, "
        f"round((count(*) - count({x})) / count(*), 6) AS rate FROM dirty"
        for x in DIRTY_COLS
    ),
)
def missing_counts(spark, sf_dir):
    return rounded(stats.missing_counts(dirty_events(spark, sf_dir)))


@catalog.add("drop_high_missing", f"WITH {DIRTY} SELECT * EXCLUDE (sparse) FROM dirty")
def drop_high_missing(spark, sf_dir):
    return cleaning.drop_high_missing(dirty_events(spark, sf_dir), target="target")


@catalog.add("drop_constant", f"WITH {DIRTY} SELECT * EXCLUDE (fixed) FROM dirty")
def drop_constant(spark, sf_dir):
    return cleaning.drop_constant(dirty_events(spark, sf_dir), target="target")


FLAG_SQL = """CASE WHEN lower(flag) IN ('yes','true','y','t','1','1.0') THEN 1
  WHEN lower(flag) IN ('no','false','n','f','0','0.0') THEN 0 END"""


@catalog.add("coerce_boolean", f"WITH {DIRTY} SELECT * REPLACE ({FLAG_SQL} AS flag) FROM dirty")
def coerce_boolean(spark, sf_dir):
    return cleaning.coerce_boolean(dirty_events(spark, sf_dir), target="target")


@catalog.add("coerce_numeric_string", f"WITH {DIRTY} SELECT * REPLACE ({NUMBER_SQL} AS amount) FROM dirty")
def coerce_numeric_string(spark, sf_dir):
    return cleaning.coerce_numeric_strings(dirty_events(spark, sf_dir), target="target")


STRIP_SQL = r"regexp_replace({0}, '^\s+|\s+$', '', 'g') AS {0}"


@catalog.add(
    "strip_whitespace",
    f"WITH {DIRTY} SELECT * REPLACE ({', '.join(STRIP_SQL.format(x) for x in 'fixed flag amount padded kind'.split())}) FROM dirty",
)
def strip_whitespace(spark, sf_dir):
    return cleaning.strip_whitespace(dirty_events(spark, sf_dir), target="target")


def clip(col: str, low: str, high: str) -> str:
    return f"CASE WHEN {col} < {low} THEN {low} WHEN {col} > {high} THEN {high} ELSE CAST({col} AS DOUBLE) END"


PART_IQR = """b AS (SELECT quantile_cont(p_retailprice, 0.25) AS a1, quantile_cont(p_retailprice, 0.75) AS a3,
  quantile_cont(p_size, 0.25) AS s1, quantile_cont(p_size, 0.75) AS s3 FROM part)"""
EVENT_IQR = "b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"


@catalog.add(
    "cap_outliers_iqr",
    f"WITH {EVENT_IQR} SELECT event_id, round({clip('value', 'q1 - 3 * (q3 - q1)', 'q3 + 3 * (q3 - q1)')}, 6) AS value "
    "FROM events, b",
)
def cap_outliers_iqr(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return rounded(cleaning.cap_outliers(e, "iqr", 3.0, ["value"]))


@catalog.add(
    "cap_outliers_zscore",
    "WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) "
    f"SELECT event_id, round({clip('value', 'm - 3 * s', 'm + 3 * s')}, 6) AS value FROM events, b",
)
def cap_outliers_zscore(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return rounded(cleaning.cap_outliers(e, "zscore", 3.0, ["value"]))


def fence_count(table_name: str, col: str) -> str:
    return (
        f"SELECT '{col}' AS \"column\", (SELECT count(*) FROM {table_name}, (SELECT quantile_cont({col}, 0.25) AS q1, "
        f"quantile_cont({col}, 0.75) AS q3 FROM {table_name}) WHERE {col} < q1 - 1.5 * (q3 - q1) OR {col} > q3 + 1.5 * (q3 - q1)) AS outliers"
    )


ITEM_NUMBERS = "l_linenumber l_quantity l_extendedprice l_discount l_tax".split()


@catalog.add("count_outliers_iqr", " UNION ALL ".join(fence_count("lineitem", x) for x in ITEM_NUMBERS))
def count_outliers_iqr(spark, sf_dir):
    return cleaning.count_outliers_iqr(table(spark, sf_dir, "lineitem").select(*ITEM_NUMBERS))


MODE_SQL = "(SELECT {0} FROM dirty WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"


@catalog.add(
    "impute_mean_mode",
    f"WITH {DIRTY} SELECT event_id, round(coalesce(holey, (SELECT avg(holey) FROM dirty)), 6) AS holey, "
    f"coalesce(flag, {MODE_SQL.format('flag')}) AS flag, coalesce(kind, {MODE_SQL.format('kind')}) AS kind FROM dirty",
)
def impute_mean_mode(spark, sf_dir):
    return rounded(cleaning.impute_mean_mode(dirty_events(spark, sf_dir).select("event_id", "holey", "flag", "kind")))


@catalog.add(
    "clean_basic",
    f"WITH {DIRTY}, u AS (SELECT DISTINCT holey, flag, kind FROM dirty) "
    "SELECT round(coalesce(holey, (SELECT avg(holey) FROM u)), 6) AS holey, "
    f"coalesce(flag, {MODE_SQL.format('flag').replace('dirty', 'u')}) AS flag, "
    f"coalesce(kind, {MODE_SQL.format('kind').replace('dirty', 'u')}) AS kind FROM u",
)
def clean_basic(spark, sf_dir):
    return rounded(cleaning.clean_basic(dirty_events(spark, sf_dir).select("holey", "flag", "kind")))


SMART = f"""{DIRTY}, u AS (SELECT DISTINCT * FROM dirty),
typed AS (SELECT event_id, holey, {FLAG_SQL} AS flag, {NUMBER_SQL} AS amount,
  regexp_replace(padded, '^\\s+|\\s+$', '', 'g') AS padded, regexp_replace(kind, '^\\s+|\\s+$', '', 'g') AS kind, target FROM u),
q AS (SELECT quantile_cont(holey, 0.25) AS h1, quantile_cont(holey, 0.75) AS h3,
  quantile_cont(amount, 0.25) AS a1, quantile_cont(amount, 0.75) AS a3 FROM typed)"""


@catalog.add(
    "clean_smart",
    f"WITH {SMART} SELECT event_id, round({clip('holey', 'h1 - 3 * (h3 - h1)', 'h3 + 3 * (h3 - h1)')}, 6) AS holey, flag, "
    f"round({clip('amount', 'a1 - 3 * (a3 - a1)', 'a3 + 3 * (a3 - a1)')}, 6) AS amount, padded, kind, target FROM typed, q",
)
def clean_smart(spark, sf_dir):
    clean, _ = cleaning.clean_smart(dirty_events(spark, sf_dir), "target")
    return rounded(clean)


@catalog.add(
    "clean_smart_report",
    f"""WITH {SMART}, n AS (SELECT count(*) AS n, count(holey) AS h, count(sparse) AS s, count(flag) AS f, count(amount) AS a,
  count(padded) AS p FROM u)
SELECT step, col AS "column", n FROM (
  SELECT 'rows_before' AS step, NULL AS col, (SELECT count(*) FROM dirty) AS n
  UNION ALL SELECT 'duplicates_removed', NULL, (SELECT count(*) FROM dirty) - n FROM n
  UNION ALL SELECT 'high_missing_dropped', 'sparse', n - s FROM n
  UNION ALL SELECT 'constant_dropped', 'fixed', n FROM n
  UNION ALL SELECT 'boolean_coerced', 'flag', f FROM n
  UNION ALL SELECT 'numeric_string_coerced', 'amount', a FROM n
  UNION ALL SELECT 'whitespace_stripped', 'padded', p FROM n
  UNION ALL SELECT 'outliers_capped', 'holey', (SELECT count(*) FROM typed, q WHERE holey < h1 - 3 * (h3 - h1) OR holey > h3 + 3 * (h3 - h1)) FROM n
  UNION ALL SELECT 'outliers_capped', 'amount', (SELECT count(*) FROM typed, q WHERE amount < a1 - 3 * (a3 - a1) OR amount > a3 + 3 * (a3 - a1)) FROM n
  UNION ALL SELECT 'rows_after', NULL, n FROM n)""",
)
def clean_smart_report(spark, sf_dir):
    dirty = dirty_events(spark, sf_dir)
    _, report = cleaning.clean_smart(dirty, "target")
    return report.to_frame(dirty)


@catalog.add(
    "drop_null_target",
    f"WITH {DIRTY} SELECT event_id, kind FROM dirty WHERE kind IS NOT NULL",
)
def drop_null_target(spark, sf_dir):
    return cleaning.drop_null_target(dirty_events(spark, sf_dir), "kind").select("event_id", "kind")


@catalog.add(
    "align_columns",
    "SELECT l_orderkey, l_linenumber, l_quantity, 0 AS l_weight, l_discount, 0 AS l_height FROM lineitem",
)
def align_columns(spark, sf_dir):
    wanted = ["l_quantity", "l_weight", "l_discount", "l_height"]
    return cleaning.align_columns(table(spark, sf_dir, "lineitem"), wanted, keep=["l_orderkey", "l_linenumber"])


QUALITY_ISSUES = f"""{DIRTY}, n AS (SELECT count(*) AS n FROM dirty), issues AS (
  SELECT 'duplicates' AS type, 'warning' AS severity, NULL AS col, n - d AS cnt FROM n, (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM dirty)) WHERE n > d
  UNION ALL SELECT 'high_missing', CASE WHEN m / n > 0.7 THEN 'error' ELSE 'warning' END, name, m FROM n, (
    {' UNION ALL '.join(f"SELECT '{x}' AS name, count(*) - count({x}) AS m FROM dirty" for x in DIRTY_COLS if x != 'target')}) WHERE m / n > 0.3
  UNION ALL SELECT 'constant_col', 'warning', name, NULL FROM (
    {' UNION ALL '.join(f"SELECT '{x}' AS name, count(DISTINCT {x}) AS d FROM dirty" for x in DIRTY_COLS if x != 'target')}) WHERE d <= 1
  UNION ALL SELECT CASE WHEN d > 2 THEN 'multiclass' ELSE 'single_class' END, 'error', 'target', CASE WHEN d > 2 THEN d END
    FROM (SELECT count(DISTINCT target) AS d FROM dirty) WHERE d > 2 OR d = 1
  UNION ALL SELECT 'high_cardinality', 'warning', name, NULL FROM n, (
    {' UNION ALL '.join(f"SELECT '{x}' AS name, count(DISTINCT {x}) AS d FROM dirty" for x in 'fixed flag amount padded kind'.split())}) WHERE d > 50 AND d / n < 0.5
  UNION ALL SELECT 'numeric_string', 'info', name, NULL FROM (
    {' UNION ALL '.join(f"SELECT '{x}' AS name, count({NUMBER_SQL.replace('amount', x)}) / nullif(count({x}), 0) AS r FROM dirty" for x in 'fixed flag amount padded kind'.split())}) WHERE r >= 0.85)"""


@catalog.add("quality_report", f'WITH {QUALITY_ISSUES} SELECT type, severity, col AS "column", cnt AS count FROM issues')
def quality_report(spark, sf_dir):
    return quality.quality_report(dirty_events(spark, sf_dir), "target").drop("message")


@catalog.add(
    "quality_grade",
    f"""WITH {QUALITY_ISSUES}, g AS (SELECT count(*) FILTER (severity = 'error') AS n_errors,
  count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (severity = 'info') AS n_info FROM issues)
SELECT *, CASE WHEN n_errors > 0 THEN 'poor' WHEN n_warnings > 3 THEN 'fair' WHEN n_warnings > 0 THEN 'good' ELSE 'excellent' END
  AS overall_quality, n_errors > 0 AS has_blockers FROM g""",
)
def quality_grade(spark, sf_dir):
    return quality.quality_grade(quality.quality_report(dirty_events(spark, sf_dir), "target"))
