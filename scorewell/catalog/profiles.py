"""Source, sampling and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewell.catalog.common import Catalog, rounded, table
from scorewell.operators import quality, sampling, stats
from scorewell.session import fresh_path
from scorewell.sources import tables

catalog = Catalog()


def hash_sql(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5({key} || '|{seed}'), 1, 15))::BIGINT"


@catalog.add(
    "load_table",
    "SELECT r_name, count(*) AS nations, min(n_name) AS first_nation FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
def load_table(spark, sf_dir):
    nation = tables.load_table(spark, f"{sf_dir}/nation.parquet")
    region = tables.load_table(spark, f"{sf_dir}/region.parquet")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("nations"), F.min("n_name").alias("first_nation"))


@catalog.add("load_csv_latin1", "SELECT doc_id, lang, source, n_chars FROM documents")
def load_csv_latin1(spark, sf_dir):
    """Document facts written as CSV in one encoding and read back in it."""
    path = fresh_path(spark, "documents-csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    docs.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tables.load_csv(spark, path, "latin-1", schema="doc_id long, lang string, source string, n_chars long")


@catalog.add("write_predictions", "SELECT event_id, event_type, value, round(value / 500, 6) AS score FROM events")
def write_predictions(spark, sf_dir):
    path = fresh_path(spark, "scored-csv")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", (F.col("value") / 500).alias("score"))
    tables.write_predictions(e, path)
    return rounded(tables.load_table(spark, path, "event_id long, event_type string, value double, score double", fmt="csv"))


@catalog.add(
    "dataset_metadata",
    "SELECT count(*) AS n_rows, 6 AS n_columns, 'p_partkey,p_size,p_retailprice' AS numeric_columns, "
    "'p_name,p_brand,p_type' AS categorical_columns FROM part",
)
def dataset_metadata(spark, sf_dir):
    return quality.dataset_metadata(table(spark, sf_dir, "part"))


@catalog.add(
    "split_features_target",
    "SELECT count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS n, round(min(n) / sum(n), 6) AS minority_ratio, "
    "count(*) = 2 AND min(n) / sum(n) < 0.1 AS high_imbalance FROM (SELECT o_orderstatus, count(*) AS n FROM orders "
    "WHERE o_orderstatus IS NOT NULL GROUP BY 1)",
)
def split_features_target(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    tables.split_features_target(orders, "o_orderstatus")
    return rounded(quality.target_balance(orders, "o_orderstatus"))


SHARE = "SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS total FROM events GROUP BY 1"


@catalog.add(
    "stratified_sample",
    f"""WITH q AS (SELECT event_type, greatest(1, CAST(floor(2000 * n / total) AS BIGINT)) AS quota, n, total FROM ({SHARE})),
r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY {hash_sql('event_id')}) AS k FROM events)
SELECT event_id, event_type, value FROM r JOIN q USING (event_type) WHERE total <= 2000 OR k <= quota""",
)
def stratified_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return sampling.stratified_sample(e, 2_000, ["event_id"], "event_type")


@catalog.add(
    "uniform_sample",
    f"SELECT event_id, value FROM events ORDER BY {hash_sql('event_id')} LIMIT 3000",
)
def uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(table(spark, sf_dir, "events").select("event_id", "value"), 3_000, ["event_id"])


RANKED = f"""r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {hash_sql('event_id')}) AS k,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)"""


@catalog.add(
    "stratified_split",
    f"""WITH {RANKED} SELECT event_id, event_type, CASE WHEN k <= floor(n * 0.15 + 0.5) THEN 'val'
  WHEN k <= floor(n * 0.3 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def stratified_split(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.mark_split(e, ["event_id"], "event_type", {"val": 0.15, "test": 0.15})


@catalog.add(
    "stratified_folds",
    f"WITH {RANKED} SELECT event_id, event_type, CAST((k > n * 1 // 5)::INT + (k > n * 2 // 5)::INT + (k > n * 3 // 5)::INT "
    "+ (k > n * 4 // 5)::INT AS INTEGER) AS fold FROM r",
)
def stratified_folds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_folds(e, ["event_id"], "event_type", 5)


STRING_RULE = """CASE WHEN d / n > 0.5 AND d > 100 THEN 'id' WHEN len > 50 AND d > 50 THEN 'text' ELSE 'cat' END"""


def role_sql(table_name: str, ids: str, dates: str, strings: str, ints: str, floats: str) -> str:
    """Roles by rule: names settle ids and dates, counts settle the rest."""
    parts = [f"SELECT '{x}' AS \"column\", 'id' AS role" for x in ids.split()]
    parts += [f"SELECT '{x}', 'date'" for x in dates.split()]
    parts += [f"SELECT '{x}', 'numeric'" for x in floats.split()]
    parts += [
        f"SELECT '{x}', {STRING_RULE} FROM (SELECT count(DISTINCT {x}) AS d, avg(length({x})) AS len, count(*) AS n FROM {table_name})"
        for x in strings.split()
    ]
    parts += [
        f"SELECT '{x}', CASE WHEN d > least(0.9 * n, 10000) THEN 'id' WHEN d <= 10 THEN 'cat' ELSE 'numeric' END "
        f"FROM (SELECT count(DISTINCT {x}) AS d, count(*) AS n FROM {table_name})"
        for x in ints.split()
    ]
    return f"SELECT \"column\", role, role IN ('numeric', 'cat') AS is_feature FROM ({' UNION ALL '.join(parts)})"


@catalog.add(
    "column_roles_lineitem",
    role_sql("lineitem", "l_orderkey l_partkey l_suppkey", "l_shipdate", "l_returnflag l_linestatus", "l_linenumber",
             "l_quantity l_extendedprice l_discount l_tax"),
)
def column_roles_lineitem(spark, sf_dir):
    return quality.detect_column_roles(table(spark, sf_dir, "lineitem"), id_ints=quality.ID_INT_UNIQUE)


@catalog.add(
    "column_roles_documents",
    role_sql("documents", "doc_id", "", "text lang source", "n_chars", ""),
)
def column_roles_documents(spark, sf_dir):
    return quality.detect_column_roles(table(spark, sf_dir, "documents"), id_ints=quality.ID_INT_UNIQUE)


@catalog.add(
    "column_roles_orders",
    role_sql("orders", "o_orderkey o_custkey", "o_orderdate", "o_orderpriority", "", "o_totalprice"),
)
def column_roles_orders(spark, sf_dir):
    return quality.detect_column_roles(table(spark, sf_dir, "orders"), "o_orderstatus", id_ints=quality.ID_INT_UNIQUE)


def holey_items(spark, sf_dir):
    """Line items with some discounts missing."""
    items = table(spark, sf_dir, "lineitem")
    return items.withColumn("l_discount", F.when(F.col("l_returnflag") != "N", F.col("l_discount")))


HOLEY = "holey AS (SELECT * REPLACE (CASE WHEN l_returnflag <> 'N' THEN l_discount END AS l_discount) FROM lineitem)"
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def profile_sql(x: str) -> str:
    return (
        f"SELECT '{x}' AS \"column\", count(*) - count({x}) AS missing, round(100 * (count(*) - count({x})) / count(*), 6) AS missing_pct, "
        f"round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, round(max({x}), 6) AS max, "
        f"round(quantile_cont({x}, 0.5), 6) AS median, round(skewness({x}), 6) AS skew FROM holey"
    )


@catalog.add("numeric_profile", f"WITH {HOLEY} " + " UNION ALL ".join(profile_sql(x) for x in NUMBERS))
def numeric_profile(spark, sf_dir):
    return rounded(quality.numeric_profile(holey_items(spark, sf_dir), NUMBERS))


CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]
CAT_COUNTS = " UNION ALL ".join(f"SELECT '{x}' AS feature, CAST({x} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY {x}" for x in CATS)


@catalog.add(
    "categorical_profile",
    f"WITH v AS ({CAT_COUNTS}) SELECT feature AS \"column\", n_unique, CAST(rank AS INTEGER) AS rank, value, n FROM (SELECT *, "
    "row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY feature) AS n_unique "
    "FROM v WHERE value IS NOT NULL) WHERE rank <= 5",
)
def categorical_profile(spark, sf_dir):
    return quality.categorical_profile(table(spark, sf_dir, "lineitem"), CATS)


def labelled_documents(spark, sf_dir):
    """Documents with their quality label; unlabelled ones have a missing target."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality")


@catalog.add(
    "class_distribution",
    "WITH l AS (SELECT quality FROM documents LEFT JOIN labels USING (doc_id)), k AS (SELECT quality, count(*) AS n FROM l "
    "WHERE quality IS NOT NULL GROUP BY quality), t AS (SELECT count(*) AS n_all FROM l) "
    "SELECT CAST(quality AS VARCHAR) AS value, n, round(100 * n / n_all, 6) AS pct, "
    "round((SELECT min(n) FROM k) / n_all, 6) AS minority_ratio, (SELECT min(n) FROM k) / n_all < 0.2 AS is_imbalanced, "
    "(SELECT count(*) FROM k) AS n_classes FROM k, t",
)
def class_distribution(spark, sf_dir):
    return rounded(quality.class_distribution(labelled_documents(spark, sf_dir), "quality"))


@catalog.add(
    "missing_summary",
    "WITH l AS (SELECT doc_id, lang, source, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)) "
    "SELECT count(*) - count(quality) AS missing_cells, round(100 * (count(*) - count(quality)) / (5 * count(*)), 6) AS missing_pct, "
    "'quality' AS missing_cols FROM l",
)
def missing_summary(spark, sf_dir):
    return rounded(quality.missing_summary(labelled_documents(spark, sf_dir)))


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@catalog.add(
    "correlation_matrix",
    f"WITH {HOLEY} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM holey" for a, b in PAIRS),
)
def correlation_matrix(spark, sf_dir):
    return rounded(stats.correlation_pairs(holey_items(spark, sf_dir), NUMBERS))


NETTED = ["l_extendedprice", "net", "gross", "l_quantity"]


@catalog.add(
    "high_corr_pairs",
    "WITH x AS (SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS gross, l_quantity "
    "FROM lineitem), p AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS abs_corr FROM x"
        for i, a in enumerate(NETTED)
        for b in NETTED[i + 1 :]
    )
    + ") SELECT a, b, round(abs_corr, 6) AS abs_corr FROM p WHERE abs_corr > 0.95 ORDER BY abs_corr DESC, a, b LIMIT 5",
)
def high_corr_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    x = items.select(
        "l_extendedprice", (price * (1 - F.col("l_discount"))).alias("net"), (price * (1 + F.col("l_tax"))).alias("gross"), "l_quantity"
    )
    return rounded(quality.high_corr_pairs(x, NETTED))


@catalog.add(
    "histogram",
    """WITH b AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30 AS w FROM events),
h AS (SELECT least(30, CAST(floor((value - lo) / w) AS INTEGER) + 1) AS bin, count(*) AS n FROM events, b GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + (g.bin - 1) * w, 6) AS lo, round(lo + g.bin * w, 6) AS hi, coalesce(n, 0) AS n
FROM (SELECT unnest(range(1, 31)) AS bin) g CROSS JOIN b LEFT JOIN h ON h.bin = g.bin""",
)
def histogram(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "events"), "value", 30))


TIER_SQL = """CASE WHEN n < 1000 THEN 0 WHEN n < 50000 THEN 1 WHEN n < 200000 THEN 2 WHEN n < 500000 THEN 3 WHEN n < 2000000 THEN 4 ELSE 5 END"""


@catalog.add(
    "size_tier",
    f"SELECT 'lineitem' AS name_of_table, n AS n_rows, {TIER_SQL} AS tier FROM (SELECT count(*) AS n FROM lineitem) "
    f"UNION ALL SELECT 'events', n, {TIER_SQL} FROM (SELECT count(*) AS n FROM events) "
    f"UNION ALL SELECT 'labels', n, {TIER_SQL} FROM (SELECT count(*) AS n FROM labels)",
)
def size_tier(spark, sf_dir):
    parts = [
        quality.size_tier(table(spark, sf_dir, name)).select(F.lit(name).alias("name_of_table"), "n_rows", "tier")
        for name in ("lineitem", "events", "labels")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@catalog.add(
    "dataset_profile",
    """WITH l AS (SELECT d.doc_id, lang, source, n_chars, quality FROM documents d JOIN labels USING (doc_id)),
k AS (SELECT quality, count(*) AS n FROM l GROUP BY 1)
SELECT count(*) AS n_rows, 4 AS n_cols, CASE WHEN count(*) < 1000 THEN 'TINY' WHEN count(*) < 50000 THEN 'SMALL' ELSE 'MEDIUM' END AS tier_name,
  CAST((SELECT count(*) FROM k) AS INTEGER) AS n_classes, round((SELECT min(n) FROM k) / count(*), 6) AS minority_ratio,
  (SELECT min(n) FROM k) / count(*) < 0.2 AS is_imbalanced, 0.0::DOUBLE AS missing_pct,
  CASE WHEN count(DISTINCT n_chars) > least(0.9 * count(*), 10000) THEN '' ELSE 'n_chars' END AS numeric_cols,
  'lang,source' AS categorical_cols,
  CASE WHEN count(DISTINCT n_chars) > least(0.9 * count(*), 10000) THEN 'doc_id,n_chars' ELSE 'doc_id' END AS id_cols,
  '' AS date_cols, '' AS text_cols, '' AS missing_cols FROM l""",
)
def dataset_profile(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", "lang", "source", "n_chars", "quality")
    return rounded(quality.profile_frame(joined, "quality"))
