"""Feature, encoding, balancing and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewell.catalog.common import SCORED, Catalog, rounded, scored_events, table
from scorewell.catalog.profiles import hash_sql
from scorewell.functions.bands import class_label, score_percent
from scorewell.operators import balance, encode, features, neighbours, scoring
from scorewell.plans.flagship import cheapest_threshold_report

catalog = Catalog()


def transactions(events, *more):
    """Events as transactions: the time in seconds and ten times the value as the amount."""
    seconds = features.epoch_seconds(F.col("ts"))
    return events.select("event_id", seconds.alias("Time"), (F.col("value") * 10).alias("Amount"), *more)


SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
HOUR = f"(({SECONDS} % 86400) / 3600.0::DOUBLE)"


@catalog.add(
    "engineer_features",
    f"""WITH s AS (SELECT avg(value * 10) AS m, stddev_samp(value * 10) AS sd FROM events)
SELECT event_id, {SECONDS} AS "Time", round(value * 10, 6) AS "Amount", round({HOUR}, 6) AS "Hour",
  CAST({HOUR} < 6 OR {HOUR} > 22 AS INTEGER) AS "Night_txn", round(ln(1 + value * 10), 6) AS "Amount_log",
  round((value * 10 - m) / sd, 6) AS "Amount_zscore", CAST(value * 10 > 1000 AS INTEGER) AS "High_amount" FROM events, s""",
)
def engineer_features(spark, sf_dir):
    return rounded(features.engineer_features(transactions(table(spark, sf_dir, "events"))))


@catalog.add("hour_of_day", f'SELECT event_id, round({HOUR}, 6) AS "hour" FROM events')
def hour_of_day(spark, sf_dir):
    t = transactions(table(spark, sf_dir, "events"))
    return rounded(t.select("event_id", features.hour_of_day(F.col("Time")).alias("hour")))


@catalog.add("night_flag", f"SELECT event_id, CAST({HOUR} < 6 OR {HOUR} > 22 AS INTEGER) AS night FROM events")
def night_flag(spark, sf_dir):
    t = transactions(table(spark, sf_dir, "events"))
    return t.select("event_id", features.night_flag(features.hour_of_day(F.col("Time"))).alias("night"))


@catalog.add("amount_log", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS amount_log FROM lineitem")
def amount_log(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return rounded(items.select("l_orderkey", "l_linenumber", F.log1p("l_extendedprice").alias("amount_log")))


@catalog.add(
    "amount_zscore",
    "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events) "
    "SELECT event_id, round((value - m) / (sd + 1e-8), 6) AS z FROM events, s",
)
def amount_zscore(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    scale = features.fit_amount_scale(e, "value", features.SCORING_EPSILON)
    return rounded(e.select("event_id", scale.zscore(F.col("value")).alias("z")))


@catalog.add("high_amount", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice > 1000 AS INTEGER) AS high FROM lineitem")
def high_amount(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", features.high_amount(F.col("l_extendedprice")).alias("high"))


@catalog.add(
    "encode_target",
    "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS is_f, "
    "CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS sorted_label FROM orders",
)
def encode_target(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    one = encode.encode_target(orders, "o_orderstatus", "F", "is_f")
    return encode.encode_target(one, "o_orderstatus", None, "sorted_label").drop("o_orderstatus")


def holey_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select("event_id", F.when(kind != "error", F.col("value")).alias("value"), F.when(kind != "view", kind).alias("kind"))


HOLEY = """h AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value,
  CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM events)"""
MEDIAN = "(SELECT quantile_cont(value, 0.5) FROM h)"
MODE = "(SELECT kind FROM h WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)"


@catalog.add("impute_median", f"WITH {HOLEY} SELECT event_id, round(coalesce(value, {MEDIAN}), 6) AS value FROM h")
def impute_median(spark, sf_dir):
    h = holey_events(spark, sf_dir).select("event_id", "value")
    return rounded(encode.fit_medians(h, ["value"]).apply(h))


@catalog.add("impute_most_frequent", f"WITH {HOLEY} SELECT event_id, coalesce(kind, {MODE}) AS kind FROM h")
def impute_most_frequent(spark, sf_dir):
    h = holey_events(spark, sf_dir).select("event_id", "kind")
    return encode.fit_most_frequent(h, ["kind"]).apply(h)


@catalog.add(
    "standard_scale",
    "WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp "
    "FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity, "
    "round((l_extendedprice - mp) / sp, 6) AS l_extendedprice FROM lineitem, s",
)
def standard_scale(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(encode.fit_standard_scale(items, ["l_quantity", "l_extendedprice"]).apply(items))


LANGS = ["de", "en", "es", "fr"]


@catalog.add(
    "one_hot",
    "SELECT doc_id, " + ", ".join(f"CAST(lang = '{x}' AS INTEGER) AS \"lang={x}\"" for x in LANGS) + " FROM documents",
)
def one_hot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    flags = encode.one_hot(docs, ["lang"])
    known = {x for x in flags.columns}
    return flags.select("doc_id", *[F.col(f"`lang={x}`") if f"lang={x}" in known else F.lit(0).alias(f"lang={x}") for x in LANGS])


@catalog.add(
    "one_hot_pooled",
    """WITH v AS (SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT value, row_number() OVER (ORDER BY n DESC, value DESC) AS k FROM v),
x AS (SELECT p_partkey, k FROM part JOIN r ON r.value = CAST(p_size AS VARCHAR))
SELECT p_partkey, CAST(k <= 19 AS INTEGER) AS kept, CAST(k > 19 AS INTEGER) AS pooled FROM x""",
)
def one_hot_pooled(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    fitted = encode.fit_one_hot(part, ["p_size"], max_categories=20)
    flags = fitted.apply(part)
    kept = [F.col(f"`{x}`") for x in fitted.names("p_size")[:-1]]
    return flags.select("p_partkey", sum(kept[1:], kept[0]).alias("kept"), F.col(f"`p_size={encode.POOLED}`").alias("pooled"))


@catalog.add(
    "class_weights",
    "WITH k AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1) "
    "SELECT label AS class, n, round((SELECT sum(n) FROM k) / ((SELECT count(*) FROM k) * n), 6) AS weight FROM k",
)
def class_weights(spark, sf_dir):
    return rounded(balance.class_weights(table(spark, sf_dir, "embeddings"), "label"))


@catalog.add(
    "scale_pos_weight",
    "SELECT round(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN label = 1 THEN 1 ELSE 0 END), 6) AS scale_pos_weight "
    f"FROM (WITH {SCORED} SELECT * FROM scored)",
)
def scale_pos_weight(spark, sf_dir):
    return rounded(balance.scale_pos_weight(scored_events(spark, sf_dir), "label"))


DIMS = 64
SMOTE = f"""WITH e AS (SELECT vec_id AS key, embedding::DOUBLE[] AS vec, CAST(label = 0 AS INTEGER) AS label FROM embeddings),
m AS (SELECT key, vec, row_number() OVER (ORDER BY {hash_sql('key')}) AS pos, count(*) OVER () AS n FROM e WHERE label = 1),
need AS (SELECT (SELECT count(*) FROM e) - 2 * (SELECT count(*) FROM m) AS needed),
nn AS (SELECT a.key, b.key AS nb, row_number() OVER (PARTITION BY a.key ORDER BY list_distance(a.vec, b.vec), b.key) AS rank
  FROM m a JOIN m b ON a.key <> b.key),
base AS (SELECT key, vec, unnest(range(0, needed // n + CASE WHEN pos <= needed % n THEN 1 ELSE 0 END)) AS copy FROM m, need),
draw AS (SELECT key, vec, copy, 1 + {hash_sql("key || '|' || copy", 43)} % 5 AS rank,
  {hash_sql("key || '|' || copy", 44)}::DOUBLE / 1152921504606846976.0::DOUBLE AS u FROM base),
made AS (SELECT list_transform(range(1, {DIMS + 1}), lambda i: round(d.vec[i] + u * (t.vec[i] - d.vec[i]), 6)) AS vec FROM draw d
  JOIN nn ON nn.key = d.key AND nn.rank = d.rank JOIN m t ON t.key = nn.nb),
every AS (SELECT key AS vec_id, label, list_transform(vec, lambda x: round(x, 6)) AS vec, false AS synthetic FROM e
  UNION ALL SELECT NULL, 1, vec, true FROM made)
SELECT vec_id, label, synthetic, {', '.join(f'vec[{i + 1}] AS e{i}' for i in range(DIMS))} FROM every"""


def minority_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cols = [f"double(embedding[{i}]) AS e{i}" for i in range(DIMS)]
    return e.selectExpr("vec_id", "int(label = 0) AS label", *cols)


@catalog.add("smote", SMOTE)
def smote(spark, sf_dir):
    made = balance.smote(minority_embeddings(spark, sf_dir), "vec_id", "label", [f"e{i}" for i in range(DIMS)])
    return made.selectExpr("vec_id", "label", "synthetic", *[f"round(e{i}, 6) AS e{i}" for i in range(DIMS)])


NEAREST = """WITH p AS (SELECT p_partkey AS key, [p_size, p_retailprice / 25, length(p_name)]::DOUBLE[] AS vec FROM part),
d AS (SELECT a.key, b.key AS neighbour, row_number() OVER (PARTITION BY a.key ORDER BY
  (a.vec[1] - b.vec[1]) ** 2 + (a.vec[2] - b.vec[2]) ** 2 + (a.vec[3] - b.vec[3]) ** 2, b.key) AS rank FROM p a JOIN p b ON a.key <> b.key)
SELECT key, rank, neighbour FROM d WHERE rank <= 5"""


@catalog.add("nearest_neighbours", NEAREST)
def nearest_neighbours(spark, sf_dir):
    """The five parts most like each part in size, price and length of name."""
    vec = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 25, F.length("p_name").cast("double"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), vec.alias("vec"))
    return neighbours.nearest_neighbours(parts, "key", "vec", 5, cell_rows=128)


T = 0.3


@catalog.add(
    "risk_band_relative",
    f"WITH {SCORED} SELECT event_id, CASE WHEN score < 0.25::DOUBLE * {T}::DOUBLE THEN 'Low' WHEN score < 0.75::DOUBLE * {T}::DOUBLE THEN 'Medium' ELSE 'High' END "
    "AS risk_level FROM scored",
)
def risk_band_relative(spark, sf_dir):
    scored = scored_events(spark, sf_dir, "event_id")
    return scoring.add_risk_band(scored, "relative", T).select("event_id", "risk_level")


@catalog.add(
    "risk_band_fixed",
    f"WITH {SCORED} SELECT event_id, CASE WHEN score < 0 OR score > 1 THEN 'nan' WHEN score <= 0.2 THEN 'Low' WHEN score <= 0.5 THEN 'Medium' "
    "WHEN score <= 0.8 THEN 'High' ELSE 'Critical' END AS risk_level FROM scored",
)
def risk_band_fixed(spark, sf_dir):
    return scoring.add_risk_band(scored_events(spark, sf_dir, "event_id"), "fixed").select("event_id", "risk_level")


@catalog.add(
    "risk_band_local",
    f"WITH {SCORED} SELECT event_id, CASE WHEN score > 0.7 THEN 'HIGH' WHEN score > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM scored",
)
def risk_band_local(spark, sf_dir):
    return scoring.add_risk_band(scored_events(spark, sf_dir, "event_id"), "local").select("event_id", "risk_level")


@catalog.add(
    "score_format",
    f"WITH {SCORED} SELECT event_id, round(score * 100, 4) AS score_percent, CASE WHEN score >= {T} THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label_text, "
    f"CASE WHEN score >= {T} THEN 'Fraud' ELSE 'Legitimate' END AS fraud_text FROM scored",
)
def score_format(spark, sf_dir):
    decided = scoring.decide(scored_events(spark, sf_dir, "event_id"), T)
    return decided.select(
        "event_id",
        score_percent(F.col("score"), 4).alias("score_percent"),
        class_label(F.col("prediction"), "universal").alias("label_text"),
        class_label(F.col("prediction"), "fraud").alias("fraud_text"),
    )


BATCH = f"""count(*) AS total, CAST(sum(CASE WHEN score >= {T} THEN 1 ELSE 0 END) AS BIGINT) AS positives,
  round(100.0 * sum(CASE WHEN score >= {T} THEN 1 ELSE 0 END) / count(*), 6) AS positive_rate_pct,
  CAST(10000 * sum(CASE WHEN score >= {T} THEN 1 ELSE 0 END) AS DOUBLE) AS estimated_risk, round(stddev_pop(score), 6) AS score_std,
  stddev_pop(score) < 0.01 AS degenerate"""


@catalog.add("batch_summary", f"WITH {SCORED} SELECT {BATCH} FROM scored")
def batch_summary(spark, sf_dir):
    return rounded(scoring.batch_summary(scoring.decide(scored_events(spark, sf_dir), T)))


@catalog.add(
    "degenerate_scores",
    f"WITH {SCORED}, flat AS (SELECT 0.5 + score / 1000 AS score FROM scored) SELECT {BATCH} FROM flat",
)
def degenerate_scores(spark, sf_dir):
    flat = scored_events(spark, sf_dir).withColumn("score", 0.5 + F.col("score") / 1000)
    return rounded(scoring.batch_summary(scoring.decide(flat, T)))


@catalog.add(
    "top_risky",
    f"WITH {SCORED} SELECT event_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, event_id LIMIT 100",
)
def top_risky(spark, sf_dir):
    return rounded(scoring.top_risky(scored_events(spark, sf_dir, "event_id"), ["event_id"]).select("event_id", "score"))


@catalog.add(
    "cheapest_threshold_report",
    f"""WITH {SCORED}, grid AS (SELECT score AS threshold FROM scored UNION SELECT 0.0 UNION SELECT 1.0),
ties AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
cum AS (SELECT threshold, sum(coalesce(pos, 0)) OVER (ORDER BY threshold DESC) AS tp, sum(coalesce(neg, 0)) OVER (ORDER BY threshold DESC) AS fp,
  sum(pos) OVER () AS p FROM grid LEFT JOIN ties ON score = threshold),
best AS (SELECT threshold AS t FROM cum ORDER BY (p - tp) * 10000 + fp * 200, threshold LIMIT 1)
SELECT CASE WHEN score < 0.25::DOUBLE * t THEN 'Low' WHEN score < 0.75::DOUBLE * t THEN 'Medium' ELSE 'High' END AS risk_level, count(*) AS total,
  CAST(sum(CASE WHEN score >= t THEN 1 ELSE 0 END) AS BIGINT) AS flagged, CAST(sum(label) AS BIGINT) AS positives,
  round(avg(score), 6) AS avg_score, round(min(t), 6) AS threshold FROM scored, best GROUP BY 1""",
)
def cheapest_report(spark, sf_dir):
    return rounded(cheapest_threshold_report(scored_events(spark, sf_dir)))
