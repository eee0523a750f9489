"""Model fitting, scoring and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewell.catalog.common import Catalog, rounded, table
from scorewell.catalog.features import transactions
from scorewell.operators import boosting, explain, features, folds
from scorewell.operators.sampling import stratified_split
from scorewell.plans import models
from scorewell.session import fresh_path

catalog = Catalog()

# The candidates that the registered queries fit, with few trees: named here, for the library's own plans take the numbers of
# the product (hundreds of trees, hours on one machine).
QUICK = {"LogisticRegression": 30, "RandomForest": 5, "GBT_Balanced": 5, "GBT_HighRecall": 3, "Newton_HighRecall": 3}
QUICK_AUTO = {"LogisticRegression": 30, "RandomForest": 3, "GBT_Deep": 3, "GBT": 2, "Newton": 2}
COLUMNS = ["Time", "Amount", "Hour", "Night_txn", "Amount_log", "Amount_zscore", "High_amount"]


def labelled(spark, sf_dir):
    """Engineered transactions from all events, positive where the value is large and no error."""
    label = ((F.col("value") > 60) & (F.col("event_type") != "error")).cast("int")
    t = transactions(table(spark, sf_dir, "events"), label.alias("label"))
    return features.engineer_features(t)


def trained(spark, sf_dir, **options):
    train, val = stratified_split(labelled(spark, sf_dir), ["event_id"], "label", 0.2)
    return models.fraud_train(train, val, ["event_id"], COLUMNS, plan=QUICK, **options)


def quick_model(spark, sf_dir, name):
    """One named candidate fitted on all rows, with the F1 threshold left at one half."""
    rows = models.with_weight(labelled(spark, sf_dir), True)
    pre, names = models.build_preprocessor(rows, COLUMNS, [])
    ready = pre.transform(rows)
    estimator = models.candidates({name: QUICK[name]}, weight="weight")[name]
    pipeline = models.PipelineModel([*pre.stages, estimator.fit(ready)])
    return models.TrainedModel(pipeline, 0.5, COLUMNS, names, name), rows


@catalog.add("build_preprocessor", "SELECT doc_id, CAST(4 + 1 AS INTEGER) AS width FROM documents")
def build_preprocessor(spark, sf_dir):
    """The assembled vector of a numeric and a four-valued text column has five places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    pre, _ = models.build_preprocessor(docs, ["n_chars"], ["lang"])
    return pre.transform(docs).select("doc_id", F.size(models.vector_to_array("features")).alias("width"))


FOLD_SQL = """WITH e AS (
  SELECT event_id % 3 AS f, CASE WHEN user_id % 7 <> 0 THEN value END AS value, user_id,
    CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type FROM events),
r AS (SELECT CAST(fold AS INTEGER) AS fold, e.* FROM e, range(3) k(fold) WHERE f <> fold),
middle AS (SELECT fold, median(value) AS v, median(user_id) AS u FROM r GROUP BY fold),
filled AS (SELECT fold, coalesce(value, v) AS v, user_id AS u FROM r JOIN middle USING (fold)),
moved AS (SELECT fold, avg(v) AS mv, stddev_pop(v) AS sv, avg(u) AS mu, stddev_pop(u) AS su FROM filled GROUP BY fold),
kinds AS (SELECT fold, event_type AS t, count(*) AS n FROM r WHERE event_type IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, t DESC) AS k,
  row_number() OVER (PARTITION BY fold ORDER BY n DESC, t) AS top FROM kinds)
SELECT fold, "column", statistic, round(value, 6) AS value, text FROM (
  SELECT fold, 'value' AS "column", 'median' AS statistic, CAST(v AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM middle
  UNION ALL SELECT fold, 'user_id', 'median', CAST(u AS DOUBLE), NULL FROM middle
  UNION ALL SELECT fold, 'value', 'mean', mv, NULL FROM moved UNION ALL SELECT fold, 'value', 'std', sv, NULL FROM moved
  UNION ALL SELECT fold, 'user_id', 'mean', mu, NULL FROM moved UNION ALL SELECT fold, 'user_id', 'std', su, NULL FROM moved
  UNION ALL SELECT fold, 'event_type', 'mode', NULL, t FROM ranked WHERE top = 1
  UNION ALL SELECT fold, 'event_type', 'kept', NULL, '["' || string_agg(t, '", "' ORDER BY t) || '"]' FROM ranked WHERE k <= 2 GROUP BY fold)"""


@catalog.add("fold_statistics", FOLD_SQL)
def fold_statistics(spark, sf_dir):
    """What three folds' preprocessors learn, with missing cells and pooled categories."""
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id % 3 AS fold", "if(user_id % 7 <> 0, value, null) AS value", "user_id", "if(event_id % 11 <> 0, event_type, null) AS event_type"
    )
    found = folds.fold_statistics(events, "fold", range(3), ["value", "user_id"], ["event_type"], max_categories=3)
    return rounded(folds.statistics_frame(spark, found))


@catalog.add("leaderboard")
def leaderboard(spark, sf_dir):
    rows = models.with_weight(labelled(spark, sf_dir), True)
    plan = models.candidates(QUICK, weight="weight")
    scores = models.cross_validate(rows, ["event_id"], COLUMNS, [], plan, 2)
    return models.leaderboard(spark, scores)


STUMPS = boosting.Settings(trees=2, leaves=2, rate=1.0, delta=1.0)


def _stump_sql(k: int) -> str:
    """CTEs of one round over ``rows{k}`` (x array, y, raw): the best split and the rows with their next score."""
    value = "greatest(-1, least(1, -g{0} / (h{0} + 1)))"
    values = ", ".join(f"{value.format(p)} AS v{p}" for p in ("l", "r", "t"))
    worth = " - ".join(["0"] + [f"(g{p} * v{p} + 0.5 * (h{p} + 1) * v{p} * v{p})" for p in ("l", "r")])
    return f"""
grad{k} AS (SELECT x, y, 1 / (1 + exp(-raw)) - y AS g, (1 / (1 + exp(-raw))) * (1 - 1 / (1 + exp(-raw))) AS h FROM rows{k}),
cell{k} AS (SELECT f, x[f + 1] AS v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM grad{k}, range(3) r(f) GROUP BY ALL),
part{k} AS (SELECT f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY f) AS gt,
  sum(h) OVER (PARTITION BY f) AS ht, sum(n) OVER (PARTITION BY f) AS nt FROM cell{k} WINDOW w AS (PARTITION BY f ORDER BY v)),
both{k} AS (SELECT *, gt - gl AS gr, ht - hl AS hr FROM part{k} WHERE nl >= 20 AND nt - nl >= 20),
step{k} AS (SELECT *, {values} FROM both{k}),
best{k} AS (SELECT {k} AS tree, f AS feature, v AS threshold, vl AS left_value, vr AS right_value,
  {worth} + (gt * vt + 0.5 * (ht + 1) * vt * vt) AS gain FROM step{k} ORDER BY gain DESC, f, v LIMIT 1),
rows{k + 1} AS (SELECT x, y, raw + CASE WHEN x[b.feature + 1] <= b.threshold THEN b.left_value ELSE b.right_value END AS raw FROM rows{k}, best{k} b)"""


BOOSTED = f"""WITH rows0 AS (SELECT [floor(value / 20), length(event_type), day(ts)]::DOUBLE[] AS x,
  CAST(value > 60 AND event_type <> 'error' AS INTEGER) AS y, 0::DOUBLE AS raw FROM events),{_stump_sql(0)},{_stump_sql(1)}
SELECT tree, feature::INTEGER AS feature, threshold, round(gain, 6) AS gain, round(left_value, 6) AS left_value, round(right_value, 6) AS right_value
FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1)"""


@catalog.add("boosted_stumps", BOOSTED)
def boosted_stumps(spark, sf_dir):
    """Split, gain and leaf values of the first two trees of two leaves, from gradients and hessians of all events."""
    e = table(spark, sf_dir, "events")
    x = F.array(F.floor(F.col("value") / 20).cast("double"), F.length("event_type").cast("double"), F.dayofmonth("ts").cast("double"))
    label = ((F.col("value") > 60) & (F.col("event_type") != "error")).cast("double")
    trees, cuts = boosting.fit_trees(e.select(x.alias("x"), label.alias("y"), F.lit(1.0).alias("w")), STUMPS)
    rows = []
    for t, tree in enumerate(trees):
        f = int(tree.feature[0])
        left, right = (float(tree.value[i]) for i in (tree.left[0], tree.right[0]))
        rows.append((t, f, float(cuts[f][tree.cut[0]]), round(float(tree.gain[0]), 6), round(left, 6), round(right, 6)))
    return spark.createDataFrame(rows, "tree int, feature int, threshold double, gain double, left_value double, right_value double")


@catalog.add("complexity_probe")
def complexity_probe(spark, sf_dir):
    found = models.complexity_probe(labelled(spark, sf_dir), ["event_id"], COLUMNS, [])
    return spark.createDataFrame(
        [(found["complexity"], found["linear_auc"], found["boosted_auc"], found["gap"])],
        "complexity string, linear_auc double, boosted_auc double, gap double",
    )


@catalog.add("auto_train")
def auto_train(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", "lang", "source", "n_chars", "quality")
    model = models.auto_train(joined, "quality", ["doc_id"], plan=QUICK_AUTO)
    return models.metrics_frame(spark, model.metrics)


@catalog.add("fraud_train")
def fraud_train(spark, sf_dir):
    return models.metrics_frame(spark, trained(spark, sf_dir).metrics)


@catalog.add("score_batch")
def score_batch(spark, sf_dir):
    model, rows = quick_model(spark, sf_dir, "GBT_Balanced")
    return models.score_batch(model, rows.select("event_id", *COLUMNS)).select("event_id", "score", "prediction", "risk_level")


@catalog.add("save_load_model", "SELECT event_id, true AS same FROM events")
def save_load_model(spark, sf_dir):
    """A model scores every row the same after it has been written and read."""
    model, rows = quick_model(spark, sf_dir, "LogisticRegression")
    path = fresh_path(spark, "model")
    model.save(path)
    back = models.TrainedModel.load(spark, path)
    first = model.score(rows).select("event_id", F.col("score").alias("a"))
    second = back.score(rows).select("event_id", F.col("score").alias("b"))
    return first.join(second, "event_id").select("event_id", (F.abs(F.col("a") - F.col("b")) < 1e-12).alias("same"))


# A fixed linear score, so that its impacts can be stated in SQL.
WEIGHTS = {"value": 0.04, "user_id": -0.002, "hour": 0.3, "minute": -0.05}
KEYS = ["event_id"]
FACTS = "facts AS (SELECT event_id, value, user_id, hour(ts) AS hour, minute(ts) AS minute FROM events)"
IMPACTS = (
    f"{FACTS}, imp AS ("
    + " UNION ALL ".join(
        f"SELECT event_id, '{f}' AS feature, {w!r}::DOUBLE * ({f} - (SELECT avg({f}) FROM facts)) AS impact FROM facts"
        for f, w in WEIGHTS.items()
    )
    + ")"
)


def linear_impacts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    facts = e.select("event_id", "value", "user_id", F.hour("ts").alias("hour"), F.minute("ts").alias("minute"))
    means = facts.agg(*[F.avg(f).alias(f) for f in WEIGHTS]).first().asDict()
    return explain.explain_linear(facts, KEYS, WEIGHTS, means)


@catalog.add("explain_linear", f"WITH {IMPACTS} SELECT * REPLACE (round(impact, 6) AS impact) FROM imp")
def explain_linear(spark, sf_dir):
    rows = linear_impacts(spark, sf_dir).select(*KEYS, F.expr("inline(impacts)"))
    return rounded(rows)


def kind_sql(kind: str, cond: str) -> str:
    keys = ", ".join(KEYS)
    return (
        f"SELECT {keys}, '{kind}' AS kind, row_number() OVER (PARTITION BY {keys} ORDER BY abs(impact) DESC, feature) AS rank, feature, impact "
        f"FROM imp WHERE {cond}"
    )


@catalog.add(
    "explain_rows_topk",
    f"WITH {IMPACTS} SELECT {', '.join(KEYS)}, kind, CAST(rank AS INTEGER) AS rank, feature, round(impact, 6) AS impact FROM ("
    f"{kind_sql('absolute', 'true')} UNION ALL {kind_sql('positive', 'impact > 0')} UNION ALL {kind_sql('negative', 'impact < 0')}) WHERE rank <= 2",
)
def explain_rows_topk(spark, sf_dir):
    return rounded(explain.top_impacts(linear_impacts(spark, sf_dir), KEYS, 2))


@catalog.add(
    "global_importance",
    f"WITH {IMPACTS} SELECT feature, round(avg(abs(impact)), 6) AS importance FROM imp GROUP BY feature",
)
def global_importance(spark, sf_dir):
    return rounded(explain.global_importance(linear_impacts(spark, sf_dir)))


def tree_output_matches(spark, sf_dir, name, boosted):
    """Every row's base and impacts add up to the model's own output."""
    model, rows = quick_model(spark, sf_dir, name)
    ready = model.vectors(rows, ["event_id"])
    explained, base = explain.explain_tree(ready, "event_id", model.feature_names, model.classifier, boosted)
    p = model.score(rows).select("event_id", "score")
    output = F.log(F.col("score") / (1 - F.col("score"))) if boosted else F.col("score")
    both = explain.base_and_impacts(explained, base).join(p, "event_id")
    return both.select("event_id", (F.abs(F.col("output") - output) < 1e-6).alias("additive"))


@catalog.add("explain_tree_forest", "SELECT event_id, true AS additive FROM events")
def explain_tree_forest(spark, sf_dir):
    return tree_output_matches(spark, sf_dir, "RandomForest", False)


@catalog.add("explain_tree_boosted", "SELECT event_id, true AS additive FROM events")
def explain_tree_boosted(spark, sf_dir):
    return tree_output_matches(spark, sf_dir, "GBT_Balanced", True)


# A tree over events: (test, left, right) or the value of a leaf; the value is asked twice on one way.
RULE_NAMES = ["value", "user_id", "hour"]
RULES = (("value", 40.0), (("user_id", 7.0), (("value", 10.0), 0.05, 0.2), 0.4), (("hour", 11.0), 0.6, 0.95))
RULE_ROWS = "SELECT event_id, value, user_id, hour(ts) AS hour FROM events"


def rule_leaves(rule=RULES, tests=()):
    """(value, tests) of every leaf; a test is (feature, bound, goes left)."""
    if not isinstance(rule, tuple):
        return [(rule, tests)]
    (feature, bound), left, right = rule
    return rule_leaves(left, (*tests, (feature, bound, True))) + rule_leaves(right, (*tests, (feature, bound, False)))


def passes_sql(tests):
    return " AND ".join(f"{f} {'<=' if left else '>'} {bound}" for f, bound, left in tests) or "true"


def rules_sql():
    """Shapley values over all sets of known features, with the shares of every leaf's way counted in SQL."""
    shares, leaves = [], rule_leaves()
    for k, (_, tests) in enumerate(leaves):
        for f in RULE_NAMES:
            kept = [
                f"(SELECT count(*) FILTER ({passes_sql(tests[: i + 1])}) / count(*) FILTER ({passes_sql(tests[:i])}) FROM r)"
                for i in range(len(tests))
                if tests[i][0] == f
            ]
            shares.append(f"{' * '.join(kept) or '1'} AS s{k}_{f}")

    def worth(known):
        parts = []
        for k, (value, tests) in enumerate(leaves):
            passed = [f"CAST({passes_sql([t for t in tests if t[0] == f])} AS INTEGER)" if f in known else f"s{k}_{f}" for f in RULE_NAMES]
            parts.append(f"{value}::DOUBLE * {' * '.join(passed)}")
        return f"({' + '.join(parts)})"

    out = []
    for f in RULE_NAMES:
        others, terms = [x for x in RULE_NAMES if x != f], []
        for known in ([], [others[0]], [others[1]], others):
            terms.append(f"({worth([*known, f])} - {worth(known)}) / {6 if len(known) == 1 else 3}.0::DOUBLE")
        out.append(f"SELECT event_id, '{f}' AS feature, round({' + '.join(terms)}, 6) AS impact FROM r, shares")
    return f"WITH r AS ({RULE_ROWS}), shares AS (SELECT {', '.join(shares)}) " + " UNION ALL ".join(out)


@catalog.add("explain_tree_rules", rules_sql())
def explain_tree_rules(spark, sf_dir):
    """Impacts of a given tree, its node sizes counted in one scan."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "value", "user_id", "hour(ts) AS hour")
    nodes, reach = {}, {}

    def place(rule, tests):
        at = len(reach)
        reach[at] = tests
        if not isinstance(rule, tuple):
            nodes[at] = (rule, None, -1, -1)
            return at
        (feature, bound), left, right = rule
        ends = [place(r, (*tests, (feature, bound, side))) for r, side in ((left, True), (right, False))]
        nodes[at] = (0.0, (feature, bound), *ends)
        return at

    place(RULES, ())
    covers = rows.selectExpr(*[f"count_if({passes_sql(tests)}) AS n{at}" for at, tests in reach.items()]).first()
    tree = {}
    for at, (value, test, left, right) in nodes.items():
        feature, bound = (RULE_NAMES.index(test[0]), test[1]) if test else (-1, None)
        tree[at] = explain.TreeNode(covers[f"n{at}"], value, feature, "le", bound, left, right)
    wide = rows.selectExpr("event_id", "array(double(value), double(user_id), double(hour)) AS x")
    found = explain.explain_paths(wide, "event_id", RULE_NAMES, explain.tree_paths(tree))
    return rounded(found.select("event_id", F.explode("impacts").alias("i")).select("event_id", "i.feature", "i.impact"))


RUNS = """runs AS (SELECT event_type AS model_name, user_id AS version, max(value) / 500 AS test_roc_auc, count(*) AS n FROM events GROUP BY 1, 2)"""


@catalog.add(
    "champion",
    f"WITH {RUNS} SELECT model_name, version, round(test_roc_auc, 6) AS test_roc_auc, "
    "row_number() OVER (PARTITION BY model_name ORDER BY runs.test_roc_auc DESC, version DESC) = 1 AS is_champion FROM runs",
)
def champion(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("event_type").alias("model_name"), F.col("user_id").alias("version")).agg(
        (F.max("value") / 500).alias("test_roc_auc")
    )
    return rounded(models.champions(runs))


@catalog.add(
    "set_champion",
    f"WITH {RUNS} SELECT model_name, version, round(test_roc_auc, 6) AS test_roc_auc, CASE WHEN model_name = 'click' THEN version = 7 ELSE "
    "row_number() OVER (PARTITION BY model_name ORDER BY runs.test_roc_auc DESC, version DESC) = 1 END AS is_champion FROM runs",
)
def set_champion(spark, sf_dir):
    """The champion of one model set by hand, those of the others by their metric."""
    e = table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("event_type").alias("model_name"), F.col("user_id").alias("version")).agg(
        (F.max("value") / 500).alias("test_roc_auc")
    )
    return rounded(models.set_champion(models.champions(runs), "click", 7))
