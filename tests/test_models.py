import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from scorewell.operators import balance, explain, features, scoring
from scorewell.plans import models
from scorewell.sources import tables


@pytest.fixture(scope="module")
def mixed(spark):
    """Two numbers and a category; the label follows the first number with some noise."""
    rng = np.random.RandomState(7)
    n = 400
    x, y = rng.randn(n), rng.rand(n) * 100
    kind = rng.choice(["A", "B", "C"], n)
    label = ((x + rng.randn(n) * 0.4) > 0.9).astype(int)
    rows = [(i, float(a) if i % 11 else None, float(b), str(k) if i % 13 else None, int(t)) for i, (a, b, k, t) in enumerate(zip(x, y, kind, label))]
    return spark.createDataFrame(rows, "rid long, num1 double, num2 double, cat1 string, label int").repartition(4).cache()


def test_feature_values(spark):
    df = spark.createDataFrame([(0.0, 10.0), (3600.0, 0.0), (43200.0, 1000.0), (86399.0, 2000.0)], "Time double, Amount double")
    rows = features.engineer_features(df).collect()
    assert [r.Hour for r in rows[:3]] == [0.0, 1.0, 12.0]
    assert [r.Night_txn for r in rows] == [1, 1, 0, 1]
    assert [r.High_amount for r in rows] == [0, 0, 0, 1]
    assert rows[1].Amount_log == 0.0
    z = np.array([r.Amount_zscore for r in rows])
    assert z.mean() == pytest.approx(0) and z.std(ddof=1) == pytest.approx(1)


def test_one_row_has_a_finite_zscore_when_scoring(spark):
    df = spark.createDataFrame([(0.0, 10.0)], "Time double, Amount double")
    scale = features.fit_amount_scale(df, epsilon=features.SCORING_EPSILON)
    assert features.engineer_features(df, scale=scale).first().Amount_zscore == 0.0
    assert features.engineer_features(df).first().Amount_zscore is None


def test_bands(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 0.2, 0.21, 0.5, 0.8, 1.0, 1.1)], "score double")
    fixed = [r.risk_level for r in scoring.add_risk_band(df, "fixed").collect()]
    assert fixed == ["Low", "Low", "Medium", "Medium", "High", "Critical", "nan"]
    relative = [r.risk_level for r in scoring.add_risk_band(df, "relative", 0.8).collect()]
    assert relative[:4] == ["Low", "Medium", "Medium", "Medium"]


def test_degenerate_flag(spark):
    flat = spark.createDataFrame([(0.5, 1), (0.501, 1)], "score double, prediction int")
    assert scoring.batch_summary(flat).first().degenerate


def test_smote_counts_convexity_and_blocks(spark):
    rng = np.random.RandomState(0)
    rows = [(i, int(i < 30), *map(float, rng.randn(3) + 3 * (i < 30))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double")
    feats = ["a", "b", "c"]
    small = balance.smote(df, "id", "label", feats, cell_rows=3, block_rows=7)
    large = balance.smote(df, "id", "label", feats)
    key = lambda r: tuple(round(r[f], 9) for f in feats)
    made = [r for r in small.collect() if r.synthetic]
    assert len(made) == 340 and {r.label for r in made} == {1}
    assert sorted(map(key, made)) == sorted(key(r) for r in large.collect() if r.synthetic)
    base = np.array([r[2:] for r in rows if r[1] == 1])
    dist = ((base[:, None] - base[None]) ** 2).sum(-1)
    near = np.argsort(dist + np.eye(len(base)) * 1e9, axis=1)[:, :5]
    for r in made[:40]:
        p = np.array([r.a, r.b, r.c])
        gaps = [
            np.linalg.norm(p - base[i]) + np.linalg.norm(base[j] - p) - np.linalg.norm(base[i] - base[j])
            for i in range(len(base)) for j in near[i]
        ]
        assert min(gaps) < 1e-9


def test_smote_spreads_many_copies(spark, monkeypatch):
    monkeypatch.setattr(balance, "COPIES_PER_ROW", 5)
    df = spark.range(200).selectExpr("id", "int(id < 10) AS label", "double(id) AS a")
    assert balance.smote(df, "id", "label", ["a"]).groupBy("label").count().select("count").distinct().collect()[0][0] == 190


def test_smote_needs_neighbours(spark):
    df = spark.range(50).selectExpr("id", "int(id < 4) AS label", "double(id) AS a")
    with pytest.raises(ValueError):
        balance.smote(df, "id", "label", ["a"])


def test_preprocessor_fills_scales_and_names(spark, mixed):
    pre, names = models.build_preprocessor(mixed, ["num1", "num2"], ["cat1"])
    assert names == ["num__num1", "num__num2", "cat__cat1=A", "cat__cat1=B", "cat__cat1=C"]
    new = spark.createDataFrame([(None, None, "Z"), (None, None, None)], "num1 double, num2 double, cat1 string")
    unseen, filled = [r[0] for r in pre.transform(new).select(models.vector_to_array("features")).collect()]
    assert unseen[2:] == [0.0, 0.0, 0.0] and sum(filled[2:]) == 1.0
    with pytest.raises(ValueError):
        models.build_preprocessor(mixed, [], [])


def test_auto_train_scores_saves_and_loads(spark, mixed, tmp_path):
    model = models.auto_train(mixed, "label", ["rid"], plan={"LogisticRegression": 30, "GBT": 2}, folds=2)
    assert 0.5 < model.metrics["roc_auc"] <= 1 and 0 <= model.threshold <= 1
    assert set(model.features) == {"num1", "num2", "cat1"}
    model.save(str(tmp_path / "m"))
    back = models.TrainedModel.load(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([(1, 3.0, "x")], "rid long, num1 double, extra string")
    scored = models.score_batch(back, new).first()
    assert scored.extra == "x" and scored.prediction == int(scored.score >= back.threshold)
    with pytest.raises(ValueError):
        back.score(new, strict=True)
    with pytest.raises(FileNotFoundError):
        models.TrainedModel.load(spark, str(tmp_path / "none"))


def test_auto_train_refuses_more_than_two_classes(spark):
    df = spark.range(90).selectExpr("id AS rid", "double(id) AS x", "id % 3 AS t")
    with pytest.raises(ValueError):
        models.auto_train(df, "t", ["rid"], clean_data=False)


def test_failed_model_scores_zero(spark, mixed):
    class Broken(models.Estimator):
        def _fit(self, dataset):
            raise RuntimeError("no")

    rows = models.with_weight(mixed, False)
    plan = {"LogisticRegression": models.LogisticRegression(maxIter=5), "Broken": Broken()}
    scores = models.cross_validate(rows, ["rid"], ["num1"], [], plan, 2)
    assert scores["Broken"] == 0.0 and scores["LogisticRegression"] > 0.5
    assert [r.best for r in models.leaderboard(spark, scores).collect()] == [True, False]


def test_oversampled_fraud_training(spark, mixed):
    train, val = models.stratified_split(mixed.na.fill(0.0), ["rid"], "label", 0.3)
    model = models.fraud_train(train, val, ["rid"], ["num1", "num2"], plan={"LogisticRegression": 18, "RandomForest": 3}, oversample=True)
    assert model.metrics["business_cost"] == model.metrics["missed"] * 10_000 + model.metrics["false_alarms"] * 200


def test_probe_never_raises(spark):
    df = spark.range(20).selectExpr("id AS rid", "1 AS label", "double(id) AS x")
    assert models.complexity_probe(df, ["rid"], ["x"], [])["complexity"] == "unknown"


def test_champions(spark):
    runs = spark.createDataFrame([("m", 1, 0.9), ("m", 2, 0.95), ("m", 3, None)], "model_name string, version int, test_roc_auc double")
    marked = models.champions(runs)
    assert {r.version for r in marked.where("is_champion").collect()} == {2}
    assert {r.version for r in models.set_champion(marked, "m", 3).where("is_champion").collect()} == {3}


def brute_shapley(x, paths):
    """Shapley values by listing every set of known features."""
    used = sorted({f for p in paths for f in p.features})

    def value(known):
        total = 0.0
        for p in paths:
            v = p.value
            for f, share, tests in zip(p.features, p.shares, p.tests):
                if f in known:
                    v *= all((x[f] <= b if kind == "le" else x[f] in b) == left for kind, b, left in tests)
                else:
                    v *= share
            total += v
        return total

    out = np.zeros(len(x))
    d = len(used)
    for f in used:
        others = [g for g in used if g != f]
        for size in range(d):
            for known in itertools.combinations(others, size):
                w = factorial(size) * factorial(d - size - 1) / factorial(d)
                out[f] += w * (value({*known, f}) - value(set(known)))
    return out


def test_tree_impacts_match_every_order_of_features(spark):
    rng = np.random.RandomState(5)
    rows = [(i, *map(float, rng.randn(4))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").withColumn(
        "label", (F.col("a") * F.col("b") + F.col("c") > 0).cast("double")
    )
    ready = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df)
    model = RandomForestClassifier(numTrees=3, maxDepth=4, seed=1).fit(ready)
    explained, base = explain.explain_tree(ready, "id", list("abcd"), model, False)
    paths, _ = explain.read_paths(model, spark, False)
    got = {r.id: [i.impact for i in r.impacts] for r in explained.where("id < 5").collect()}
    for i in range(5):
        assert got[i] == pytest.approx(list(brute_shapley(np.array(rows[i][1:]), paths)))


def test_long_paths_and_tables_give_the_same(monkeypatch):
    """Leaves beyond the tables' size, features asked twice, categories, and a batch met pattern by pattern."""
    rng = np.random.RandomState(7)
    nodes, at = {}, 0
    for depth in range(9):
        f = depth % 7
        kind, bound = ("in", (0.0, 2.0)) if f == 3 else ("le", float(rng.rand()))
        nodes[at] = explain.TreeNode(1000 - 100 * depth, 0.0, f, kind, bound, at + 1, at + 2)
        nodes[at + 1] = explain.TreeNode(100, float(rng.randn()))
        at += 2
    nodes[at] = explain.TreeNode(100, 1.5)
    paths = explain.tree_paths(nodes)
    x = rng.rand(40, 7)
    x[:, 3] = rng.randint(0, 4, 40)
    want = [brute_shapley(r, paths) for r in x]
    assert np.allclose(explain.TreeImpacts(paths).of(x), want)
    monkeypatch.setattr(explain, "TABLE_BITS", 2)
    monkeypatch.setattr(explain, "TESTS_KEPT", 3)
    assert np.allclose(explain.TreeImpacts(paths).of(x), want)
    total = sum(p.value * all((r in b if k == "in" else r <= b) == l for f, ts in zip(p.features, p.tests) for k, b, l in ts for r in [x[0][f]]) for p in paths)
    assert np.isclose(explain.mean_output(paths) + want[0].sum(), total)


def test_top_impacts_by_hand(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0, -1.0)], "id long, x double, y double, z double")
    explained = explain.explain_linear(df, ["id"], {"x": 1.0, "y": 5.0, "z": 3.0}, {"x": 0.0, "y": 1.0, "z": 0.0})
    rows = explain.top_impacts(explained, ["id"], 2).collect()
    listed = {(r.kind, r["rank"]): (r.feature, r.impact) for r in rows}
    assert listed == {
        ("absolute", 1): ("y", -5.0), ("absolute", 2): ("z", -3.0), ("positive", 1): ("x", 2.0),
        ("negative", 1): ("y", -5.0), ("negative", 2): ("z", -3.0),
    }


def test_vector_form_equals_column_form(spark, mixed):
    pre, names = models.build_preprocessor(mixed, ["num1", "num2"], [])
    ready = pre.transform(mixed)
    got = explain.explain_linear_vector(ready, ["rid"], names, [2.0, -1.0], [0.1, 0.2])
    both = got.join(ready.select("rid", models.vector_to_array("features").alias("v")), "rid").first()
    assert [i.impact for i in both.impacts] == pytest.approx([2.0 * (both.v[0] - 0.1), -(both.v[1] - 0.2)])


def test_csv_with_bad_bytes_and_cap(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"id,name\n" + b"".join(b"%d,caf\xe9\n" % i for i in range(50)))
    latin = tables.load_csv(spark, str(path), "latin-1")
    assert {r.name for r in latin.collect()} == {"café"}
    assert {r.name for r in tables.load_csv(spark, str(path)).collect()} == {"caf�"}
    assert tables.load_csv(spark, str(path), max_rows=10, keys=["id"]).count() == 10
    assert tables.load_csv(spark, str(path), max_rows=10).count() == 10
    with pytest.raises(ValueError):
        tables.load_csv(spark, str(path), "ebcdic")


def test_utf16_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("id,name\n1,ä\n2,ö\n".encode("utf-16"))
    assert [(r.id, r.name) for r in tables.load_csv(spark, str(path), "utf-16").collect()] == [(1, "ä"), (2, "ö")]


def test_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        tables.split_features_target(spark.range(1), "label")
    assert len(tables.transaction_schema()) == 30


class Reached(Exception):
    pass


def test_folds_and_samples_are_read_back_not_derived_again(spark, monkeypatch):
    """Scans of a fit read what was written once, without the hashes that deal or draw the rows."""
    rows = spark.range(400).selectExpr("id", "double(id % 7) AS x", "int(id % 3 = 0) AS label", "1D AS weight")

    def stop(train, *args, **options):
        raise Reached(train)

    monkeypatch.setattr(models, "fold_statistics", stop)
    monkeypatch.setattr(models, "fit_best", stop)
    calls = {
        "dealt": lambda: models.cross_validate(rows, ["id"], ["x"], [], {}, 2),
        "sample": lambda: models.fraud_train(rows.drop("weight"), rows, ["id"], ["x"], plan={"LogisticRegression": 1}, fit_rows=200),
    }
    for name, call in calls.items():
        with pytest.raises(Reached) as reached:
            call()
        got = reached.value.args[0]
        assert got.inputFiles() and all(f"/{name}-" in x for x in got.inputFiles())
        assert got.count() == {"dealt": 400, "sample": 200}[name]


def test_fraud_training_fits_all_rows(spark, monkeypatch):
    """More rows than any bound that a sample once had: all of them come to the fit, and their classes make the weights."""
    n = 2_000_100
    rows = spark.range(n).selectExpr("id", "double(id % 7) AS x", "int(id % 3 = 0) AS label")

    def stop(train, *args, **options):
        raise Reached(train)

    monkeypatch.setattr(models, "fit_best", stop)
    with pytest.raises(Reached) as reached:
        models.fraud_train(rows, rows, ["id"], ["x"], plan={"LogisticRegression": 1})
    got = reached.value.args[0].groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    assert sum(r.n for r in got) == n
    assert [r.w for r in got] == [pytest.approx(n / 2)] * 2
