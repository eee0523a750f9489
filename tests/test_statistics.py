import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.operators import cleaning, encode, quality, sampling, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; the rest are spread out, with some missing."""
    rng = np.random.RandomState(3)
    a = np.where(rng.rand(6_000) < 0.33, 5.0, rng.lognormal(2, 1, 6_000))
    b = np.where(rng.rand(6_000) < 0.1, np.nan, rng.randn(6_000))
    return a, b, spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "id long, a double, b double").repartition(4)


@pytest.mark.parametrize("buffer", [10, 4_000, 1_000_000])
def test_quantiles_are_exact_whatever_the_buffer(skewed, buffer, monkeypatch):
    a, b, df = skewed
    if buffer == 10:
        monkeypatch.setattr(stats, "SKETCH_ACCURACY", 100)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    real_max = max
    if buffer == 10:
        # Let the share of a column fall below its usual floor, so that intervals are narrowed.
        monkeypatch.setattr(stats, "max", lambda *v: 60 if v[0] == 1_000 else real_max(*v), raising=False)
    got = stats.exact_quantiles(df, ["a", "b"], probs, buffer)
    assert got["a"] == pytest.approx(list(np.quantile(a, probs)))
    assert got["b"] == pytest.approx(list(np.nanquantile(b, probs)))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "a double")
    assert stats.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_repeated_values_leave_small_buffers(spark, monkeypatch):
    """Zero-inflated amounts: three quarters are zero, so quantiles fall beside a value of very many rows."""
    n, probs = 400_000, [0.25, 0.5, 0.74989, 0.7499, 0.75, 0.75001, 0.9, 1.0]
    heavy = F.when(F.col("id") % 10_000 < 7_499, 0.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 1024.0)
    low = F.when(F.col("id") % 10_000 < 2_500, -F.col("id").cast("double")).when(F.col("id") % 10_000 < 7_500, 7.0).otherwise(F.col("id") / 8)
    df = spark.range(n).select(heavy.alias("a"), low.alias("b")).cache()
    asked, aggregate = [], stats.aggregate
    monkeypatch.setattr(stats, "aggregate", lambda frame, exprs: asked.append(exprs) or aggregate(frame, exprs))
    got = stats.exact_quantiles(df, ["a", "b"], probs, 1_000)
    for name in ("a", "b"):
        want = df.selectExpr(f"percentile({name}, array({', '.join(map(str, probs))}))").first()[0]
        assert got[name] == pytest.approx(want, rel=1e-12)
    buffers = [re.match(r"percentile\((.*), array\(", x)[1] for x in asked[-1].values()]
    assert max(df.selectExpr(*[f"count(DISTINCT {b})" for b in buffers]).first()) <= 1_000
    assert len(asked) < 30
    df.unpersist()


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("b", 1), ("a", 1), (None, None)], "s string, n int")
    assert stats.exact_modes(df, ["s", "n"]) == {"s": "a", "n": 1}


def test_nulls_in_different_places_are_different_rows(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 1)], "a int, b int")
    assert stats.duplicate_count(df) == 1


def test_settle_counts_exactly_near_a_limit(spark):
    df = spark.range(51).selectExpr("string(id) AS s")
    assert stats.settle_distinct(df, {"s": 49}, {"s": [50]}) == {"s": 51}
    assert stats.settle_distinct(df, {"s": 49}, {"s": [5_000]}) == {"s": 49}


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (10.0,)], "x double")
    rows = stats.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r.n for r in rows] == [2, 0, 0, 0, 1]


def test_correlation_skips_missing_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (float("nan"), 1.0)], "a double, b double")
    assert stats.correlation_pairs(df, ["a", "b"]).first()["corr"] == pytest.approx(1.0)


def test_correlations_by_blocks_equal_one_aggregation_per_pair(spark, monkeypatch):
    """Missing and infinite cells, a constant, a column without values, columns that lose digits in sums, and several blocks of columns."""
    rng = np.random.RandomState(3)
    rows = []
    for i in range(400):
        a, b = map(float, rng.randn(2))
        far = 1e3 + a
        rows.append((a, b, a + 0.1 * b, None if i % 3 else b, 7.1, None, far if i >= 300 else -1e12, float("inf") if i == 5 else a, None if i < 300 else a))
    names = list("abcdefghi")
    df = spark.createDataFrame(rows, ", ".join(f"{x} double" for x in names)).repartition(5)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    cells = np.array(rows, float)

    def brute(i, j):
        both = cells[~np.isnan(cells[:, [i, j]]).any(axis=1)][:, [i, j]]
        if len(both) < 2 or np.isinf(both).any() or (both.min(axis=0) == both.max(axis=0)).any():
            return None
        return np.corrcoef(both.T)[0, 1]

    want = {(x, y): brute(names.index(x), names.index(y)) for x, y in pairs}
    for most in (512, 4):
        monkeypatch.setattr(stats, "DENSE_COLUMNS", most)
        got = {(r.a, r.b): r["corr"] for r in stats.correlation_pairs(df, names).collect()}
        assert set(got) == set(pairs)
        for pair, value in got.items():
            assert value is None if want[pair] is None else value == pytest.approx(want[pair], abs=1e-9), pair
    none = stats.correlation_pairs(df.where("a > 1e9"), ["a", "b", "c"]).collect()
    assert len(none) == 3 and all(r["corr"] is None for r in none)


def test_scans_do_not_grow_with_pairs(spark):
    df = spark.range(50).selectExpr(*[f"double(id * {i} % 17) AS c{i}" for i in range(40)])
    plans = lambda n: stats.co_moments(df, [f"c{i}" for i in range(n)])._jdf.queryExecution().executedPlan().toString()
    assert plans(40).count("Range (") == plans(3).count("Range (") == 1
    assert len(stats.correlation_pairs(df, df.columns).collect()) == 780


def test_hash_cuts_when_bands_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_GROUPS", 300)
    df = spark.range(20_000).withColumn("k", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    sizes = sampling.class_sizes(df, "k")
    taken = df.where(sampling.take_per_class(df, ["id"], {"x": 1_234, "y": 7}, sizes, "k"))
    assert {r.k: r["count"] for r in taken.groupBy("k").count().collect()} == {"x": 1_234, "y": 7}


@pytest.mark.parametrize("quota", [1_000, 5_000, 9_000])
def test_copies_of_a_third_of_the_rows_stay_together(spark, monkeypatch, quota):
    monkeypatch.setattr(sampling, "MOST_GROUPS", 300)
    df = spark.range(12_000).withColumn("key", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")))
    taken = sampling.uniform_sample(df, quota, ["key"])
    n, copies = taken.count(), taken.where("key = -1").count()
    assert copies in (0, 4_000)
    # The part is exact unless taking the copies would have passed the quota.
    assert n == quota or (n <= quota and copies == 0 and n + 4_000 > quota)


def test_split_is_exact_disjoint_and_repeatable(spark):
    df = spark.range(1_000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    train, test = sampling.stratified_split(df, ["id"], "label", 0.2)
    assert {r.label: r["count"] for r in test.groupBy("label").count().collect()} == {0: 180, 1: 20}
    assert train.count() == 800 and train.join(test, "id").count() == 0
    again = sampling.stratified_split(df.repartition(7), ["id"], "label", 0.2)[1]
    assert {r.id for r in again.collect()} == {r.id for r in test.collect()}


def test_folds_are_balanced(spark):
    df = spark.range(103).withColumn("label", (F.col("id") < 20).cast("int"))
    counts = sampling.stratified_folds(df, ["id"], "label", 5).groupBy("label", "fold").count().collect()
    assert len(counts) == 10
    assert {r["count"] for r in counts if r.label == 1} == {4}
    assert {r["count"] for r in counts if r.label == 0} <= {16, 17}


def test_sample_larger_than_table_is_the_table(spark):
    assert sampling.uniform_sample(spark.range(5), 10, ["id"]).count() == 5


def test_cleaning_rules(spark):
    df = spark.createDataFrame(
        [("Yes", "$1,000", " a ", 1.0, 0), ("no", "20%", "b", 2.0, 1), (None, None, None, float("nan"), 0)],
        "flag string, price string, word string, x double, target int",
    )
    clean, report = cleaning.clean_smart(df, "target", outlier_method="none")
    rows = {(r.flag, r.price, r.word, r.x, r.target) for r in clean.collect()}
    assert rows == {(1, 1000.0, "a", 1.0, 0), (0, 20.0, "b", 2.0, 1), (None, None, None, None, 0)}
    assert report.columns("boolean_coerced") == ["flag"] and report.columns("numeric_string_coerced") == ["price"]


def test_words_with_suffixes_are_no_numbers(spark):
    df = spark.createDataFrame([("1d",), ("2f",), ("0x1p3",), ("NaN",)], "s string")
    assert cleaning.numeric_string_columns(df) == []


def test_few_values_have_no_outlier_bounds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)], "x double")
    assert cleaning.outlier_bounds(df, ["x"]) == {}
    with pytest.raises(ValueError):
        cleaning.outlier_bounds(df, ["x"], "magic")


def test_capping_keeps_missing_cells(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1e6,), (None,)], "x double")
    values = [r.x for r in cleaning.cap_outliers(df).collect()]
    assert None in values and max(v for v in values if v is not None) < 100


def test_alignment(spark):
    df = spark.createDataFrame([(1, 2)], "a int, extra int")
    assert cleaning.align_columns(df, ["b", "a"]).first().asDict() == {"b": 0, "a": 1}
    match = cleaning.alignment(df, ["b", "a"])
    assert (match.matched, match.missing, match.extra) == (["a"], ["b"], ["extra"])
    with pytest.raises(ValueError):
        cleaning.align_columns(df, ["b", "a"], strict=True)


def test_quality_of_an_empty_table(spark):
    report = quality.quality_report(spark.createDataFrame([], "a int"))
    assert report.first()["type"] == "empty"
    assert quality.quality_grade(report).first().overall_quality == "poor"


def test_roles_by_rule(spark):
    df = spark.range(300).selectExpr(
        "id AS customer_id", "string(date_add(DATE'2024-01-01', int(id))) AS seen", "id % 7 AS few", "double(id) / 7 AS amount",
        "concat('w', id % 5) AS word", "concat('u', id) AS handle", "repeat(concat('long text ', id % 60), 8) AS body",
        "id % 2 = 0 AS flag", "cast(null AS string) AS gone", "timestamp_seconds(id) AS at", "id * 3 AS many",
    )
    roles = quality.column_roles(df)
    assert roles == {
        "customer_id": "id", "seen": "id", "few": "cat", "amount": "numeric", "word": "cat", "handle": "id", "body": "text",
        "flag": "cat", "gone": "id", "at": "date", "many": "id",
    }
    assert quality.column_roles(df, overrides={"many": "numeric"})["many"] == "numeric"


def test_many_integers_are_no_id_unless_asked(spark):
    df = spark.range(400).selectExpr("id % 200 AS score", "id AS x")
    assert quality.column_roles(df)["score"] == "numeric"
    assert quality.column_roles(df, id_ints=100)["score"] == "id"


def test_written_dates_are_dates(spark):
    df = spark.range(300).selectExpr("date_format(date_add(DATE'2024-01-01', int(id % 40)), 'MM/dd/yyyy') AS seen", "id AS x")
    assert quality.column_roles(df)["seen"] == "date"


def test_profile_refuses_what_it_cannot_do(spark):
    with pytest.raises(ValueError):
        quality.dataset_profile(spark.range(3), "nope")
    with pytest.raises(ValueError):
        quality.dataset_profile(spark.range(0), "id")


def test_tiers():
    assert [quality.tier_of(n) for n in (999, 1_000, 50_000, 200_000, 500_000, 2_000_000)] == [0, 1, 2, 3, 4, 5]


def test_unseen_categories_get_zeros_on_both_paths(spark):
    train = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [("c",), ("d",)], "k string")
    new = spark.createDataFrame([("a",), ("c",), ("zzz",), (None,)], "k string")
    results = []
    for literal in (100, 1):
        fitted = encode.fit_one_hot(train, ["k"], max_categories=3, literal_categories=literal)
        assert fitted.kept == {"k": ["a", "b"]}
        results.append(sorted(tuple(r) for r in fitted.apply(new).collect()))
    assert results[0] == results[1] == [(0, 0, 0), (0, 0, 0), (0, 0, 1), (1, 0, 0)]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.x for r in encode.fit_standard_scale(df, ["x"]).apply(df).collect()] == [0.0, 0.0]


def test_target_encoding(spark):
    df = spark.createDataFrame([("no",), ("yes",)], "t string")
    assert encode.fit_target(df, "t").labels == {"no": 0, "yes": 1}
    assert encode.fit_target(df, "t", "no").labels == {"no": 1, "yes": 0}
    assert encode.fit_target(spark.createDataFrame([(1,), (0,)], "t int"), "t").labels == {0: 0, 1: 1}
