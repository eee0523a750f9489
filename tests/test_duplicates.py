"""Equal rows once: against a set of rows, and how few of them are moved."""

import random

import pytest
from pyspark.sql import functions as F

from scorewell.operators import cleaning, duplicates

SCHEMA = "a int, b double, s string, l array<int>"


def rows_of(seed, n):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    out = [(pick(None, 1, 2), pick(None, 0.5, float("nan")), pick(None, "x", "", "y"), pick(None, [], [1], [1, None])) for _ in range(n)]
    out += [(i, i / 7, f"row {i}", [i]) for i in range(n)]
    return out + [(7, 7.0, "hot", [])] * (n // 2)


def key(row):
    return repr(tuple(None if x != x else x for x in row))


@pytest.mark.parametrize("seed", range(3))
def test_rows_equal_a_set_of_rows(spark, seed, monkeypatch):
    monkeypatch.setattr(duplicates, "ROWS_PER_PART", 50)
    rows = rows_of(seed, 300)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got, n = duplicates.without_duplicates(df)
    assert n == len(rows)
    assert sorted(map(key, got.collect())) == sorted({key(r) for r in rows})


@pytest.mark.parametrize("words", [1, 1 << 21])
def test_a_full_filter_costs_rows_and_loses_none(spark, words, monkeypatch):
    monkeypatch.setattr(duplicates, "FILTER_WORDS", words)
    df = spark.range(4000).selectExpr("id % 3000 AS id", "'some text' AS t").repartition(5)
    numbers = duplicates.repeated_numbers(df, 1)
    assert numbers.count() == 1000
    passed, rest = duplicates.split_by_filter(df, duplicates._numbers(df, 1), numbers, 1000)
    assert passed.count() + rest.count() == 4000 and rest.where("id < 1000").count() == 2000
    assert rest.dropDuplicates().count() + passed.count() == 3000
    # Only the rows that may be repeated are shuffled: the 2,000 that are, and few others while the filter has room.
    assert words == 1 or rest.count() < 2000 + 0.2 * 2000


def test_rows_without_an_equal_are_not_shuffled(spark):
    df = spark.range(1000).withColumn("t", F.lit("x"))
    plan = cleaning.drop_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert cleaning.drop_duplicates(df).count() == 1000


def test_names_of_helpers_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "number int, `part.x` int")
    assert sorted(tuple(r) for r in cleaning.drop_duplicates(df).collect()) == [(1, 2), (3, 4)]
    assert cleaning.drop_duplicates(df.where("false")).collect() == []
    result, report = cleaning.clean_smart(df, outlier_method="none")
    assert ("duplicates_removed", None, 1) in report.steps and result.count() == 2


def test_a_rows_hash_is_no_filter(spark):
    """A filter on the hash of derived columns would derive each of them again, several times and in code too long to be compiled."""
    df = spark.range(4000).selectExpr("id % 3000 AS id", "concat('$ ', cast(id % 3000 AS string)) AS t")
    numbers = duplicates.repeated_numbers(df, 1)
    passed, rest = duplicates.split_by_filter(df, duplicates._numbers(df, 1), numbers, 1000)
    for part in (passed, rest):
        plan = part._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert any("xxhash64" in line for line in plan)
        assert not any("Filter" in line and "xxhash64" in line for line in plan)
