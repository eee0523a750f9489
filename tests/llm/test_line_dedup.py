import random
from collections import defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scorewell.llm import line_dedup as ld

from .conftest import prose


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text("abc", max_size=20), st.text("abc", max_size=20))
@settings(max_examples=300, deadline=None)
def test_distance_and_shared_keys(a, b):
    d = plain_distance(a, b)
    assert ld.edit_distance(a, b) == min(d, 3)
    if d <= 2 and min(len(a), len(b)) >= 3:
        assert ld.keys_of_line(a) & ld.keys_of_line(b)


@given(st.text("ab", max_size=20), st.text("ab", max_size=20))
@settings(max_examples=200, deadline=None)
def test_distance_of_long_lines(a, b):
    usual, ld.LONG = ld.LONG, 2
    try:
        assert ld.edit_distance(a, b) == min(plain_distance(a, b), 3)
    finally:
        ld.LONG = usual


def texts():
    rng = random.Random(12)
    pool = [prose(rng, 8) for _ in range(40)]
    edited = [x[:5] + "#" + x[6:] for x in pool[:10]] + [x + "!?" for x in pool[5:15]] + [x[1:] for x in pool[:4]] + ["short", "shorty"]
    lines = pool + edited
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 9)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " \n \n"), (None, pool[0]), (3, pool[1]), (103, "\n".join([pool[0]] * 50))]


def test_dedup_equals_brute_force(spark):
    rows = texts()
    got = {r.doc_id: r for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    where = defaultdict(list)
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\r\x0b\x0c"):
                where[x.strip(" \t\r\x0b\x0c")].append((i, n))
    lines = sorted(where)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(int)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= ld.LEAST_CHARS and plain_distance(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    classes = defaultdict(list)
    for x in lines:
        classes[find(x)] += [p for p in where[x]]
    dropped, n, n_links = defaultdict(list), defaultdict(int), defaultdict(int)
    for places in classes.values():
        keeper = min((p for p in places if p[0] is not None), default=places[0])
        places.remove(keeper)  # one of several at the same place
        for p in places:
            dropped[p[0]].append(p[1])
    for x in lines:
        for i, _ in where[x]:
            n[i] += 1
            n_links[i] += links[x]
    assert len(got) == len({i for i, _ in rows})
    for i in got:
        assert (got[i].n_lines, got[i].n_links, sorted(got[i].dropped)) == (n[i], n_links[i], sorted(dropped[i])), i


def test_repeated_rows_and_long_lines(spark):
    long = "x" * 30 + "abcdefghij" * 100_000
    rows = [(5, "alpha\nbeta")] * 2 + [(7, long), (8, "!" + long[:50] + long[51:])]
    got = {r.doc_id: r for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[5].n_lines, got[5].n_repeated, got[5].dropped) == (4, 2, [0, 1])
    assert [(got[i].n_links, got[i].dropped) for i in (7, 8)] == [(1, []), (1, [0])]


def test_texts_are_shuffled_once(spark):
    lines = ld.lines_of(spark.createDataFrame(texts(), "doc_id long, text string"))
    distinct, parts = ld.distinct_lines(lines, 500)
    assert distinct.count() == lines.select("line").distinct().count()
    plan = distinct.groupBy("part").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and parts % int(spark.conf.get("spark.sql.shuffle.partitions")) == 0


def test_empty_table(empty):
    assert ld.dedup_lines(empty).collect() == []


def test_groups_come_in_common_batches(spark):
    """Groups of two lines are not handed to Python one by one, and a group that batches cut gives the same links."""
    rng = random.Random(4)
    lines = [prose(rng, 9) for _ in range(30)]
    lines += [x[:4] + "#" + x[5:] for x in lines] + [lines[0] + "?", lines[0] + "!!", lines[1] + "."]
    groups = defaultdict(list)
    for i, x in enumerate(lines):
        for key in ld.keys_of_line(x):
            groups[key].append(i)
    rows = sorted((key if key < 1 << 63 else key - (1 << 64), i, lines[i]) for key, ids in groups.items() for i in ids)
    want = []
    for key, ids in groups.items():
        forest, counted = ld.links_in_group(ids, [lines[i] for i in ids], key)
        want += [(u, v, 0) for u, v in forest] + [(i, i, n) for i, n in counted.items()]
    for size in (1, 2, 7, len(rows)):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[]]
        types = {"key": pa.int64(), "line_id": pa.int64(), "line": pa.string()}
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in p], t) for k, t in enumerate(types.values())], list(types)) for p in parts]
        got = [tuple(r.values()) for b in ld.linked_groups(batches) for r in b.to_pylist()]
        assert sorted(got) == sorted(want) and want
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    calls, own = [], ld.materialize
    ld.materialize = lambda df, name="stage", files=None: calls.append((name, df._jdf.queryExecution().toString())) or own(df, name, files)
    try:
        ld.dedup_lines(docs).collect()
    finally:
        ld.materialize = own
    plan = dict(calls)["links"]
    assert "MapInArrow" in plan
