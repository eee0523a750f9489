import math
import random

import pytest
from pyspark.sql import functions as F

from scorewell.llm import wand

from .conftest import prose


def items_and_texts():
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(12, 50)) + " " + prose(rng, rng.randint(3, 9))) for i in range(60)]
    texts = [prose(rng, 300) for _ in range(60)]
    for i in range(0, 60, 3):
        texts[i] = texts[i] + "\n" + items[i][1].upper() + "\n" + prose(rng, 200)
    return items, texts


def test_retrieval_equals_scoring_all_items():
    items, texts = items_and_texts()
    index = wand.build_index(items)
    for text in texts[:30]:
        words = wand.words_of(text)
        got = wand.retrieve(index, words)
        step = index.window // 2
        want = {}
        halves = math.ceil(len(words) / step)
        for w in range(halves):
            held = {index.vocabulary[x] for x in words[w * step : w * step + index.window] if x in index.vocabulary}
            scores = index.weights[sorted(held)].sum(axis=0)
            for item in range(len(index.ids)):
                if scores[item] >= 1 - 1e-4:
                    want[item] = max(want.get(item, 0), float(scores[item]))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in got)


def test_leaks_found_and_clean_left(spark):
    items, texts = items_and_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("leaks", F.lit("clash"))
    held = spark.createDataFrame(items + [(70, None), (71, "!"), (72, items[0][1])], "item_id long, text string")
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in wand.with_leaks(docs, held).collect()}
    for i in range(60):
        assert got[i] == ({0, 72} if i == 0 else {i} if i % 3 == 0 else set())
    assert got[100] == got[101] == set() and got[102] == got[None] == {0, 72}


def test_empty_tables(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.leaks == [] for r in wand.with_leaks(docs, none).collect())
    assert wand.with_leaks(empty, none).collect() == []


def test_many_indexes_give_the_same(spark, monkeypatch):
    """Retrieved items and their scores, which rest on statistics of all items."""
    items, texts = items_and_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = spark.createDataFrame(items + [(70, None), (72, items[0][1])], "item_id long, text string")
    leaks = lambda: {r.doc_id: [x.asDict() for x in r.leaks] for r in wand.with_leaks(docs, held).collect()}
    one = leaks()
    monkeypatch.setattr(wand, "ITEMS_PER_INDEX", 20)
    many = leaks()
    for i in range(60):
        assert {x["item_id"] for x in many[i]} == ({0, 72} if i == 0 else {i} if i % 3 == 0 else set())
        assert [x["score"] for x in sorted(many[i], key=lambda x: x["item_id"])] == pytest.approx([x["score"] for x in one[i]], rel=1e-5)
