import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.llm import shared_search

from .conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    found = [(i, Counter(words(t))) for i, t in docs]
    N, L = sum(1 for _, c in found if c), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in set(items):
        bag, scored = Counter(words(text)), []
        for doc, counts in found:
            m = 100 - 25 + ((25 * counts.total() * N) // L if L else 0)
            score = sum(
                k * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 12 * m))
                for t, k in bag.items()
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc, score))
        out += [(item, r + 1, x[3], x[4]) for r, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def test_terms_equal_the_pattern():
    text = "".join(map(chr, range(0x300))) + "A-b_c'd \x0b É9٣ 😀x y İ"
    assert [t.decode() for t in shared_search.terms(text.encode())] == words(text)


@pytest.fixture(scope="session")
def items(rows):
    rng = random.Random(8)
    whole = [r[1] for r in rows[:120]]
    stem = whole[3]
    out = [(i, " ".join(whole[i].split()[: rng.randint(1, 40)])) for i in range(40)]
    out += [(50, stem + " more"), (51, stem), (52, stem + " " + stem), (53, "the the the"), (54, ""), (55, None), (56, "nowhere-to-be-found")]
    return out + [(50, "other text of one id"), (None, "the of and"), (51, stem), (57, prose(rng, 3000))]


@pytest.mark.parametrize("block", [400_000, 300])
def test_search_equals_brute_force(spark, docs, rows, items, block, monkeypatch):
    monkeypatch.setattr(shared_search, "TERMS_PER_BLOCK", block)
    monkeypatch.setattr(shared_search, "SAMPLE", 2)
    frame = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int").repartition(3)
    got = shared_search.search(docs.withColumn("item", F.lit(9)).withColumn("score", F.lit(1)), frame, 20)
    want = brute([(r[0], r[1]) for r in rows], items, 20)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want and len(want) > 500


def test_shared_sums_equal_item_by_item():
    rng = random.Random(9)
    common = [rng.sample(range(60), 12) for _ in range(4)]
    bags = [Counter(rng.choices(range(60), k=rng.randint(0, 30)) + rng.choice(common)) for _ in range(50)] + [Counter()]
    made = shared_search.Sharing(bags)
    values = np.random.default_rng(1).integers(0, 1000, (60, 7))
    cells = made.sums(np.array([values[t] * k for t, k in made.atoms]))
    for bag, top in zip(bags, made.tops):
        want = sum((values[t] * k for t, k in bag.items()), np.zeros(7, int))
        assert (cells[top] if top >= 0 else np.zeros(7)).tolist() == want.tolist()


def test_what_items_share_is_added_up_once():
    stem = Counter(range(64))
    made = shared_search.Sharing([stem + Counter([100 + i]) for i in range(30)])
    # 63 sums for the stem and one for each item; item by item it would be 30 * 64.
    assert made.size - len(made.atoms) <= 63 + 30


def test_ties_by_id_and_top_rows_of_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(shared_search, "SAMPLE", 3)
    same = [(i, "red apple") for i in range(500, 0, -1)] + [(1000, "blue"), (None, "red apple")]
    frame = spark.createDataFrame(same, "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame([(1, "apple"), (2, "blue"), (3, "blue apple")], "item_id long, text string")
    got = shared_search.search(frame, asked, 20).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.item_id == 2] == [1000]
    assert sorted([tuple(r) for r in got], key=repr) == brute(same, [(1, "apple"), (2, "blue"), (3, "blue apple")], 20)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert shared_search.search(docs, none).collect() == []
    assert shared_search.search(empty, some).collect() == []
