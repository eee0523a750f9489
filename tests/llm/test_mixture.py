import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from scorewell.llm import mixture


def level(sizes, weights, total, most):
    """Excess reshared by weight until no share is above its cap."""
    capped = set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        free = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        share = [most * s if i in capped else left * w / free for i, (s, w) in enumerate(zip(sizes, weights))]
        over = {i for i in range(len(sizes)) if i not in capped and share[i] > most * sizes[i]}
        if not over:
            return share
        capped |= over


def test_targets_and_draws(docs, rows):
    run = lambda: mixture.draw(docs.withColumn("mix_size", F.lit(1)), mixture.words(F.col("text"))).drop("mix_size_").collect()
    got = run()
    assert sorted(got, key=repr) == sorted(run(), key=repr)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in sources]
    want = dict(zip(sources, level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5 * sum(sizes), 2)))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.mix_size == size(r.text) and abs(r.mix_target - want[r.source]) < 1e-6
        assert len(r.mix_shards) <= 2
        taken[r.source] += r.mix_size * len(r.mix_shards)
        largest[r.source] = max(largest[r.source], r.mix_size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sources)


def test_mixed_repeats_rows_as_drawn(docs):
    drawn = mixture.draw(docs, mixture.words(F.col("text")), shards=4)
    want = Counter((r.doc_id, r.text, s) for r in drawn.collect() for s in r.mix_shards)
    assert Counter((r.doc_id, r.text, r.mix_shard) for r in mixture.mixed(docs, mixture.words(F.col("text")), shards=4).collect()) == want


def test_tree_keeps_all_counts():
    tickets = np.array([0, 7, 1000, 33])
    out = mixture.splitting_tree(tickets, 5)
    assert (out.sum(axis=1) == tickets).all() and (out >= 0).all()
    assert out.sum(axis=0).max() - out.sum(axis=0).min() <= 3


def test_empty_table(empty):
    assert mixture.mixed(empty, mixture.words(F.col("text"))).collect() == []
