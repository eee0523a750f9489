import random

import xxhash
from pyspark.sql import functions as F

from scorewell.llm import simhash
from scorewell.llm.graph import components


def plain_fingerprint(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_near_duplicates_equal_brute_force(docs, rows):
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs.withColumn("fp", F.lit("clash"))).collect()]
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    roots = reachable({p for _, p in prints}, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    want = [(i, p, least.get(roots[p])) for i, p in prints]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_links_at_the_radius(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    values = set(base) | {flip(x, k) for x in base for k in (1, 3, 4, 5, 6)}
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = components(simhash.fingerprint_links(frame)).collect()
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in found}
    roots = reachable(values, lambda a, b: bin(a ^ b).count("1") <= 4)
    groups = lambda m: {frozenset(n for n in m if m[n] == r) for r in set(m.values())}
    assert {g for g in groups(roots) if len(g) > 1} == groups(got)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []
