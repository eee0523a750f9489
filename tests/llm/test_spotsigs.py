import hashlib
import random

from pyspark.sql import functions as F

from scorewell.llm import spotsigs

from .conftest import prose


def test_edited_pairs_equal_brute_force(docs, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, r in enumerate(ordered):
        own, after = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(own) // 4
        edited = own[: len(own) - k] + after[:k]
        a, b, c = map(spotsigs.signatures, (own, edited, after))
        prints = (spotsigs.to_fingerprint(a), spotsigs.to_fingerprint(b))
        jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((r[0], len(own), hashlib.sha256(edited.encode()).hexdigest(), *prints, jaccard(a, b), jaccard(a, c)))
    got = [tuple(r) for r in spotsigs.edited_pairs(docs.withColumn("range", F.lit(1))).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [prose(rng, 150) for _ in range(30)]
    for t in texts[:12]:
        words = t.split()
        for k in (1, 4, 12):
            texts.append(" ".join(w if rng.random() > k / 150 else "changed" for w in words))
    prints = sorted({spotsigs.to_fingerprint(spotsigs.signatures(t)) for t in [*texts, "", "the"]})
    got = {(r.left, r.right) if r.left < r.right else (r.right, r.left) for r in spotsigs.similar_pairs(spark.createDataFrame([(p,) for p in prints], "fp string")).collect()}
    sets = {p: spotsigs.from_fingerprint(p) for p in prints if p}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert got == want and want


def test_single_document_and_empty_table(spark, empty):
    one = spark.createDataFrame([(5, "the only text that there is of it")], "doc_id long, text string")
    assert [(r.doc_id, r.near_next) for r in spotsigs.edited_pairs(one).collect()] == [(5, 1.0)]
    assert spotsigs.edited_pairs(empty).collect() == []
    assert spotsigs.with_fingerprint(empty).collect() == []
