import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scorewell.llm import kneser_ney as kn

from .conftest import prose


def plain_model(texts):
    """Interpolated modified Kneser-Ney in dictionaries: p(gram) for any gram of order ORDER."""
    counts = {kn.ORDER: Counter(tuple(c[i : i + kn.ORDER]) for t in texts for c in [kn.class_codes(t).tolist()] for i in range(len(t)))}
    for n in range(kn.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = []
    for n in range(1, kn.ORDER + 1):
        of = Counter(counts[n].values())
        if not of[1] or not of[2]:
            d = (0.5, 0.75, 0.75)
        else:
            y = of[1] / (of[1] + 2 * of[2])
            raw = [1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3] if of[3] else 1.0]
            d = [min(max(x, 0.01), k + 0.99) for k, x in enumerate(raw)]
        total, freed = Counter(), Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        tables.append((counts[n], d, total, freed))

    def p(gram):
        out = 1 / kn.CLASSES
        for n, (count, d, total, freed) in enumerate(tables, 1):
            g = gram[-n:]
            if total[g[:-1]]:
                c = count[g]
                out = ((c - d[min(c, 3) - 1]) if c else 0) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * out
        return out

    return p


def test_scores_equal_a_plain_model(spark):
    rng = random.Random(2)
    train = [prose(rng, 40) for _ in range(30)] + ["", "x"]
    test = [prose(rng, 20), "QQQ!! ZZZ%% 99", "a", "", None]
    frame = lambda ts: spark.createDataFrame([(t,) for t in ts], "text string")
    model = kn.Model(kn.count_ngrams(frame(train)))
    scored = model.score(kn.count_ngrams(frame(test)).select("gram"))
    got = {r.text: r.kn_score for r in kn.perplexities(frame(test), scored).collect()}
    p = plain_model(train)
    for t in test[:3]:
        c = kn.class_codes(t).tolist()
        want = -np.mean([math.log(p(tuple(c[i : i + kn.ORDER]))) for i in range(len(t))])
        assert abs(got[t] - want) < 1e-4
    assert got[""] is None and got[None] is None


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(4)
    texts = [(i, prose(rng, 80), "en") for i in range(200)] + [(200 + i, prose(rng, 80).upper().replace(" ", "!! "), "en") for i in range(30)]
    docs = spark.createDataFrame(texts + [(900, None, None), (901, "", "xx"), (None, "short", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120)] + [(205, 0, 0), (206, 1, 0), (206, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kn_keep for r in kn.quality(docs.withColumn("kn_score", F.lit("clash")), labels).collect()}
    assert len(got) == 233 and got[900] and got[901] and got[None]
    assert sum(got[i] for i in range(200)) >= 199 and not any(got[200 + i] for i in range(30))


def test_scripts_beyond_latin_are_judged(spark, monkeypatch):
    """Letters beyond ASCII, capitals and digits differ; scores lie in several files, and ranks come from sorting."""
    monkeypatch.setattr(kn, "SHARD_GRAMS", 300)
    rng = random.Random(6)
    cyrillic = lambda t: "".join(chr(ord(c) - 97 + 0x430) if "a" <= c <= "z" else c for c in t.lower())
    good = [cyrillic(prose(rng, 60)) for _ in range(60)]
    junk = ["".join(rng.sample(t, len(t))) for t in good[:10]]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string").withColumn("lang", F.lit("ru"))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")
    got = {r.doc_id: (r.kn_keep, r.kn_score) for r in kn.quality(docs, labels).collect()}
    assert sum(got[i][0] for i in range(60)) >= 58 and not any(got[60 + i][0] for i in range(10))
    p = plain_model(good[::2])
    c = kn.class_codes(junk[0]).tolist()
    assert abs(got[60][1] + np.mean([math.log(p(tuple(c[i : i + kn.ORDER]))) for i in range(len(junk[0]))])) < 1e-4
    assert len({tuple(kn.class_codes(x)) for x in ("a", "A", "B", "1", "2", "\u0430", "\u0431", "\U0001f600")}) == 8


def test_ranks_by_table_and_by_sorting_agree(monkeypatch):
    texts = [kn.class_codes(x) for x in ("abcabc", "", "x", "\U0010ffff\u4e2d ab")]
    table = kn.ngrams(texts)
    monkeypatch.setattr(kn, "DENSE", 0)
    assert all((a == b).all() for a, b in zip(table, kn.ngrams(texts)))
    codes = [t.tolist() for t in texts]
    want = [tuple(c[i : i + 4]) for c in codes for i in range(len(c) - 3)]
    hi, lo, of = table
    assert [(hi[i] >> 21, hi[i] & kn.MASK, lo[i] >> 21, lo[i] & kn.MASK) for i in of] == want


def test_empty_tables_and_no_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kn.quality(empty, none).collect() == []
    assert all(r.kn_keep for r in kn.quality(docs, none).collect())
