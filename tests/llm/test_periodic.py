import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.llm import periodic

from .conftest import prose


def brute_runs(words, least=6, repeats=4):
    """All runs by comparing every word with the one q places on, for every q."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def echoed(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute_row(doc_id, text):
    words = echoed(doc_id, text)
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_every_difference_is_in_the_cover():
    assert (periodic.SHIFTS >= 0).all()
    assert {(a - b) % periodic.CYCLE for a in periodic.COVER for b in periodic.COVER} == set(range(periodic.CYCLE))


@pytest.mark.parametrize("letters,size", [(1, 300), (2, 400), (3, 700), (40, 500)])
def test_extensions_equal_word_by_word(letters, size):
    rng = np.random.default_rng(letters)
    words = rng.integers(0, letters, size)
    words[size // 2 :] = words[: size - size // 2]  # long common stretches
    words = np.concatenate([[100], words, [101]])
    a = rng.integers(1, size, 500)
    b = np.minimum(a + rng.integers(1, size, 500), size)
    a, b = a[a < b], b[a < b]
    want = []
    for x, y in zip(a, b):
        k = 0
        while words[x + k] == words[y + k]:
            k += 1
        want.append(k)
    assert periodic.Extensions(words).between(a, b).tolist() == want


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(periodic, "PAIRS_AT_ONCE", rng.choice([50, 1 << 20]))
    monkeypatch.setattr(periodic, "WORDS_AT_ONCE", rng.choice([60, 1 << 15]))
    texts = []
    for _ in range(25):
        words = []
        while len(words) < rng.choice([0, 5, 30, 400]):
            unit = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 9))]
            words += (unit * rng.randint(1, 12))[: rng.randint(1, 90)]
        texts.append(words)
    least, repeats = rng.choice([(6, 4), (2, 2), (9, 3)])
    runs, collapsed = periodic.periodic(texts, least, repeats)
    for words, r, c in zip(texts, runs, collapsed):
        want = brute_runs(words, least, repeats)
        assert [tuple(x) for x in r.tolist()] == want
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        assert c == b" ".join(w for i, w in enumerate(words) if i not in dropped)


def test_digests_equal_brute_force(docs, rows):
    wide = docs.withColumn("runs", F.lit(1)).withColumn("best", F.lit("x")).withColumn("g", F.lit(2))
    got = periodic.run_digests(periodic.with_runs(periodic.with_echoes(wide))).collect()
    want = [brute_row(r[0], r[1]) for r in rows if len(r[1] or "") < 20_000]
    found = [tuple(r) for r in got if r.doc_id != 403]
    assert sorted(found, key=repr) == sorted(want, key=repr) and any(r[1] for r in want)
    assert got[0].__fields__[:3] == ["doc_id", "n_runs", "start"] and len(got) == len(rows)


def test_other_columns_stay_and_empty_tables_stay_empty(spark, docs, empty):
    out = periodic.with_runs(docs.withColumn("collapsed", F.lit(3)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "runs", "collapsed"]
    row = out.where("doc_id = 402").first()
    assert row.runs == [] and row.collapsed == "" and row.lang == "en"
    assert periodic.run_digests(periodic.with_runs(periodic.with_echoes(empty))).collect() == []


def test_very_long_text_in_near_linear_time(spark):
    """A megabyte of one word, one of a long period, and one without a run."""
    rng = random.Random(4)
    unit = prose(rng, 25_000)
    texts = ["la " * 350_000, " ".join([unit] * 5), " ".join(map(str, range(150_000)))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.with_runs(frame).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 350_000, 1)] and got[0].collapsed == "la"
    assert (0, 125_000, 25_000) in [tuple(x) for x in got[1].runs] and got[2].runs == []
    assert got[2].collapsed == texts[2]
