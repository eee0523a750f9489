import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorewell.llm import packing, word_ids

from .conftest import prose

WORDS = public_tokenizers.path("word_bpe_49k.json")


def check_plan(histogram, capacity):
    """Every id of every rest stands once, sequences are gapless, and only powers of two are not full."""
    rows = packing.plan(histogram, capacity)
    pieces, fill = {}, {}
    for rest, first, n, cut, length, m, sequence, offset in rows.tolist():
        for i in range(n):
            pieces.setdefault((rest, first + i), []).append((cut, length))
            fill.setdefault(sequence + i // m, []).append((offset + i % m * length, length))
    assert sorted(pieces) == sorted((k, i) for k, n in histogram.items() for i in range(n))
    for (rest, _), parts in pieces.items():
        assert cover(parts) == rest
    sizes = [cover(parts) for parts in fill.values()]
    assert sorted(fill) == list(range(len(fill)))
    short = [s for s in sizes if s < capacity]
    assert max(sizes, default=0) <= capacity and all(s & (s - 1) == 0 for s in short) and len(set(short)) == len(short)
    return pieces


def cover(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at and length > 0
        at += length
    return at


@pytest.mark.parametrize("seed", range(10))
def test_plan_places_every_id_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([2, 16, 100, 4096])
    histogram = {rng.randint(1, capacity): rng.randint(1, rng.choice([3, 400])) for _ in range(rng.choice([1, 5, 60]))}
    check_plan(histogram, capacity)


def test_plan_of_many_documents_cuts_few():
    rng = np.random.default_rng(3)
    lengths = np.minimum(np.exp(rng.normal(5.5, 1.2, 60_000)).astype(int) + 1, 4096)
    pieces = check_plan(dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)])), 4096)
    assert sum(len(p) > 1 for p in pieces.values()) < 0.15 * len(pieces)


def test_plan_size_does_not_follow_the_data():
    rng = np.random.default_rng(4)
    lengths = dict(zip(*[x.tolist() for x in np.unique(rng.integers(1, 2000, 50_000), return_counts=True)]))
    many, more = (len(packing.plan({k: n * f for k, n in lengths.items()}, 4096)) for f in (1_000, 1_000_000))
    assert more < 2 * many and more < 400_000


def test_knapsack_and_columns_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes, prices = rng.choice(np.arange(3, 15), 4, replace=False), np.round(rng.random(4), 3)
        worth, counts = packing.knapsack(sizes, prices, 30)
        best = max(
            a * prices[0] + b * prices[1] + c * prices[2] + d * prices[3]
            for a in range(11) for b in range(11) for c in range(11) for d in range(11)
            if a * sizes[0] + b * sizes[1] + c * sizes[2] + d * sizes[3] <= 30
        )
        assert worth == pytest.approx(best) and counts @ prices == pytest.approx(best) and counts @ sizes <= 30
    # Optimal by duality: the basis' prices pay for no pattern there is, and the demand at these prices is what is used.
    sizes, demand = np.array([51, 45, 40, 30]), np.array([78.0, 40, 30, 30])
    patterns, x = packing.generate_columns(sizes, demand, 182)
    assert (patterns.T @ x).round(6).tolist() == demand.tolist() and (patterns @ sizes <= 182).all()
    prices = np.linalg.solve(patterns.astype(float), np.ones(4))
    every = np.stack(np.meshgrid(*[np.arange(7)] * 4), -1).reshape(-1, 4)
    every = every[every @ sizes <= 182]
    assert (every @ prices).max() <= 1 + 2 * packing.GAP and demand @ prices == pytest.approx(x.sum())


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(file, rows, monkeypatch):
    monkeypatch.setattr(word_ids, "KEPT", 50)
    made = word_ids.WordIds(public_tokenizers.path(file))
    whole = Tokenizer.from_file(public_tokenizers.path(file))
    odd = [
        "don't DON'T 'start we'll 'S 's's x'y", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "Á e ́x ÅΩ", "one\x1ctwo\x1d three",
        "12345 a1b2 3.14,x---y...'s", " wide　space\x85\xa0end\x0b\x0cff", "İstanbul ΣΑΣ straße ﬁ", "x" * 300, "tab\tnl\r\n", "", "a\x00b", "two  spaces  \n\n and\n line\t\tx ", " lead", "trail  ", "9x 99 's 're don't-'ve", "ÀÖ×÷ºª µ ßÿ", "日本語 テキスト 😀😀", "~`!@#$%^&*()",
    ]
    texts = odd + [r[1] or "" for r in rows[:130]]
    for _ in range(2):
        assert made.encode(pa.array(texts)) == [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert made.rules and made.rules.spaced == file.startswith("byte")


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pack_holds_every_document(docs, rows, capacity):
    whole = Tokenizer.from_file(WORDS)
    wide = docs.withColumn("rest", F.lit("x")).withColumn("start", F.lit(1)).withColumn("block", F.lit(1))
    found = packing.pack(wide, WORDS, 2, capacity)
    got = found.collect()
    want = sorted((r[0] is None, r[0] or 0, whole.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows)
    pieces, fill = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id is None, r.doc_id or 0), []).append((r.start, r.doc_tokens, ids))
    for key in {w[:2] for w in want}:
        mine = [w[2] for w in want if w[:2] == key]
        if len(mine) == 1:
            assert sum((p[2] for p in sorted(pieces[key])), []) == mine[0] and {p[1] for p in pieces[key]} == {len(mine[0])}
        else:
            assert sorted(sum((p[2] for p in pieces[key]), [])) == sorted(sum(mine, []))
    sizes = [cover(p) for p in fill.values()]
    assert max(sizes) <= capacity and all(s == capacity or s & (s - 1) == 0 for s in sizes)
    done = {r.sequence_id: r for r in packing.sequences(found, 0, capacity).collect()}
    one = {r.sequence_id: r for r in got if r.offset == 0}
    assert done.keys() == one.keys() and all(done[k].ids[: len(one[k].ids)] == one[k].ids and len(done[k].ids) == 4 * done[k].length for k in done)


def test_padding_of_sequences(spark):
    parts = [(1, 3, 2, b"\x05\0\0\0\x06\0\0\0"), (1, 0, 3, b"\x02\0\0\0" * 3), (2, 0, 4, b"\x09\0\0\0" * 4)]
    frame = spark.createDataFrame([(s, o, n, bytearray(i)) for s, o, n, i in parts], "sequence_id long, offset long, length long, ids binary")
    got = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(frame, 7, 8).collect()}
    assert got == {1: [2, 2, 2, 5, 6, 7, 7, 7], 2: [9] * 4}


def test_very_long_text_and_empty_table(spark, empty):
    text = prose(random.Random(1), 200_000)
    got = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), WORDS, 2).collect()
    assert sum(r.length for r in got) == got[0].doc_tokens > 200_000 and all(r.length == 4096 or r.length & (r.length - 1) == 0 for r in got)
    assert packing.pack(empty, WORDS, 2).collect() == []
