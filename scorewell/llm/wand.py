"""Benchmark decontamination: BM25 retrieval of test items for every training passage, with block-max WAND.

The test items are indexed: per word the items that hold it with their BM25 weights, as shares of the score that
retrieves the item, so that one threshold (1) serves all items. Each word also has its greatest weight over each
block of items. Passages are two half-windows; the greatest weights of the distinct words of both are summed
per block, and only blocks that reach the threshold so have their items scored, word by word. The
bound is never below the score, so every item at or above the threshold is retrieved.

Items that were retrieved are verified: the shares of the five-word shingles of their question (all sentences but the
last) and of their answer (the last one) that stand in the passage.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.batches import slices
from scorewell.session import materialize

K1, B = 1.2, 0.75
#: An item is retrieved at this share of the score that its own text would get. An item four fifths of whose shingles
#: of five words are there has nearly all of its words there.
THRESHOLD = 0.75
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 8
#: An index of about so many items is sent to every task; a larger benchmark makes several, each for its own reading of
#: the texts. Weights are kept as one table of words by items, some tens of megabytes at most.
ITEMS_PER_INDEX = 1_000

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    k = min(SHINGLE, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


@dataclass
class Index:
    ids: list[int]
    question: list[set]
    answer: list[set]
    vocabulary: dict[str, int]
    window: int
    weights: np.ndarray  # per word and item
    most: np.ndarray  # greatest weight per word and block


def build_index(
    rows: list[tuple[int, str | None]], threshold: float = THRESHOLD, totals: tuple[int, int] | None = None, holders: dict[str, int] | None = None
) -> Index | None:
    """Index of (item id, text); items without words are left out. None when none has any.

    ``totals`` are the items with words and their words with repeats, ``holders`` the items that have a word, of the whole benchmark where
    ``rows`` are only a part of it.
    """
    kept = [(i, t, words_of(t)) for i, t in rows if words_of(t)]
    if not kept:
        return None
    spread: dict[str, int] = {}
    for _, _, words in kept:
        for w in set(words):
            spread[w] = spread.get(w, 0) + 1
    # Items with the same everyday words (one language) and of like length share blocks: that keeps bounds low.
    kept.sort(key=lambda r: (max((spread[w], w) for w in r[2]), len(r[2]), r[2], r[0]))
    counts = []
    for _, _, words in kept:
        tf: dict[str, int] = {}
        for w in words:
            tf[w] = tf.get(w, 0) + 1
        counts.append(tf)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for tf in counts for w in tf))}
    holders = holders or spread
    n, length = totals or (len(kept), sum(len(r[2]) for r in kept))
    mean = length / n
    idf = {w: math.log(1 + (n - holders[w] + 0.5) / (holders[w] + 0.5)) for w in vocabulary}
    weights = np.zeros((len(vocabulary), math.ceil(len(kept) / BLOCK) * BLOCK), np.float32)
    for item, ((_, _, words), tf) in enumerate(zip(kept, counts)):
        norm = K1 * (1 - B + B * len(words) / mean)
        weight = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
        own = threshold * sum(weight.values())
        weights[[vocabulary[w] for w in weight], item] = np.array(list(weight.values())) / own
    most = weights.reshape(len(vocabulary), -1, BLOCK).max(axis=2)
    question, answer = [], []
    for _, text, words in kept:
        last = words_of(SENTENCE.split(text.strip())[-1])
        question.append(shingles(words[: len(words) - len(last)]))
        answer.append(shingles(last))
    return Index([r[0] for r in kept], question, answer, vocabulary, 2 * max(len(r[2]) for r in kept), weights, most)


def retrieve(index: Index, words: list[str]) -> dict[int, float]:
    """Greatest score over the passages of a text for each item (by place in the index) that reaches the threshold.

    Passages are ``window`` words long and start half a window apart, so any run of words as long as the longest item
    lies within one.
    """
    known = index.vocabulary.get
    ids = np.array([known(w, -1) for w in words], np.int64)
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return {}
    # Each word once per half-window, in order of the halves.
    keys = np.unique((at // (index.window // 2)) * len(index.most) + ids[at])
    half, term = np.divmod(keys, len(index.most))
    starts = np.flatnonzero(np.diff(half, prepend=-1))
    bounds = np.zeros((int(half[-1]) + 2, index.most.shape[1]), np.float32)
    bounds[half[starts]] = np.add.reduceat(index.most[term], starts, axis=0)
    limit = 1 - 1e-4  # sums of single-precision shares
    found: dict[int, float] = {}
    open_blocks = bounds[:-1] + bounds[1:] >= limit
    for window in np.flatnonzero(open_blocks.any(axis=1)).tolist():
        low, high = np.searchsorted(half, (window, window + 2))
        terms = np.unique(term[low:high])
        blocks = np.flatnonzero(open_blocks[window])
        items = (blocks[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
        scores = index.weights[terms[:, None], items].sum(axis=0)
        for i in np.flatnonzero(scores >= limit).tolist():
            item = int(items[i])
            found[item] = max(found.get(item, 0.0), float(scores[i]))
    return found


def verify(index: Index, item: int, held: set) -> tuple[float, float, float]:
    """Shares of the question's, the answer's and all of their shingles among ``held`` (an empty part counts as there)."""
    parts = [index.question[item], index.answer[item]]
    common = [len(p & held) for p in parts]
    q, a = [c / len(p) if p else 1.0 for c, p in zip(common, parts)]
    return q, a, sum(common) / sum(map(len, parts))


LEAK = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])


def leaks_of(index: Index, text: str | None, threshold: float, overlap: float) -> list[dict]:
    words = words_of(text)
    scores = retrieve(index, words) if words else {}
    out = []
    for item, score in sorted(scores.items(), key=lambda x: index.ids[x[0]]):
        sizes = {len(next(iter(p))) for p in (index.question[item], index.answer[item]) if p}
        held = {tuple(words[i : i + k]) for k in sizes for i in range(len(words) - k + 1)}
        q, a, both = verify(index, item, held)
        if both >= overlap:
            out.append({"item_id": index.ids[item], "score": score * threshold, "question": q, "answer": a})
    return out


def word_facts(items: DataFrame) -> tuple[tuple[int, int], DataFrame]:
    """Of items (part, text): the number with words and of all words, and (part, word, n): the items of all parts that hold a word of the part."""

    def split(batches):
        for batch in slices(batches):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            distinct = pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, words)), pa.int64()), distinct], ["part", "length", "words"])

    listed = items.select("part", "text").mapInArrow(split, "part long, length long, words array<string>")
    listed = materialize(listed.where("length > 0"), "items")
    n, length = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    places = listed.select("part", F.explode("words").alias("word"))
    spread = places.groupBy("word").agg(F.count("*").alias("n"))
    return (n, length), materialize(places.distinct().join(spread, "word").select("part", "word", "n"), "words")


def with_leaks(
    docs: DataFrame,
    items: DataFrame,
    item_col: str = "item_id",
    item_text: str = "text",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
) -> DataFrame:
    """``docs`` with ``leaks``: for each test item that the whole text holds, its id, best BM25 share, and overlaps.

    A null or empty text holds none; items without words are never held; items that repeat are each reported; an empty
    benchmark leaves all documents clean. A column of the input named ``leaks`` is replaced.
    """
    own = docs.select(*[F.col(f"`{x}`") for x in docs.columns if x != "leaks"])
    rows = items.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text"))
    groups = max(1, math.ceil(rows.count() / ITEMS_PER_INDEX))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(groups)))
    totals, facts = word_facts(rows)
    schema = ", ".join(f"`{n}` {t}" for n, t in own.dtypes)
    leak = "array<struct<item_id: bigint, score: double, question: double, answer: double>>"
    out, added = own, []
    for g in range(groups):
        part, words = rows.where(F.col("part") == g).toArrow(), facts.where(F.col("part") == g).toArrow()
        holders = dict(zip(words.column("word").to_pylist(), words.column("n").to_pylist()))
        index = build_index(list(zip(part.column("id").to_pylist(), part.column("text").to_pylist())), threshold, totals, holders)
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most about ITEMS_PER_INDEX items
        name, at = f"__leaks{g}", own.columns.index(text_col)

        def run(batches, shared=shared, name=name, at=at):
            index = shared.value
            for batch in slices(batches):
                texts = batch.column(at).to_pylist()
                found = [leaks_of(index, t, threshold, overlap) if index else [] for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(LEAK))], [*batch.schema.names, name])

        schema += f", `{name}` {leak}"
        out = out.mapInArrow(run, schema)
        added.append(name)
    return out.withColumn("leaks", F.concat(*added)).drop(*added)
