"""Quality filter: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, each code point a sign of its own, up to order 4. Counts of n-grams, of their contexts, of what precedes
and follows them are joined in shards by n-gram; the n-grams that occur in the documents are then
looked up in the model by such joins, order after order. Each order has its three discounts, from
its counts of counts. The results, one number per occurring n-gram, lie in the shared folder as shards of bounded size, which
the tasks that read the texts go through one after another; nothing of them passes the driver, and their number grows with the corpus.

A document's score is its mean negative log-probability per character. Documents go when their score is
above their language's limit, which is read off the quantiles of the trusted documents' scores, by more than
chance explains for their length.
"""

from __future__ import annotations

import io
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm import token_shards
from scorewell.llm.batches import slices
from scorewell.operators.duplicates import split_by_filter
from scorewell.session import few_files, fresh_path, materialize

ORDER = 4
#: Bits of a code: 0 for what stands before a text, else a code point and one.
CODE_BITS = 21
MASK = (1 << CODE_BITS) - 1
#: Code points there are.
CLASSES = 0x110000
#: A language's limit: its median score plus REACH times the distance from there to the HIGH quantile.
HIGH, REACH = 0.95, 3.0
#: The mean over n characters strays by about 1 / sqrt(n): so much, times SLACK, a text may be above the limit.
SLACK = 2.0
#: Documents of fewer characters than this say too little to be judged; they stay.
LEAST_CHARS = 20
CHARS_AT_ONCE = 1 << 21
#: Up to so many different values are ranked by a table, more by sorting.
DENSE = 1 << 24
#: N-grams of a shard, and shards that a process keeps.
SHARD_GRAMS, SHARDS_KEPT = 1 << 21, 8


def class_codes(text: str) -> np.ndarray:
    """Codes of a text's characters, after ORDER - 1 places of code 0 that stand for its start."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(len(points) + ORDER - 1, np.uint32)
    out[ORDER - 1 :] = points + 1
    return out


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the place of each value among them."""
    top = int(values.max()) + 1 if len(values) else 0
    if top > DENSE:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(top, bool)
    seen[values] = True
    found = np.flatnonzero(seen)
    place = np.zeros(top, np.int32)
    place[found] = np.arange(len(found), dtype=np.int32)
    return found, place[values]


def ngrams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of order ORDER of texts' codes, as their first and last two codes, and which of them ends at each character."""
    codes = np.concatenate(texts)
    inside = np.ones(len(codes), bool)
    ends = np.cumsum([len(x) for x in texts])
    for i in range(1, ORDER):
        inside[ends - i] = False
    # Places among what occurs keep the numbers small enough for tables; they are told back at the end.
    letters, of = _ranks(codes)
    two, of = _ranks(of[:-1].astype(np.int64) * len(letters) + of[1:])
    pairs = (letters[two // len(letters)].astype(np.int64) << CODE_BITS) | letters[two % len(letters)]
    at = np.flatnonzero(inside)
    four, of = _ranks(of[at].astype(np.int64) * len(two) + of[at + 2])
    return pairs[four // len(two)], pairs[four % len(two)], of


def _pieces(texts: list[str]):
    """``ngrams`` of several texts at once and each text's characters, some millions of characters at a time."""
    codes, total = [], 0
    for text in texts:
        codes.append(class_codes(text))
        total += len(codes[-1])
        if total >= CHARS_AT_ONCE:
            yield *ngrams(codes), np.array([len(x) - ORDER + 1 for x in codes])
            codes, total = [], 0
    if codes:
        yield *ngrams(codes), np.array([len(x) - ORDER + 1 for x in codes])


def count_ngrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n long): the n-grams of order ORDER, as a struct of two codes each, and how often they occur; folded per task, then summed."""

    def run(batches):
        for batch in slices(batches):
            for hi, lo, of, _ in _pieces([x or "" for x in batch.column(0).to_pylist()]):
                n = np.bincount(of, minlength=len(hi)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(n)], ["hi", "lo", "n"])

    counted = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "hi long, lo long, n long")
    return counted.groupBy("hi", "lo").agg(F.sum("n").alias("n")).select(F.struct("hi", "lo").alias("gram"), "n")


def _last(order: int) -> list:
    """The last ``order`` codes of ``hi`` and ``lo``."""
    hi = F.col("hi") if order == 4 else F.col("hi").bitwiseAND(MASK) if order == 3 else F.lit(0).cast("long")
    return [hi.alias("hi"), (F.col("lo") if order > 1 else F.col("lo").bitwiseAND(MASK)).alias("lo")]


def _context(hi: str, lo: str) -> list:
    """All codes of an n-gram but its last."""
    return [
        F.shiftright(hi, CODE_BITS).alias("c_hi"),
        F.shiftright(lo, CODE_BITS).bitwiseOR(F.shiftleft(F.col(hi).bitwiseAND(MASK), CODE_BITS)).alias("c_lo"),
    ]


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of once, twice and more often seen n-grams, from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    row = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(row[f"n{i}"] or 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return tuple(min(max(d, 0.01), k + 0.99) for k, d in enumerate(raw))


class Model:
    """Per order: seen n-grams with discounted share, and contexts with the weight they leave to the order below."""

    def __init__(self, top: DataFrame, files: int | None = None):
        """``top``: (gram, n) of order ORDER. ``files`` bounds the files of each table."""
        self.levels: list[tuple[DataFrame, DataFrame]] = []  # order 1 first
        counts = materialize(top.select("gram.hi", "gram.lo", "n"), "grams", files)
        for order in range(ORDER, 0, -1):
            d1, d2, d3 = _discounts(counts)
            cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            totals = (
                counts.select(*_context("hi", "lo"), "n", cut.alias("cut")).groupBy("c_hi", "c_lo")
                .agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
                .select("c_hi", "c_lo", "total", (F.col("freed") / F.col("total")).alias("left"))
            )
            shares = counts.select("hi", "lo", "n", *_context("hi", "lo")).join(totals, ["c_hi", "c_lo"])
            shares = shares.select("hi", "lo", ((F.col("n") - cut) / F.col("total")).alias("share"))
            self.levels.insert(0, (materialize(shares, "shares", files), materialize(totals.select("c_hi", "c_lo", "left"), "left", files)))
            # The order below counts in how many different ways an n-gram is preceded.
            if order > 1:
                counts = materialize(counts.select(*_last(order - 1)).groupBy("hi", "lo").agg(F.count("*").alias("n")), "grams", files)

    def score(self, grams: DataFrame) -> DataFrame:
        """(gram, logp) for distinct n-grams of order ORDER, seen in training or not."""
        out = grams.select("gram", F.lit(1.0 / CLASSES).alias("p"))
        for order, (shares, left) in enumerate(self.levels, 1):
            keyed = out.select("gram", "p", "gram.hi", "gram.lo").select("gram", "p", *_last(order))
            keyed = keyed.select("*", *_context("hi", "lo")).join(left, ["c_hi", "c_lo"], "left").join(shares, ["hi", "lo"], "left")
            # A context that was never seen leaves everything to the order below.
            value = F.coalesce("share", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("p")
            out = keyed.select("gram", value.alias("p"))
        return out.select("gram", F.log("p").alias("logp"))


def write_scores(scored: DataFrame) -> list[str]:
    """Files of ``scored`` (gram, logp) in the shared folder, each with some of the n-grams, sorted."""
    folder = fresh_path(scored.sparkSession, "kn")
    n = max(1, math.ceil(scored.count() / SHARD_GRAMS))

    def write(key, table):
        hi, lo = (table.column(x).to_numpy() for x in ("hi", "lo"))
        order = np.lexsort((lo, hi))
        data = io.BytesIO()
        np.savez(data, hi=hi[order], lo=lo[order], logp=table.column("logp").to_numpy()[order].astype(np.float32))
        token_shards._save(f"{folder}/{key[0].as_py()}.npz", data.getvalue())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64())})

    flat = scored.select("gram.hi", "gram.lo", "logp").withColumn("shard", F.expr(f"pmod(xxhash64(hi, lo), {n}L)"))
    found = flat.groupBy("shard").applyInArrow(write, "shard long").collect()  # one number per file
    return sorted(f"{folder}/{r.shard}.npz" for r in found)


@lru_cache(SHARDS_KEPT)
def _scores(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First halves, place of the first half and last half as one number, and values of a file's n-grams."""
    held = np.load(io.BytesIO(token_shards._load(path)))
    first, at = np.unique(held["hi"], return_inverse=True)
    return first, (at.astype(np.int64) << 2 * CODE_BITS) | held["lo"], held["logp"]


def _looked_up(files: list[str], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hi), np.float64)
    for path in files:
        first, keys, logp = _scores(path)
        at = np.minimum(np.searchsorted(first, hi), len(first) - 1)
        key = np.where(first[at] == hi, (at << 2 * CODE_BITS) | lo, -1)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        # An n-gram is in one file.
        out += np.where(keys[place] == key, logp[place], 0.0)
    return out


def perplexities(docs: DataFrame, scored: DataFrame | list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with ``kn_chars`` and ``kn_score`` (mean negative log-probability per character; null without any).

    ``scored``: (gram, logp) for all n-grams of the texts, or the files that ``write_scores`` made of them.
    """
    files = scored if isinstance(scored, list) else write_scores(scored)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            sums, sizes = [], []
            for hi, lo, of, size in _pieces([x or "" for x in batch.column(at).to_pylist()]):
                cost = np.concatenate([[0.0], np.cumsum(_looked_up(files, hi, lo)[of])])
                ends = np.cumsum(size)
                sums.append(cost[ends - size] - cost[ends])
                sizes.append(size)
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            total = np.concatenate(sums) if sums else np.zeros(0)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), mean], [*batch.schema.names, "kn_chars", "kn_score"])

    kept = docs.drop("kn_chars", "kn_score")
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", kn_chars long, kn_score double"
    return kept.mapInArrow(run, schema)


def limits(scores: DataFrame, lang_col: str = "lang", high: float = HIGH, reach: float = REACH) -> DataFrame:
    """(lang, kn_limit) from the scores of trusted documents (columns ``lang``, ``kn_score``); all languages under null."""
    quantiles = F.percentile_approx("kn_score", F.array(F.lit(0.5), F.lit(high)), F.lit(10_000))
    limit = (F.col("q")[0] + reach * (F.col("q")[1] - F.col("q")[0])).alias("kn_limit")
    rows = scores.where("kn_score IS NOT NULL")
    own = rows.where(F.col(lang_col).isNotNull()).groupBy(lang_col).agg(quantiles.alias("q"))
    every = rows.agg(quantiles.alias("q")).where("q IS NOT NULL").select(F.lit(None).cast("string").alias(lang_col), "q")
    return own.union(every).select(lang_col, limit)


def _trusted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str) -> DataFrame:
    """(lang, text) of the documents that ``labels`` trusts.

    A filter of bounded size passes by the documents that have no such label; only the others' texts are shuffled to be
    joined in full. The plan is the same at every size.
    """
    said = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__least"))
    good = materialize(said.where("__least = 1 AND __id IS NOT NULL").select("__id"), "trusted_ids", few_files(docs.sparkSession, labels.count()))
    n_good = good.count()
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__doc"), F.col(lang_col).cast("string").alias("lang"), text_col)
    _, likely = split_by_filter(slim, F.xxhash64("__doc"), good.select(F.xxhash64("__id").alias("number")), max(n_good, 1))
    exact = likely.join(good.hint("shuffle_merge"), likely["__doc"] == good["__id"], "left_semi")
    return materialize(exact.select("lang", text_col), "trusted", few_files(docs.sparkSession, n_good))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "quality",
    high: float = HIGH,
    reach: float = REACH,
) -> DataFrame:
    """``docs`` with ``kn_score`` (log-perplexity per character), ``kn_limit`` and ``kn_keep``.

    Trusted are the documents of which ``labels`` holds a 1 and no 0. A language without trusted documents, or null,
    has the limit of all. Texts that are null or shorter than LEAST_CHARS are kept: there is too little to judge.
    Without any trusted text all are kept. Repeated rows get the same verdict; an empty table stays empty.
    """
    own = [x for x in docs.columns if x not in ("kn_score", "kn_limit", "kn_keep", "kn_chars")]
    docs = docs.select(*[F.col(f"`{x}`") for x in own])
    trusted = _trusted(docs, labels, id_col, text_col, lang_col, label_col)
    spark = docs.sparkSession
    model = Model(count_ngrams(trusted, text_col), few_files(spark, trusted.count()))
    scored = model.score(count_ngrams(docs.select(text_col), text_col).select("gram"))
    scored = write_scores(materialize(scored, "scored", few_files(spark, docs.count())))
    # Only what is trusted has to be scored for the limits.
    scores = materialize(perplexities(trusted, scored, text_col).drop(text_col), "scores")
    found = limits(scores, "lang", high, reach)
    by_lang = {r["lang"]: r["kn_limit"] for r in found.collect()}  # one row per language
    return judged(docs, scored, by_lang, text_col, lang_col)


def judged(docs, scored, by_lang, text_col="text", lang_col="lang"):
    """Scores against the limits of the languages, in one more reading of the texts."""
    limit = F.lit(by_lang.get(None))
    for lang, value in by_lang.items():
        if lang is not None:
            limit = F.when(F.col(lang_col) == lang, F.lit(value)).otherwise(limit)
    out = perplexities(docs, scored, text_col)
    slack = SLACK / F.sqrt("kn_chars")
    fine = (F.col("kn_chars") < LEAST_CHARS) | F.col("kn_limit").isNull() | (F.col("kn_score") <= F.col("kn_limit") + slack)
    return out.withColumn("kn_limit", limit.cast("double")).withColumn("kn_keep", F.coalesce(fine, F.lit(True))).drop("kn_chars")
