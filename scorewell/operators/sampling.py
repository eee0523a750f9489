"""Samples, splits and folds decided by a hash of the row key.

A row's place in a random order is its key hash, so the same rows are taken on every rerun, in
any engine and under any partitioning. Exact sizes come from the hash value at a given rank, found
from two small aggregations; the rows themselves are only filtered, never sorted or moved.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.functions.exprs import HASH_BITS, c, count_if, key_hash

SEED = 42
MAX_CLASSES = 200
#: Groups that one step of the search for ranks makes at most, and so the rows it reads to the driver.
MOST_GROUPS = 65_536
HASH_END = 1 << HASH_BITS


def class_sizes(df: DataFrame, by: str | None) -> dict:
    """Rows per class; a column with too many values to be a class label is refused."""
    if by is None:
        return {None: df.count()}
    rows = df.groupBy(c(by).alias("k")).agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{by!r} has more than {MAX_CLASSES} values: not a class column")
    return {row["k"]: row["n"] for row in rows}


def hash_at_ranks(
    df: DataFrame, keys: Sequence[str], ranks: dict[object, list[int]], sizes: dict, by: str | None, seed: int = SEED
) -> dict[object, list[int]]:
    """Per class and rank, a cut: the rows whose key hash is at most the cut are the first ``rank`` rows in hash order.

    Rows are counted by the leading bits of their hash, and each next step looks only at the intervals that hold a
    rank, with more bits, until whole hashes are counted. No step makes more than ``MOST_GROUPS`` groups, however
    often a key is there. Rows with equal keys are taken or left together, so with repeated keys a part can be smaller.
    """
    cuts: dict[object, list[int]] = {k: [-1 if r <= 0 else HASH_END for r in rs] for k, rs in ranks.items()}
    classes = list(ranks)
    # (number of the class, place in its list, rank) -> leading bits of the interval that holds the rank, rows before and inside it.
    todo = {(j, i, r): (0, 0, sizes[k]) for j, (k, rs) in enumerate(ranks.items()) for i, r in enumerate(rs) if 0 < r < sizes[k]}
    label = c(by) if by else F.lit(None).cast("string")
    hashed = df.select(key_hash(keys, seed).alias("h"), label.alias("k"))
    kind, shift = hashed.schema["k"].dataType.simpleString(), HASH_BITS
    while todo and shift:
        inside = {(j, prefix): n for (j, _, _), (prefix, _, n) in todo.items()}
        # Few rows are counted by their whole hash at once.
        whole = sum(inside.values()) <= MOST_GROUPS
        finer = 0 if whole else max(0, shift - max(1, (MOST_GROUPS // len(inside)).bit_length() - 1))
        known = df.sparkSession.createDataFrame([(classes[j], j, p) for j, p in inside], f"__k {kind}, j int, __prefix long")
        here = F.col("k").eqNullSafe(F.col("__k")) & (F.shiftright("h", shift) == F.col("__prefix"))
        rows = hashed.join(F.broadcast(known), here)  # one row per class and rank at most
        counts: dict[tuple, list[tuple[int, int]]] = {}
        for row in rows.groupBy("j", F.shiftright("h", finer).alias("p")).agg(F.count("*").alias("n")).collect():
            counts.setdefault((row["j"], row["p"] >> (shift - finer)), []).append((row["p"], row["n"]))
        ends = {}
        for place, found in counts.items():
            found.sort()
            ends[place] = list(accumulate(n for _, n in found))
        for key, (prefix, below, _) in todo.items():
            found, until = counts[key[0], prefix], ends[key[0], prefix]
            at = bisect.bisect_left(until, key[2] - below)
            todo[key] = (found[at][0], below + until[at] - found[at][1], found[at][1])
        shift = finer
    for (j, i, rank), (h, below, count) in todo.items():
        # A hash whose rows do not all fit stays out as a whole.
        cuts[classes[j]][i] = h if below + count <= rank else h - 1
    return cuts


def _per_class(by: str | None, values: dict[object, object], build: Callable[[object], Column]) -> Column:
    """``build(value of the row's class)``; a single expression when there is one class."""
    if by is None:
        return build(values[None])
    out = None
    for k, v in values.items():
        cond = c(by).eqNullSafe(F.lit(k))
        out = F.when(cond, build(v)) if out is None else out.when(cond, build(v))
    return out if out is not None else F.lit(None)


def take_per_class(
    df: DataFrame, keys: Sequence[str], quotas: dict[object, int], sizes: dict, by: str | None, seed: int = SEED
) -> Column:
    """True for exactly ``quota`` rows of each class: those with the smallest key hashes."""
    cuts = hash_at_ranks(df, keys, {k: [q] for k, q in quotas.items()}, sizes, by, seed)
    h = key_hash(keys, seed)
    return _per_class(by, {k: v[0] for k, v in cuts.items()}, lambda cut: h <= F.lit(cut))


def uniform_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows (or all), the same on every run."""
    sizes = class_sizes(df, None)
    if sizes[None] <= n:
        return df
    return df.where(take_per_class(df, keys, {None: n}, sizes, None, seed))


def stratified_sample(df: DataFrame, max_rows: int, keys: Sequence[str], by: str | None, seed: int = SEED) -> DataFrame:
    """At most ``max_rows`` rows with the class shares kept; a plain sample without a class column. A column of
    more than ``MAX_CLASSES`` values is refused."""
    if by is None or by not in df.columns:
        return uniform_sample(df, max_rows, keys, seed)
    sizes = class_sizes(df, by)
    total = sum(sizes.values())
    if total <= max_rows:
        return df
    known = {k: n for k, n in sizes.items() if k is not None}
    quotas = {k: max(1, max_rows * n // total) for k, n in known.items()}
    while sum(quotas.values()) > max_rows:
        quotas[max(quotas, key=lambda k: (quotas[k], str(k)))] -= 1
    return df.where(take_per_class(df, keys, quotas, known, by, seed))


def stratified_split(
    df: DataFrame, keys: Sequence[str], by: str, test_size: float = 0.2, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ``test_size`` of each class, rounded per class, in the test part."""
    marked = mark_split(df, keys, by, {"test": test_size}, seed)
    return marked.where(F.col("split") == "train").drop("split"), marked.where(F.col("split") == "test").drop("split")


def mark_split(
    df: DataFrame, keys: Sequence[str], by: str, shares: dict[str, float], seed: int = SEED
) -> DataFrame:
    """Add ``split``: each named part takes its share of every class, the rest is ``train``."""
    sizes = {k: n for k, n in class_sizes(df, by).items() if k is not None}
    ends = {k: [] for k in sizes}
    for k, n in sizes.items():
        done = 0.0
        for share in shares.values():
            done += share
            ends[k].append(int(math.floor(n * done + 0.5)))
    cuts = hash_at_ranks(df, keys, ends, sizes, by, seed)
    h = key_hash(keys, seed)

    def part(edges: list[int]) -> Column:
        out = F.lit("train")
        for name, edge in reversed(list(zip(shares, edges))):
            out = F.when(h <= F.lit(edge), F.lit(name)).otherwise(out)
        return out

    return df.withColumn("split", _per_class(by, cuts, part)).where(F.col("split").isNotNull())


def stratified_folds(df: DataFrame, keys: Sequence[str], by: str, k: int = 3, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0..k-1: every class is dealt to the folds in equal shares, give or take a row."""
    sizes = {label: n for label, n in class_sizes(df, by).items() if label is not None}
    ends = {label: [n * j // k for j in range(1, k)] for label, n in sizes.items()}
    cuts = hash_at_ranks(df, keys, ends, sizes, by, seed)
    h = key_hash(keys, seed)

    def fold(edges: list[int]) -> Column:
        return sum(((h > F.lit(edge)).cast("int") for edge in edges), F.lit(0))

    return df.withColumn("fold", _per_class(by, cuts, fold)).where(F.col("fold").isNotNull())
