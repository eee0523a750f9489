"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks along a random order of its rows. Its target fixes how many block
tickets it has: whole passes over all blocks, then some blocks of one more pass, the last of them in
part. A binary tree splits all tickets among the output shards: at each node the left half's share
of every source is one multivariate-hypergeometric draw, so the counts are exact at each level and
distributed as if all tickets had been shuffled together. Each shard then takes its own tickets of
each source through a permutation of ticket numbers, so no ticket is drawn twice.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewell.session import materialize

ROWS_PER_BLOCK = 500
#: Sources, and sources times shards, are read to the driver; beyond these numbers that is refused.
MOST_SOURCES = 100_000
MOST_QUOTAS = 20_000_000
SEED = 17


def words(text: Column) -> Column:
    """How many runs of characters other than ASCII white space a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is above goes to the others by weight.

    Repeating that until none is above ends where every share is ``min(cap, level * weight)``.
    """
    caps = most * sizes.astype(float)
    out, left = caps.copy(), float(total)
    order = np.argsort(caps / weights, kind="stable")
    rest = np.concatenate([np.cumsum(weights[order][::-1])[::-1], [0.0]])
    for i, s in enumerate(order):
        level = left / rest[i]
        if level * weights[s] <= caps[s]:
            out[order[i:]] = level * weights[order[i:]]
            return out
        left -= caps[s]
    return out


def splitting_tree(tickets: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Tickets of each source per shard (sources x shards); rows and columns add up exactly."""
    out = np.zeros((len(tickets), shards), np.int64)
    rng = np.random.default_rng(seed)
    stack = [(0, shards, tickets.astype(np.int64))]
    while stack:
        low, high, counts = stack.pop()
        if high - low == 1:
            out[:, low] = counts
            continue
        middle = (low + high) // 2
        size = int(counts.sum())
        take = size * (middle - low) // (high - low)
        left = rng.multivariate_hypergeometric(counts, take, method="marginals") if size else counts
        stack += [(middle, high, counts - left), (low, middle, left)]
    return out


def _step(n: int) -> int:
    """A stride near the golden section of ``n`` that shares no factor with it."""
    step = max(1, round(n * 0.6180339887))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def draw(
    docs: DataFrame,
    size: Column,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    shards: int = 16,
    source_col: str = "source",
    keys: tuple[str, ...] = ("doc_id",),
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_shards``: one shard per draw of the row.

    Sources in code-point order, null last, weigh ``weights``, repeating, and share ``share`` times
    all sizes, none above ``most`` times its own. The order of rows within a source is a hash of
    ``keys`` and the size, so reruns agree; rows equal in these are interchangeable. Columns of the
    input with a name of a result are replaced. An empty table gives an empty table.
    """
    names = ["mix_size", "mix_source_size", "mix_target", "mix_shards"]
    own = [x for x in docs.columns if x not in names]
    order = F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in keys], size)
    # The top half of the hash places a row in [0, 1) for its block, the whole hash orders it there.
    place = (F.shiftrightunsigned(order, 11).cast("double") / F.lit(float(1 << 53))).alias("__place")
    rows = docs.select(
        *[F.col(f"`{x}`") for x in own], size.cast("long").alias("mix_size"), place, F.col(f"`{source_col}`").alias("__source")
    )
    facts = materialize(rows.select("__source", "mix_size", "__place"), "sizes")
    per_source = facts.groupBy("__source").agg(F.sum("mix_size").alias("size"), F.count("*").alias("n"))
    found = per_source.orderBy(F.col("__source").asc_nulls_last()).take(MOST_SOURCES + 1)
    if len(found) > MOST_SOURCES or len(found) * shards > MOST_QUOTAS:
        raise ValueError(f"more than {MOST_SOURCES} sources, or {MOST_QUOTAS} sources x shards; group them first")
    spark = docs.sparkSession
    sizes = np.array([r["size"] for r in found], np.int64)
    weight = np.array([weights[i % len(weights)] for i in range(len(found))])
    targets = water_fill(sizes, weight, share * sizes.sum(), most) if len(found) else np.zeros(0)
    blocks = [max(1, math.ceil(r["n"] / ROWS_PER_BLOCK)) for r in found]
    passes = [int(t // s) if s else 0 for t, s in zip(targets, sizes)]
    rests = [float(t - k * s) for t, k, s in zip(targets, passes, sizes)]

    plan_type = "__source string, blocks long, passes int, rest double, mix_source_size long, mix_target double"
    plan = [(r["__source"], b, k, x, int(r["size"]), float(t)) for r, b, k, x, t in zip(found, blocks, passes, rests, targets)]
    by_source = F.broadcast(spark.createDataFrame(plan, plan_type))  # bounded by MOST_SOURCES

    def blocked(df, other):
        same = df["__source"].eqNullSafe(other["__source"])
        return df.join(other, same).drop(other["__source"]).withColumn("__block", F.floor(F.col("__place") * F.col("blocks")))

    # Where the last pass of each source ends: the first block whose running total passes the rest.
    sums = blocked(facts, by_source).groupBy("__source", "__block").agg(F.sum("mix_size").alias("words"), F.first("rest").alias("rest"))
    running = F.sum("words").over(Window.partitionBy("__source").orderBy("__block"))
    ends = (
        sums.withColumn("until", running)
        .where("until > rest")
        .groupBy("__source")
        .agg(F.min("__block").alias("cut"), F.min(F.col("until") - F.col("words")).alias("before"))
    )
    end = {r["__source"]: (r["cut"], float(r["before"])) for r in ends.take(MOST_SOURCES)}
    cuts = [end.get(r["__source"], (b, 0.0)) for r, b in zip(found, blocks)]
    tickets = np.array([k * b + c + (x > 0) for k, b, (c, _), x in zip(passes, blocks, cuts, rests)], np.int64)
    until = np.cumsum(splitting_tree(tickets, shards, seed), axis=1).tolist() if len(found) else []
    steps = [_step(max(1, int(t))) for t in tickets]
    drawn = [
        (*p, int(c), x - b, max(1, int(t)), s, u) for p, (c, b), x, t, s, u in zip(plan, cuts, rests, tickets, steps, until)
    ]
    drawn_type = plan_type + ", cut long, part double, tickets long, stride long, until array<long>"
    quotas = F.broadcast(spark.createDataFrame(drawn, drawn_type))  # bounded by MOST_QUOTAS

    placed = blocked(rows, quotas)
    # Only the one block a source ends in is ordered; a row is in while its middle is before the end.
    edge = Window.partitionBy("__source", "__block").orderBy("__place")
    at_edge = F.col("__block") == F.col("cut")
    inside = placed.where(at_edge).withColumn(
        "__last", F.sum("mix_size").over(edge.rowsBetween(Window.unboundedPreceding, 0)) - F.col("mix_size") / 2 <= F.col("part")
    )
    outside = placed.where(~at_edge).withColumn("__last", F.col("__block") < F.col("cut"))
    numbers = "transform(filter(sequence(0, passes), p -> p < passes OR __last), p -> p * blocks + __block)"
    shard = f"transform({numbers}, t -> cast(size(filter(until, u -> u <= (t * stride) % tickets)) AS int))"
    return inside.union(outside).select(
        *[F.col(f"`{x}`") for x in own], "mix_size", "mix_source_size", "mix_target", F.expr(shard).alias("mix_shards")
    )


def mixed(docs: DataFrame, size: Column, shards: int = 16, seed: int = SEED, **options) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, with ``mix_shard``; shuffled within each shard."""
    taken = draw(docs, size, shards=shards, seed=seed, **options)
    rows = taken.select(*[F.col(f"`{x}`") for x in docs.columns], F.posexplode("mix_shards").alias("__nth", "mix_shard"))
    keys = [F.col(f"`{k}`") for k in options.get("keys", ("doc_id",))]
    # A shard is spread over many tasks by a hash, each of them in random order.
    order = F.xxhash64(F.lit(seed + 1), "__nth", *keys)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.withColumn("__order", order)
        .repartition(n, "mix_shard", "__order")
        .sortWithinPartitions("mix_shard", "__order")
        .drop("__order", "__nth")
    )
