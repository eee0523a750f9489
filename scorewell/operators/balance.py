"""Class weights and synthetic minority rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.functions.exprs import HASH_SPACE, c, key_hash
from scorewell.operators.neighbours import BLOCK_ROWS, CELL_ROWS, nearest_neighbours
from scorewell.operators.sampling import class_sizes, hash_at_ranks

NEIGHBOURS = 5
COPIES_PER_ROW = 1_000


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(class, n, weight): rows / (classes x rows of the class)."""
    counts = df.where(c(label).isNotNull()).groupBy(c(label).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("k")).alias("t")).scalar()
    weight = total.getField("rows") / (total.getField("k") * F.col("n"))
    return counts.select("class", "n", weight.alias("weight"))


def balanced_weight(df: DataFrame, label: str) -> Column:
    """The balanced class weight as an expression over ``label``, for a weight column."""
    sizes = {k: n for k, n in class_sizes(df, label).items() if k is not None}
    total = sum(sizes.values())
    out = F.lit(1.0)
    for k, n in sizes.items():
        out = F.when(c(label) == F.lit(k), F.lit(total / (len(sizes) * n))).otherwise(out)
    return out


def scale_pos_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive."""
    pos, neg = F.sum((c(label) == 1).cast("long")), F.sum((c(label) == 0).cast("long"))
    return df.agg(F.try_divide(neg.cast("double"), pos.cast("double")).alias("scale_pos_weight"))


def smote(
    df: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    minority: object = None,
    k: int = NEIGHBOURS,
    seed: int = 42,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Training rows plus synthetic minority rows until the two classes are equal.

    A synthetic row lies at a random place on the line from a minority row to one of its ``k``
    nearest minority neighbours. Every base row gives the same number of them, the remainder goes
    to the rows first in hash order. Neighbour and place come from a hash of (row, copy number),
    so reruns give the same rows. Output: (key, label, features, synthetic), key null when made up.
    """
    sizes = {v: n for v, n in class_sizes(df, label).items() if v is not None}
    if len(sizes) != 2:
        raise ValueError(f"expected two classes, found {len(sizes)}")
    if minority is None:
        minority = min(sizes, key=lambda v: (sizes[v], str(v)))
    n_min = sizes[minority]
    needed = sum(sizes.values()) - 2 * n_min
    original = df.select(
        c(key).cast("long").alias(key), c(label).alias(label), *[c(f).cast("double").alias(f) for f in features],
        F.lit(False).alias("synthetic"),
    )
    if needed <= 0:
        return original
    if n_min <= k:
        raise ValueError(f"{n_min} minority rows are too few for {k} neighbours")
    vectors = original.where(c(label) == F.lit(minority)).select(
        c(key).alias("key"), F.array(*[c(f) for f in features]).alias("vec")
    )
    pairs = nearest_neighbours(vectors, "key", "vec", k, cell_rows, block_rows)
    made = _between(vectors, pairs, needed, n_min, k, seed)
    dtype = df.schema[label].dataType
    synthetic = made.select(
        F.lit(None).cast("long").alias(key),
        F.lit(minority).cast(dtype).alias(label),
        *[F.col("vec")[i].alias(f) for i, f in enumerate(features)],
        F.lit(True).alias("synthetic"),
    )
    return original.unionByName(synthetic)


def _between(vectors: DataFrame, pairs: DataFrame, needed: int, n_min: int, k: int, seed: int) -> DataFrame:
    """``vec`` of the synthetic rows. Every minority row first gathers its own ``k`` neighbours'
    vectors, so that nothing has to be joined once the copies have been made."""
    to = vectors.select(F.col("key").alias("neighbour"), F.col("vec").alias("to_vec"))
    around = pairs.join(to, "neighbour").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "to_vec"))).alias("around")
    )
    per_row, left_over = divmod(needed, n_min)
    first = hash_at_ranks(vectors, ["key"], {None: [left_over]}, {None: n_min}, None, seed)[None][0]
    copies = F.lit(per_row) + (key_hash(["key"], seed) <= F.lit(first)).cast("long")
    based = vectors.join(around, "key").withColumn("copies", copies).where(F.col("copies") > 0)
    # Two steps, so that a row with very many copies is spread over tasks before it grows.
    chunks = based.withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_PER_ROW)))
    )
    spread = chunks.repartition("key", "chunk") if per_row > COPIES_PER_ROW else chunks
    start = F.col("chunk") * COPIES_PER_ROW
    numbered = spread.withColumn(
        "copy", F.explode(F.sequence(start, F.least(start + COPIES_PER_ROW, F.col("copies")) - 1))
    )
    # Draws are hashes of (row, copy): one picks the neighbour, one the place on the line.
    drawn = numbered.select(
        "vec",
        F.col("around")[F.pmod(key_hash(["key", "copy"], seed + 1), F.lit(k)).cast("int")]["to_vec"].alias("to_vec"),
        (key_hash(["key", "copy"], seed + 2).cast("double") / F.lit(HASH_SPACE)).alias("place"),
    )
    return drawn.select(F.expr("zip_with(vec, to_vec, (a, b) -> a + place * (b - a)) AS vec"))
