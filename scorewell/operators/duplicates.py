"""Equal rows once, without moving the rows that have no equal.

Every row has a 64-bit fingerprint, cut to a part and 32 bits within it; the parts are so many that strangers in one part rarely share the
32 bits. Tasks fold their rows' numbers, four bytes for each distinct one, and a part's numbers meet in one task, which names those
that occur twice. They become a Bloom filter of bounded size, which is broadcast. Rows it does not hold have no equal and pass by; only the others
are shuffled and compared in full, so a false alarm costs a shuffled row and never a lost one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.functions.exprs import c, nan_to_null
from scorewell.session import few_files, materialize

ROWS_PER_PART = 1 << 20
ROWS_AT_ONCE = 1 << 22
FILTER_WORDS = 1 << 21  # of 64 bits: with its keys about 64 MB where it is broadcast
BITS_PER_KEY = 16


def _numbers(df: DataFrame, parts: int) -> Column:
    """Part and 32 bits of each row's fingerprint in one long."""
    cols = [c(name) for name in df.columns]
    # Spark's hash passes over nulls, so (null, 1) and (1, null) need the flags to differ.
    h = F.xxhash64(*cols, *[col.isNull() for col in cols])
    part = F.pmod(F.shiftrightunsigned(h, 32), F.lit(parts))
    return F.shiftleft(part, 32).bitwiseOR(h.bitwiseAND(F.lit(0xFFFFFFFF)))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part the distinct numbers of a task, those that it has once and those that it has more than once."""
    held, size = [], 0

    def folded() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        part = values >> 32
        first = np.flatnonzero(np.diff(part, prepend=-1))
        rows = [(v.astype(np.uint32), n > 1) for v, n in zip(np.split(values & 0xFFFFFFFF, first[1:]), np.split(counts, first[1:]))]
        arrays = [pa.array([v[many == k].tobytes() for v, many in rows], pa.binary()) for k in (False, True)]
        return pa.RecordBatch.from_arrays([pa.array(part[first]), *arrays], ["part", "once", "often"])

    for batch in batches:
        held.append(batch.column(0).to_numpy())
        size += batch.num_rows
        if size >= ROWS_AT_ONCE:
            yield folded()
            held, size = [], 0
    if size:
        yield folded()


def _repeated(key: tuple, table: pa.Table) -> pa.Table:
    """The numbers of a part that came from two tasks, or twice from one."""
    parts = [np.frombuffer(x, np.uint32) for name in ("once", "often", "often") for x in table.column(name).to_pylist()]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    return pa.table({"number": (key[0].as_py() << 32) + values[counts > 1].astype(np.int64)})


def repeated_numbers(df: DataFrame, parts: int) -> DataFrame:
    """``number`` of every fingerprint that more than one row of ``df`` has."""
    folded = df.select(_numbers(df, parts).alias("number")).mapInArrow(_fold, "part long, once binary, often binary")
    return folded.groupBy("part").applyInArrow(_repeated, "number long")


def split_by_filter(df: DataFrame, number: Column, numbers: DataFrame, n_numbers: int) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``number`` (a long, not null) is surely not among ``numbers``, and the others."""
    bits = min(FILTER_WORDS * 64, max(64, 1 << math.ceil(math.log2(BITS_PER_KEY * n_numbers))))

    def place(number: Column) -> Column:
        # Never null in type either: else the join below tests it for null first, and derives all that a row's hash is made of again for that.
        return F.xxhash64(number).bitwiseAND(F.lit(bits - 1))

    marked = numbers.select(place(F.col("number")).alias("at"))
    mask = F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))")
    words = marked.groupBy(F.shiftright("at", 6).alias("__word")).agg(mask.alias("__mask"))
    # The filter has FILTER_WORDS rows at most, however many numbers there are.
    words = F.broadcast(materialize(words, "repeat_filter", few_files(df.sparkSession, n_numbers)))
    rows = df.withColumn("__at", place(number)).withColumn("__word", F.shiftright("__at", 6))
    hit = F.expr("__mask IS NOT NULL AND shiftright(__mask, cast(__at & 63 AS int)) & 1 = 1")
    rows = rows.join(words, "__word", "left")
    return tuple(rows.where(test).select(*[c(name) for name in df.columns]) for test in (~hit, hit))


def without_duplicates(df: DataFrame) -> tuple[DataFrame, int]:
    """Equal rows once (NaN counts as missing), and how many rows there were.

    Runs the passes that find the repeated fingerprints; the result is lazy. An empty table stays empty.
    """
    clean = nan_to_null(df)
    n = clean.count()
    parts = max(1, -(-n // ROWS_PER_PART))
    numbers = materialize(repeated_numbers(clean, parts), "repeated")
    found = numbers.count()
    if not found:
        return clean, n
    passed, rest = split_by_filter(clean, _numbers(clean, parts), numbers, found)
    return passed.union(rest.dropDuplicates()), n
