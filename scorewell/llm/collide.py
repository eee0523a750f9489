"""Find the keys that more than one item of a table emits, when every item emits very many.

Sending each key with its owner through a shuffle costs 16 bytes a key and more. Here a key
crosses the network once, as a short hash inside a sorted, bit-packed list of about two and a
quarter bytes a key; the few hashes that meet come back to the part they were sent from, and only
those keys are emitted again as rows. Hashes only propose: the rows carry the exact keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.session import few_files, materialize

HIGH_BITS = 23
KEYS_PER_BUCKET = 1 << 21
MOST_PARTITIONS = 20_000


def mix(keys: np.ndarray) -> np.ndarray:
    """64-bit keys scattered evenly (the finaliser of splitmix64); overwrites nothing."""
    x = keys ^ (keys >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack(values: np.ndarray, low_bytes: int) -> bytes:
    """Sorted unsigned numbers as their low bytes, then a bitmap with one mark per number."""
    low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low_bytes]
    at = (values >> np.uint64(8 * low_bytes)).astype(np.int64) + np.arange(len(values))
    marks = np.zeros(at[-1] + 1 if len(at) else 0, np.uint8)
    marks[at] = 1
    return low.tobytes() + np.packbits(marks, bitorder="little").tobytes()


def unpack(data: bytes, n: int, low_bytes: int) -> np.ndarray:
    low = np.zeros((n, 8), np.uint8)
    low[:, :low_bytes] = np.frombuffer(data, np.uint8, n * low_bytes).reshape(n, low_bytes)
    marks = np.unpackbits(np.frombuffer(data, np.uint8, offset=n * low_bytes), bitorder="little")
    high = np.flatnonzero(marks)[:n] - np.arange(n)
    return low.reshape(-1).view("<u8") | (high.astype(np.uint64) << np.uint64(8 * low_bytes))


def meeting_keys(
    items: DataFrame,
    keys_per_item: int,
    items_per_part: int,
    keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    payload: str,
    rows_of: Callable[[pa.Table, np.ndarray, np.ndarray], list],
    dealt_parts: int | None = None,
) -> DataFrame:
    """Rows (``key`` long, then the columns of ``payload``) for each key that more than one item emits.

    ``items`` has a column ``part_hash`` (long) and no repeated items. Where it lies dealt already, it has a column ``part`` instead,
    of ``dealt_parts`` values; a table with a bucket for each is not shuffled again. With a column ``owner`` (long), items that are in one part and
    have one owner count as one: what only they emit is no meeting. ``keys_of`` maps a table of
    items to all their keys and, for each key, the item's row number; an item emits a key once.
    ``rows_of`` maps the table, the keys and their row numbers to the columns of the result, key first; it may fold
    rows of one key. A few keys that only one item
    emits may be among the result, for two hashes can be equal by chance.
    """
    total = max(1, items.count() * keys_per_item)
    parts = dealt_parts or max(1, math.ceil(total / keys_per_item / items_per_part))
    low_bytes = 2 if total <= 1 << 33 else 3 if total <= 1 << 41 else 4
    bits = 8 * low_bytes + HIGH_BITS
    bucket_bits = max(0, min(HIGH_BITS, math.ceil(math.log2(total / KEYS_PER_BUCKET))))
    buckets, width = 1 << bucket_bits, bits - bucket_bits
    shift, inside = np.uint64(64 - bits), np.uint64((1 << width) - 1)

    def hashes(table):
        keys, rows = keys_of(table)
        keys = keys.astype(np.uint64, copy=False)
        return keys, rows, mix(keys) >> shift

    def send(key, table):
        _, rows, sent = hashes(table)
        if "owner" in table.column_names:
            _, owner, size = np.unique(table.column("owner").to_numpy(), return_inverse=True, return_counts=True)
            shared = size[owner][rows] > 1
            owners, values = owner[rows[shared]], sent[shared]
            order = np.lexsort((values, owners))
            owners, values = owners[order], values[order]
            first = np.ones(len(values), bool)
            first[1:] = (owners[1:] != owners[:-1]) | (values[1:] != values[:-1])
            sent = np.concatenate([sent[~shared], values[first]])
        sent = np.sort(sent)
        ends = np.searchsorted(sent, np.arange(1, buckets + 1, dtype=np.uint64) << np.uint64(width))
        out, start = [], 0
        for b, end in enumerate(ends.tolist()):
            if end > start:
                out.append((b, key[0].as_py(), end - start, pack(sent[start:end] & inside, low_bytes)))
            start = end
        return pa.table(
            dict(zip(("bucket", "part", "n", "data"), map(list, zip(*out)) if out else ([], [], [], []))),
            schema=pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]),
        )

    def meet(key, table):
        part, n, data = (table.column(x).to_pylist() for x in ("part", "n", "data"))
        order = np.uint64(max(1, len(part) - 1).bit_length())
        # Hash above, place of the sender below: one sort brings equal hashes together.
        both = np.concatenate(
            [(unpack(d, k, low_bytes) << order) | np.uint64(i) for i, (k, d) in enumerate(zip(n, data))]
        )
        both.sort()
        equal = (both[1:] >> order) == (both[:-1] >> order)
        hit = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
        both = both[hit]
        sender = (both & np.uint64((1 << int(order)) - 1)).astype(np.int64)
        value = (both >> order) | (np.uint64(key[0].as_py()) << np.uint64(width))
        by = np.argsort(sender, kind="stable")
        sender, value = sender[by], value[by]
        ids, starts = np.unique(sender, return_index=True)
        blobs = [x.tobytes() for x in np.split(value, starts[1:])] if len(ids) else []
        return pa.table({"part": pa.array([part[i] for i in ids], pa.int64()), "hits": pa.array(blobs, pa.binary())})

    names = ["key"] + [x.split()[0] for x in payload.split(",")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([("key", pa.int64())] + [(x.split()[0], types[x.split()[1]]) for x in payload.split(",")])

    def emit(key, table, hits):
        if not (table.num_rows and hits.num_rows):
            return schema.empty_table()
        wanted = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in hits.column("hits").to_pylist()]))
        keys, rows, found = hashes(table)
        at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
        chosen = np.flatnonzero(wanted[at] == found)
        return pa.table(dict(zip(names, rows_of(table, keys[chosen], rows[chosen]))), schema=schema)

    width_of = min(parts, MOST_PARTITIONS)
    dealt = items
    if dealt_parts is None:
        dealt = items.withColumn("part", F.expr(f"pmod(part_hash, {parts}L)")).drop("part_hash").repartition(width_of, "part")
    sent = dealt.groupBy("part").applyInArrow(send, "bucket long, part long, n long, data binary")
    met = (
        sent.repartition(min(buckets, MOST_PARTITIONS), "bucket")
        .groupBy("bucket")
        .applyInArrow(meet, "part long, hits binary")
    )
    # No fewer tasks than buckets or parts, of which each is one group.
    hits = materialize(met, "hits", few_files(items.sparkSession, 0) + buckets).repartition(width_of, "part")
    found = dealt.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(emit, f"key long, {payload}")
    return found.coalesce(few_files(items.sparkSession, 0) + width_of)
