"""Token ids as raw shard files, with a minimal perfect hash index from document keys to places in them.

A folder holds, for each shard, ``shard-*.ids`` (the ids of its documents one after another, as
little-endian unsigned integers of 2 or 4 bytes) and ``shard-*.lens`` (64-bit counts per document);
``index-*.npz`` (one per bucket of keys); and two Parquet tables, ``shards`` (ids before each shard) and
``settings``. A key is found in constant time: its bucket's hash function gives a slot, the
slot's stored fingerprint tells strangers off, and the slot names shard and offset.

Files are written under a name of the task attempt and then moved, and the rows of a shard
are a function of the data, so a task that runs again leaves the same files. Paths may be in any store
that Arrow's file systems reach.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewell.llm.batches import sized
from scorewell.llm.collide import mix
from scorewell.llm.word_ids import encoder
from scorewell.session import materialize

IDS_PER_SHARD = 1 << 24
KEYS_PER_BUCKET = 50_000
SPARE = 2  # bits per key at each level of the hash function
MOST_LEVELS = 64


def _save(path: str, data: bytes) -> None:
    """Write under another name, then move: readers never see half a file."""
    store, at = arrow_fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    task = TaskContext.get()
    own = f"{at}.{task.taskAttemptId() if task else 'driver'}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, at)


def _load(path: str) -> bytes:
    store, at = arrow_fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


def shard_name(shard: int) -> str:
    return f"shard-{shard >> 16:07d}-{shard & 0xFFFF:05d}"


def build_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimal perfect hash of distinct (h1, h2): bits per level, the levels' starts, and each key's slot.

    Keys that have a place of a level to themselves stay there; the others go on to the next level. A key's slot
    is the number of taken places before its own.
    """
    places = np.full(len(h1), -1, np.int64)
    left, starts, bits = np.arange(len(h1)), [0], []
    while len(left):
        if len(bits) == MOST_LEVELS:
            raise ValueError("two keys have the same 128-bit hash")
        width = SPARE * len(left) + 1
        at = _places(h1[left], h2[left], len(bits), width)
        count = np.bincount(at, minlength=width)
        alone = count[at] == 1
        places[left[alone]] = starts[-1] + at[alone]
        bits.append(count == 1)
        starts.append(starts[-1] + width)
        left = left[~alone]
    taken = np.concatenate(bits) if bits else np.zeros(0, bool)
    before = np.cumsum(taken) - taken
    return taken, np.array(starts, np.int64), before[places] if len(h1) else places


def _places(h1: np.ndarray, h2: np.ndarray, level: int, width: int) -> np.ndarray:
    seed = np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return (mix(h1.view(np.uint64) ^ mix(h2.view(np.uint64) + seed)) % np.uint64(width)).astype(np.int64)


def find_slots(taken: np.ndarray, starts: np.ndarray, before: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The slot of each key; -1, or the slot of some other key, for a key that was not indexed."""
    slots, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
    for level in range(len(starts) - 1):
        at = starts[level] + _places(h1[left], h2[left], level, int(starts[level + 1] - starts[level]))
        hit = taken[at]
        slots[left[hit]] = before[at[hit]]
        left = left[~hit]
        if not len(left):
            break
    return slots


def _check(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix(h2.view(np.uint64) ^ (h1.view(np.uint64) << np.uint64(1))) >> np.uint64(32)).astype(np.uint32)


def key_hashes(key: Column, buckets: int) -> list[Column]:
    """The two hashes of a key and its bucket. A null key is a key like any other."""
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit("second"), text)
    return [h1.alias("h1"), h2.alias("h2"), F.pmod(F.xxhash64(F.lit("bucket"), text), F.lit(buckets)).alias("bucket")]


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2"
) -> None:
    """Encode whole texts and write shards and index to ``folder``, in ascending order of ``id_col`` (nulls first).

    Rows of one id follow one another in an order that their texts fix, and are all found by their key. A null
    text has no ids of its own, only ``end_id``. Extra columns are ignored. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    # Ranges are found from keys and hashes; no text goes to the driver for them.
    ranges = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    kind = docs.schema[id_col].dataType.simpleString()
    order = [*ranges, F.col("text")]
    end = np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize

    def write(batches: Iterator[pa.RecordBatch]):
        shard, data, lens, size = TaskContext.get().partitionId() << 16, [], [], 0
        encode = encoder(tokenizer).encode

        def close():
            _save(f"{folder}/{shard_name(shard)}.ids", b"".join(data))
            _save(f"{folder}/{shard_name(shard)}.lens", np.array(lens, "<i8").tobytes())

        for batch in sized(batches, 1):
            keys, places = batch.column(0), []
            for ids in encode(pc.fill_null(batch.column(1), "")):
                ids = np.frombuffer(ids, "<u4").astype(dtype).tobytes() + end
                if size >= IDS_PER_SHARD:
                    close()
                    shard, data, lens, size = shard + 1, [], [], 0
                places.append((shard, size, len(lens), len(ids) // width))
                data.append(ids)
                lens.append(places[-1][3])
                size += lens[-1]
            columns = [pa.array(x, pa.int64()) for x in zip(*places)] if places else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([keys, *columns], ["key", "shard", "at", "nth", "n"])
        if lens:
            close()

    placed = rows.repartitionByRange(n, *ranges).sortWithinPartitions(*order).mapInArrow(
        write, f"key {kind}, shard long, at long, nth long, n long"
    )
    entries = materialize(placed, "entries")  # this is the one job that writes shards

    totals = entries.groupBy("shard").agg(F.sum("n").alias("ids"), F.count("*").alias("docs"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard file
    totals.withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0))).write.parquet(f"{folder}/shards")

    buckets = max(1, math.ceil(entries.count() / KEYS_PER_BUCKET))
    runs = entries.groupBy("key", "shard").agg(F.min("at").alias("at"), F.min("nth").alias("nth"), F.count("*").alias("docs"))
    keyed = runs.select(*key_hashes(F.col("key"), buckets), "shard", "at", "nth", "docs")

    def index(key, table):
        h1, h2, *cols = (table.column(x).to_numpy() for x in ("h1", "h2", "shard", "at", "nth", "docs"))
        order = np.lexsort((cols[0], h2, h1))
        h1, h2, cols = h1[order], h2[order], [x[order] for x in cols]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        first = np.flatnonzero(new)
        taken, starts, slot = build_hash(h1[first], h2[first])
        in_slot_order = np.argsort(slot)
        count = np.diff(np.append(first, len(h1)))[in_slot_order]
        gather = np.repeat(first[in_slot_order] - (np.cumsum(count) - count), count) + np.arange(len(h1))
        out = io.BytesIO()
        np.savez(
            out, taken=np.packbits(taken), width=len(taken), starts=starts, runs=np.concatenate([[0], np.cumsum(count)]),
            check=_check(h1[first], h2[first])[in_slot_order], **dict(zip(("shard", "at", "nth", "docs"), [x[gather] for x in cols])),
        )
        _save(f"{folder}/index-{key[0].as_py():07d}.npz", out.getvalue())
        return pa.table({"bucket": [key[0].as_py()], "keys": [len(first)]})

    built = keyed.repartition(min(buckets, 20_000), "bucket").groupBy("bucket").applyInArrow(index, "bucket long, keys long")
    built.write.parquet(f"{folder}/buckets")
    settings = spark.range(1).select(F.lit(buckets).cast("long").alias("buckets"), F.lit(dtype).alias("dtype"))
    settings.write.parquet(f"{folder}/settings")


def read_documents(spark: SparkSession, folder: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) for every document of ``folder`` under one of the keys, found through the index.

    ``start`` counts the ids of all documents before it; ``ids`` holds them as little-endian unsigned 32-bit
    integers, the end id last. Repeated keys count once; unknown keys give no row.
    """
    found = spark.read.parquet(f"{folder}/settings").first()
    buckets, dtype = found["buckets"], found["dtype"]
    kind = keys.schema[key_col].dataType.simpleString()
    width = np.dtype(dtype).itemsize

    def look_up(key, table):
        h1, h2 = table.column("h1").to_numpy(), table.column("h2").to_numpy()
        names = ["key", "shard", "at", "nth", "docs"]
        file = np.load(io.BytesIO(_load(f"{folder}/index-{key[0].as_py():07d}.npz")))
        taken = np.unpackbits(file["taken"])[: int(file["width"])].astype(bool)
        slots = find_slots(taken, file["starts"], np.cumsum(taken) - taken, h1, h2)
        rows = np.flatnonzero(slots >= 0)
        rows = rows[file["check"][slots[rows]] == _check(h1[rows], h2[rows])]
        first, count = file["runs"][slots[rows]], np.diff(file["runs"])[slots[rows]]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return pa.table([table.column("key").take(pa.array(np.repeat(rows, count))), *[pa.array(file[x][at]) for x in names[1:]]], names)

    def fetch(key, table):
        shard = key[0].as_py()
        lens = np.frombuffer(_load(f"{folder}/{shard_name(shard)}.lens"), "<i8")
        store, path = arrow_fs.FileSystem.from_uri(f"{folder}/{shard_name(shard)}.ids")
        rows, at, n, ids = [], [], [], []
        runs = zip(*[table.column(x).to_pylist() for x in ("at", "nth", "docs")])
        with store.open_input_file(path) as f:
            for i, (start, nth, docs) in enumerate(runs):
                for size in lens[nth : nth + docs].tolist():
                    rows.append(i)
                    at.append(start)
                    n.append(size)
                    ids.append(np.frombuffer(f.read_at(size * width, start * width), dtype).astype("<u4").tobytes())
                    start += size
        columns = [table.column("key").take(pa.array(rows, pa.int64())), pa.array([shard] * len(rows), pa.int64()), pa.array(at, pa.int64())]
        return pa.table([*columns, pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["key", "shard", "at", "n_tokens", "ids"])

    wanted = keys.select(F.col(f"`{key_col}`").alias("key")).distinct()
    wanted = wanted.select("key", *key_hashes(F.col("key"), buckets)).repartition(min(buckets, 20_000), "bucket")
    places = wanted.groupBy("bucket").applyInArrow(look_up, f"key {kind}, shard long, at long, nth long, docs long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = places.repartition(n, "shard").groupBy("shard").applyInArrow(
        fetch, f"key {kind}, shard long, at long, n_tokens long, ids binary"
    )
    base = spark.read.parquet(f"{folder}/shards").select("shard", "base")
    return read.join(base, "shard").select("key", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
