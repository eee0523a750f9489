"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common neighbour within half the
radius of each. So every fingerprint emits all variants within half the radius, equal variants
meet in a shuffle, and those that met are verified. All fingerprints that share one exact variant
are within the radius of each other, so a star to the least of them loses no connection and no
group is ever expanded into pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.batches import slices
from scorewell.llm.collide import meeting_keys
from scorewell.llm.graph import components
from scorewell.session import few_files, materialize

SEED = 42
BITS = 64
RADIUS = 4
FINGERPRINTS_PER_PART = 2048
MEMBERS_PER_SHARE = 1024
ROWS_AT_ONCE = 1 << 16


def shingle_spans(data: bytes, width: int) -> tuple[bytes, list[int], list[int]]:
    """Words joined by one space, and where each shingle of ``width`` words starts and ends in them."""
    words = data.lower().split()
    if not words:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    return b" ".join(words), starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()


def shingle_hashes(data: bytes, width: int = 4) -> np.ndarray:
    """The 64-bit hash of each word shingle of a text given as UTF-8, as rows of eight bytes; no rows without words."""
    joined, starts, ends = shingle_spans(data, width)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)]), np.uint8).reshape(-1, 8)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), ROWS_AT_ONCE):
        ones += np.unpackbits(hashes[i : i + ROWS_AT_ONCE], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprint(data: bytes, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text given as UTF-8; zero without words.

    Words are what ASCII white space separates, A-Z lower-cased; repeats count; a bit is set when
    more than half of the hashes have it.
    """
    return majority(shingle_hashes(data, width))


def with_fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long) for every row; a null text counts as empty."""

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = np.array([fingerprint(t or b"", width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def ball_masks(radius: int) -> np.ndarray:
    """Every 64-bit word with at most ``radius`` bits set, zero first."""
    one = [1 << i for i in range(BITS)]
    return np.array([sum(x) for r in range(radius + 1) for x in combinations(one, r)], np.uint64)


def spanning_forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """As many of the pairs as join all that the pairs join."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for u, v in pairs.tolist():
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((u, v))
    return out


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that join all of ``fp`` (distinct longs) within ``radius`` bits, as stars over shared variants.

    In a dense group nearly every variant is shared by many. So links of half the radius come first, by the few variants they take;
    what these join is dealt to one part (large groups to several), and only variants that different ones share meet in the second step.
    """
    if radius < 4:
        return _links(fingerprints.select("fp", F.xxhash64("fp").alias("part_hash")), radius)
    files = few_files(fingerprints.sparkSession, fingerprints.count())
    near = materialize(_links(fingerprints.select("fp", F.xxhash64("fp").alias("part_hash")), radius // 2), "near_links", files)
    roots = materialize(components(near), "near_roots")
    size = roots.groupBy("root").agg(F.ceil(F.count("*") / MEMBERS_PER_SHARE).alias("shares"))
    shared = roots.join(size, "root").select("node", "root", F.pmod(F.xxhash64("node"), F.col("shares")).alias("share"))
    named = fingerprints.select("fp").join(shared, F.col("fp") == F.col("node"), "left")
    owner = F.coalesce("root", "fp")
    items = named.select("fp", owner.alias("owner"), F.xxhash64(owner, F.coalesce("share", F.lit(0))).alias("part_hash"))
    return near.union(_links(materialize(items, "dealt", files), radius)).distinct()


def _links(items: DataFrame, radius: int) -> DataFrame:
    """The same in one step; ``items``: (fp, part_hash) and perhaps owner, fingerprints of one owner being joined already."""
    masks = ball_masks(radius // 2) if radius % 2 == 0 else ball_masks(radius // 2 + 1)

    def keys_of(table):
        fps = table.column("fp").to_numpy().view(np.uint64)
        return (fps[:, None] ^ masks[None, :]).reshape(-1), np.repeat(np.arange(len(fps)), len(masks))

    def rows_of(table, keys, rows):
        """One row per key for all that emit it here, the least of them, and a forest that joins those."""
        fps = table.column("fp").to_numpy()[rows]
        order = np.lexsort((fps, keys))
        keys, fps = keys[order], fps[order]
        same = keys[1:] == keys[:-1]
        lead = np.concatenate([[True], ~same]) if len(keys) else np.zeros(0, bool)
        forest = spanning_forest(np.unique(np.stack([fps[:-1][same], fps[1:][same]], axis=1), axis=0)) if len(keys) else []
        u, v = [x[0] for x in forest], [x[1] for x in forest]
        columns = [keys[lead].view(np.int64), fps[lead], np.zeros(int(lead.sum()), np.int64)], [np.zeros(len(u), np.int64), u, v]
        linked = pa.array(np.concatenate([np.zeros(int(lead.sum()), bool), np.ones(len(u), bool)]))
        out = [pa.array(np.concatenate([np.asarray(a, np.int64), np.asarray(b, np.int64)])) for a, b in zip(*columns)]
        return [*out[:2], pc.if_else(linked, out[2], None)]

    met = meeting_keys(items, len(masks), FINGERPRINTS_PER_PART, keys_of, "fp long, near long", rows_of)
    met = materialize(met, "met")
    # One variant has at most as many sources as the ball has points, so the list below is bounded.
    groups = met.where("near IS NULL").groupBy("key").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("all")).where("size(all) > 1")
    links = groups.select(F.explode("all").alias("u"), "v").where("u <> v")
    links = links.union(met.where("near IS NOT NULL").select(F.col("fp").alias("u"), F.col("near").alias("v")))
    return links.where(f"bit_count(u ^ v) <= {radius}").distinct()


def near_duplicates(
    docs: DataFrame, width: int = 4, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; equal texts are one node, not pairs.

    ``component_id`` is the least doc_id that can be reached over links of at most ``radius`` bits.
    Null and empty texts share the fingerprint zero. Repeated ids are kept as rows; rows without an
    id are never a component's name unless no other row is in it (then it is null).
    """
    own = materialize(with_fingerprints(docs, width, id_col, text_col), "simhash")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(named.join(least, "root").select("fp", "component_id"), "classes")
    return own.join(of, "fp").select("doc_id", "fp", "component_id")
