"""Ranked search of many items at once: what their term sets have in common is added up once per document.

The items of a block become bags of terms in one order, rarest signature last. Neighbours that stand side by side in two or more
items become a node, then neighbours of nodes, until nothing is shared: a graph in which every node is the
sum of two others and an item is the top of its bag. For every block of documents a node's partial scores are added up once and used by
all nodes and items above it.

Documents are read once into (id, number of terms, counts of the items' terms). Scores are integers, so sums do not depend on the
order. Every task keeps each item's best rows. A first run over a sample of documents gives each item a score that the last
wanted row reaches at least, so that tasks hand on few rows; it leaves out none that belongs to the result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewell.llm.batches import slices
from scorewell.session import materialize

#: ASCII but digits and letters separates; A-Z is lowered; every byte of a character beyond ASCII stays.
FOLD = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(range(256))).lower()
TERMS_PER_BLOCK = 400_000
DOCUMENTS_AT_ONCE = 512
CELLS_AT_ONCE = 1 << 22
SAMPLE = 64  # one document in so many for the first bound
SALTS = 64


def terms(data: bytes) -> list[bytes]:
    """Runs of ASCII digits, ASCII letters (lowered) and characters beyond ASCII."""
    return data.translate(FOLD).split()


class Sharing:
    """The sums that items share. Cells 0 .. len(atoms) are atoms (term, times it is counted); cell ``first + i`` is the sum of ``left[i]`` and ``right[i]``."""

    def __init__(self, bags: list[Counter]):
        holders = defaultdict(list)
        for i, bag in enumerate(bags):
            for atom in bag.items():
                holders[atom].append(i)
        # Atoms of the same items stand together, those of many items first.
        self.atoms = sorted(holders, key=lambda a: (-len(holders[a]), holders[a], a))
        place = {a: k for k, a in enumerate(self.atoms)}
        rows = [sorted(place[a] for a in bag.items()) for bag in bags]
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = len(self.atoms)
        while any(len(r) > 1 for r in rows):
            rows = self._fold(rows)
        self.tops = [r[0] if r else -1 for r in rows]

    def _fold(self, rows: list[list[int]]) -> list[list[int]]:
        """One level: neighbours that several rows share, or, where none are left, all neighbours."""
        seen = Counter(pair for r in rows for pair in set(zip(r, r[1:])))
        least = 2 if any(n > 1 for n in seen.values()) else 1
        made: dict[tuple[int, int], int] = {}
        out = []
        for r in rows:
            new, k = [], 0
            while k < len(r):
                pair = tuple(r[k : k + 2])
                # Of two overlapping pairs the one that more rows share.
                better = seen.get(tuple(r[k + 1 : k + 3]), 0) > seen.get(pair, 0)
                if len(pair) == 2 and seen[pair] >= least and not better:
                    new.append(made.setdefault(pair, self.size + len(made)))
                    k += 2
                else:
                    new.append(r[k])
                    k += 1
            out.append(new)
        pairs = np.array(list(made), np.int64).reshape(-1, 2)
        self.levels.append((self.size, pairs[:, 0], pairs[:, 1]))
        self.size += len(made)
        return out

    def sums(self, atoms: np.ndarray) -> np.ndarray:
        """All cells for rows of atom values: (cells, documents)."""
        out = np.zeros((self.size, atoms.shape[1]), np.int64)
        out[: len(atoms)] = atoms
        for first, left, right in self.levels:
            np.add(out[left], out[right], out=out[first : first + len(left)])
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[Counter]]]:
    """Ids and term bags of items, in blocks of bounded size. Equal rows are one item."""
    bare = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).distinct()
    chars = bare.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / (4 * TERMS_PER_BLOCK)))
    for b in range(blocks):
        rows = bare.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        yield [r["id"] for r in rows], [Counter(terms((r["text"] or "").encode())) for r in rows]


def _counted(docs: DataFrame, kind: str, number: dict[bytes, int]) -> DataFrame:
    """(doc, n, at, tf): a document's number of terms, and which of the wanted terms it has how often."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ns, offsets, at, tf = [], [0], [], []
            for data in pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist():
                found = terms(data)
                counts = Counter(map(number.get, found))
                counts.pop(None, None)
                ns.append(len(found))
                at.extend(counts)
                tf.extend(counts.values())
                offsets.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *lists], ["doc", "n", "at", "tf"])

    return docs.mapInArrow(work, f"doc {kind}, n long, at array<int>, tf array<int>")


def _best(rows: DataFrame, kind: str, sharing: Sharing, weights: np.ndarray, count: int, total: int, top: int, floors: np.ndarray) -> DataFrame:
    """(item, doc, score): each task's ``top`` rows of every item with a score above 0 and of ``floors`` at least."""
    term = np.array([t for t, _ in sharing.atoms], np.int64)
    times = np.array([k for _, k in sharing.atoms], np.int64)[:, None]
    tops = np.array(sharing.tops, np.int64)
    items = np.flatnonzero(tops >= 0)
    width = max(1, min(DOCUMENTS_AT_ONCE, CELLS_AT_ONCE // max(1, sharing.size)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        least = np.maximum(floors[items], 1)
        for batch in slices(batches, width):
            n = batch.column(1).to_numpy()
            sizes = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy()
            doc = np.repeat(np.arange(len(n)), sizes)
            at = batch.column(2).flatten().to_numpy()
            tf = batch.column(3).flatten().to_numpy().astype(np.int64)
            m = 75 + (25 * n * count) // max(total, 1)
            values = np.zeros((len(weights), len(n)), np.int64)
            values[at, doc] = weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            scores = sharing.sums(values[term] * times)[tops[items]]
            hit, place = np.nonzero(scores >= least[:, None])
            if not len(hit):
                continue
            ids = batch.column(0).take(pa.array(place)).to_pylist()
            for i, d, s in zip(hit.tolist(), ids, scores[hit, place].tolist()):
                kept.setdefault(i, []).append((-s, d is None, d, s))
            for i in np.unique(hit).tolist():
                if len(kept[i]) > 4 * top:
                    kept[i] = sorted(kept[i], key=lambda r: r[:2] + (() if r[1] else (r[2],)))[:top]
                    least[i] = max(least[i], kept[i][-1][3])
        out = []
        for i, found in kept.items():
            found = sorted(found, key=lambda r: r[:2] + (() if r[1] else (r[2],)))[:top]
            out += [(int(items[i]), d, s) for _, _, d, s in found]
        schema = pa.schema([("item", pa.int32()), ("doc", doc_type), ("score", pa.int64())])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = to_arrow_type(rows.schema["doc"].dataType)
    return rows.mapInArrow(work, f"item int, doc {kind}, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item with their ranks; tasks' best meet in SALTS groups per item first."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Each item's ``top`` documents with a score above 0: (item id, rank, doc id, score), best first, equal scores by ascending id, null ids last.

    With N documents that have terms, L terms in them, n terms in one document and m = 75 + 25 n N div L, a term that stands tf times adds
    w * (10^9 tf div (1000 tf + 12 m)), w = floor(1000 ln((2 N + 2) / (2 df + 1))), once for every time the item has it.
    Null texts and ids are allowed: a null text has no terms. Rows with one id rank by themselves; equal item rows are one
    item, different texts of one item id are two. Extra columns are ignored. Empty tables give an empty result. Texts are read whole.
    Items are taken in blocks of about TERMS_PER_BLOCK terms, which bounds what the driver and a task hold of them (an item beyond that has a block to itself
    or shares one by chance); every block reads the documents again.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    bare = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for ids, bags in _blocks(items, item_col, item_text):
        number = {t: k for k, t in enumerate(sorted(set().union(*bags)))}
        numbered = [Counter({number[t]: n for t, n in bag.items()}) for bag in bags]
        rows = materialize(_counted(bare, kind, number), "counted")
        facts = rows.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
        frequent = rows.select(F.explode("at").alias("at")).groupBy("at").count().collect()  # one row per term of the block at most
        df = np.zeros(len(number), np.int64)
        for r in frequent:
            df[r["at"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * facts["N"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        sharing = Sharing(numbered)
        shared = (kind, sharing, weights, facts["N"], facts["L"], top)
        floors = np.zeros(len(ids), np.int64)
        sample = rows.where(F.pmod(F.xxhash64("doc", "n"), F.lit(SAMPLE)) == 0)
        for r in _ranked(_best(sample, *shared, floors), top).where(F.col("rank") == top).collect():
            floors[r["item"]] = r["score"]
        found = _ranked(_best(rows, *shared, floors), top)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {item_kind}")
        found = found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")
        out = found if out is None else out.union(found)
    return out
