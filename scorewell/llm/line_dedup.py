"""Line dedup by a segment-partition edit join.

A line is cut into one segment more than the edits allowed, so at least one segment stays whole in any line
within that distance. Each line files its segments under (its length, which segment, content) and probes, for each
length a partner may have, only those of its substrings that could be such a segment. Lines that met are
verified with a banded bit-parallel edit distance. Equal lines are one line from the start.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.collide import MOST_PARTITIONS, meeting_keys
from scorewell.llm.graph import components
from scorewell.session import fresh_path, materialize

EDITS = 2
#: Shorter lines are compared for equality only: two edits could turn them into anything.
LEAST_CHARS = 24
LINES_PER_PART = 60_000
SKETCH_BINS = 32
#: Letters that differ between the common ends of two lines beyond which columns are not worked through one by one.
LONG = 4_096


def cuts(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """Start and length of the ``edits + 1`` segments of a line of this length, as even as can be."""
    short, longer = divmod(length, edits + 1)
    sizes = [short] * (edits + 1 - longer) + [short + 1] * longer
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes))


def probes(length: int, edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(seed, start, end) of the substrings of a line of this length that can be a segment of a line as long or shorter.

    Of the segments that two lines share, the first or the last tells by how much it can have moved: a segment's
    edits to its left are fewer than its number, those to its right at most what remains. The line's own
    segments are among these (no edits, not moved).
    """
    out = []
    for shorter in range(max(1, length - edits), length + 1):
        gap = length - shorter
        for i, (start, size) in enumerate(cuts(shorter, edits)):
            low = max(0, start - i, start + gap - (edits - i))
            high = min(length - size, start + i, start + gap + (edits - i))
            out += [(shorter * (edits + 1) + i, at, at + size) for at in range(low, high + 1)]
    return out


_probes: dict[tuple[int, int], list[tuple[int, int, int]]] = {}


def keys_of_line(line: str, edits: int = EDITS) -> set[int]:
    wanted = _probes.get((len(line), edits))
    if wanted is None:
        wanted = _probes[len(line), edits] = probes(len(line), edits)
        if len(_probes) > 50_000:
            _probes.clear()
    digest = xxhash.xxh64_intdigest
    return {digest(line[a:b], seed) for seed, a, b in wanted}


def shared_length(a: int, b: int, equal: Callable[[int], bool]) -> int:
    """The greatest n for which ``equal(n)`` holds, by halving: strings of lengths a and b have an end of n letters in common."""
    low, high = 0, min(a, b)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if equal(middle) else (low, middle - 1)
    return low


def edit_distance(a: str, b: str, most: int = EDITS) -> int:
    """Levenshtein distance, or ``most + 1`` when it is above ``most``.

    What the two have in common at both ends is taken off; then bit-parallel columns, kept to the band of
    ``2 * most + 1`` diagonals, and given up as soon as no cell of the band can end within ``most``.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = shared_length(len(a), len(b), lambda n: a[:n] == b[:n])
    a, b = a[start:], b[start:]
    end = shared_length(len(a), len(b), lambda n: a[len(a) - n :] == b[len(b) - n :])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if most == 0:
        return 1
    if len(a) > LONG:
        # Far too many columns: the first letters differ, so an edit stands here; try each kind with one edit fewer.
        return 1 + min(edit_distance(x, y, most - 1) for x, y in ((a[1:], b[1:]), (a[1:], b), (a, b[1:])))
    m = len(a)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | (1 << i)
    up, down, score, top, every = (1 << m) - 1, 0, m, 1 << (m - 1), (1 << m) - 1
    for j, ch in enumerate(b):
        low, high = max(0, j - most), min(m, j + most + 1)
        band = ((1 << high) - 1) ^ ((1 << low) - 1)
        eq = at.get(ch, 0) & band
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & every
        rise, fall = down | (every & ~(d | up)), up & d
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1) | 1, fall << 1
        up, down = (fall | (every & ~(d | rise))) & every, rise & d & every
        # Each letter of b that is left lowers the last row's score by one at most.
        if score - (len(b) - 1 - j) > most:
            return most + 1
    return min(score, most + 1)


def sketch(line: str) -> np.ndarray:
    """How many characters fall into each of some bins: one edit changes two counts by one at most."""
    points = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32)
    return np.bincount(points % SKETCH_BINS, minlength=SKETCH_BINS).astype(np.int32)


def links_in_group(ids: list[int], lines: list[str], key: int, edits: int = EDITS) -> tuple[list[tuple[int, int]], Counter]:
    """A forest that joins the linked lines of one key's group, and for each line the links that are counted here.

    Lines that share several keys meet in several groups; their link counts in the group of the least shared key.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(lines[i]), ids[i]))
    size = np.array([len(lines[i]) for i in order])
    bins = np.stack([sketch(lines[i]) for i in order])
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest, counted, keys = [], Counter(), {}
    for x in range(len(order)):
        until = int(np.searchsorted(size, size[x] + edits, side="right"))
        near = np.abs(bins[x + 1 : until] - bins[x]).sum(axis=1) <= 2 * edits
        for y in (np.flatnonzero(near) + x + 1).tolist():
            i, j = order[x], order[y]
            if edit_distance(lines[i], lines[j], edits) > edits:
                continue
            for k in (i, j):
                if k not in keys:
                    keys[k] = keys_of_line(lines[k], edits)
            if min(keys[i] & keys[j]) == key:
                counted.update((ids[i], ids[j]))
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                forest.append((ids[i], ids[j]))
    return forest, counted


def linked_groups(batches: Iterable[pa.RecordBatch], edits: int = EDITS) -> Iterator[pa.RecordBatch]:
    """(u, v, links) of rows (key, line_id, line) in order of their keys: the forest of each group, and a line's links as (line_id, line_id, links).

    The last group of a batch may go on in the next.
    """
    key, ids, lines = None, [], []

    def ended():
        if len(ids) < 2:
            return []
        forest, counted = links_in_group(ids, lines, key & 0xFFFFFFFFFFFFFFFF, edits)
        return [(u, v, 0) for u, v in forest] + [(i, i, n) for i, n in counted.items()]

    def out(rows):
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["u", "v", "links"])

    for batch in batches:
        keys, rows = batch.column(0).to_numpy(), []
        own, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for start, end in zip(starts, starts[1:]):
            if keys[start] != key:
                rows += ended()
                key, ids, lines = int(keys[start]), [], []
            ids += own[start:end]
            lines += texts[start:end]
        yield out(rows)
    yield out(ended())


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, nth, line, line_id): the lines of every text, without white space at their ends, blank ones left out."""
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.posexplode(lines).alias("nth", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c"))).where("line <> ''")
    return rows.withColumn("line_id", F.xxhash64("line"))


def distinct_lines(lines: DataFrame, n_lines: int) -> tuple[DataFrame, int]:
    """(line_id, check, line, copies, first_doc, part) of every distinct line, and the number of parts.

    The one table that holds texts, and the one shuffle of them. Parts follow the hash that the grouping is
    shuffled by, so each of its partitions writes whole parts; buckets let later steps read them with no further shuffle.
    """
    spark = lines.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = width * max(1, min(math.ceil(n_lines / (width * LINES_PER_PART)), MOST_PARTITIONS // width))
    grouped = lines.groupBy("line_id", "line").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    dealt = grouped.select("*", F.hash("line").alias("check"), F.expr(f"bigint(pmod(hash(line_id, line), {parts}))").alias("part"))
    path = fresh_path(spark, "lines")
    name = "lines_" + path.rsplit("-", 1)[1]
    dealt.write.option("path", path).option("compression", "zstd").bucketBy(parts, "part").saveAsTable(name)
    return spark.table(name), parts


def line_classes(distinct: DataFrame, parts: int, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """(line_id, check, class_id, copies, first_doc, n_links) of every distinct line, from ``distinct_lines``.

    ``class_id`` is the least line_id reachable over links of at most ``edits`` edits between lines of ``least``
    or more characters; ``n_links`` counts a line's links to other lines. Links name lines by ``line_id`` (64 bits).
    """
    items = distinct.where(F.length("line") >= least).select("part", "line_id", "line")
    per_line = len(probes(10 * (edits + 1), edits))

    def keys_of(table):
        keys = [keys_of_line(x, edits) for x in table.column("line").to_pylist()]
        rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        return np.fromiter((k for ks in keys for k in ks), np.uint64, len(rows)), rows

    def rows_of(table, keys, rows):
        at = pa.array(rows)
        columns = [pa.array(keys.view(np.int64)), table.column("line_id").take(at), table.column("line").take(at)]
        return [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns]

    met = meeting_keys(items, per_line, LINES_PER_PART, keys_of, "line_id long, line string", rows_of, parts)

    # Very many groups have two lines, so they come to Python in common batches and not one by one.
    together = met.repartition("key").sortWithinPartitions("key").select("key", "line_id", "line")
    found = materialize(together.mapInArrow(lambda batches: linked_groups(batches, edits), "u long, v long, links long"), "links")
    roots = components(found.where("u <> v").select("u", "v"))
    counts = found.where("u = v").groupBy("u").agg(F.sum("links").alias("n_links"))
    linked = materialize(
        roots.join(counts, roots["node"] == counts["u"], "left").select("node", "root", F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "linked",
    )
    return distinct.join(linked, distinct["line_id"] == linked["node"], "left").select(
        "line_id", "check", F.coalesce("root", "line_id").alias("class_id"), "copies", "first_doc", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_repeated, n_links, dropped) per id: which lines of a document stand elsewhere before.

    Of each class of near-equal lines the first stays: that of the least doc_id, then of the least place. ``dropped``
    lists the places of lines that go. ``n_links`` sums the links of the lines to lines that differ from them. Null
    and blank texts have no lines; ids that are null share a row. Rows of one id count as one document: of lines that stand at one place of
    several such rows one can stay, and the place is listed once for each that goes. Very long lines are compared whole.
    """
    lines = lines_of(docs, id_col, text_col)
    rows = materialize(lines.select("doc_id", "nth", "line_id", F.hash("line").alias("check")), "occurrences")
    classes = materialize(line_classes(*distinct_lines(lines, rows.count()), edits, least), "classes")
    # Only lines that are not alone can be dropped or have links; the others are counted and need no lookup.
    whole = classes.groupBy("class_id").agg(F.min("first_doc").alias("keeper"), F.sum("copies").alias("size")).where("size > 1")
    shared = classes.join(whole, "class_id").select("line_id", "check", "class_id", "keeper", "n_links")
    met = rows.join(shared, ["line_id", "check"])
    # A class whose documents all lack an id is kept by the row of null ids.
    places = met.groupBy("doc_id", "class_id", F.expr("doc_id <=> keeper").alias("keeps")).agg(
        F.sum("n_links").alias("n_links"), F.array_sort(F.collect_list("nth")).alias("places")
    )
    goes = places.withColumn("places", F.expr("if(keeps, slice(places, 2, size(places)), places)"))
    per_doc = goes.groupBy("doc_id").agg(F.sum("n_links").alias("n_links"), F.array_sort(F.flatten(F.collect_list("places"))).alias("dropped"))
    n_lines = rows.groupBy("doc_id").agg(F.count("*").alias("n_lines")).withColumnRenamed("doc_id", "__doc")
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id")).distinct()
    joined = ids.join(n_lines, F.col("__id").eqNullSafe(F.col("__doc")), "left").join(per_doc, F.col("__id").eqNullSafe(F.col("doc_id")), "left")
    zero, none = F.lit(0).cast("long"), F.expr("cast(array() AS array<int>)")
    return joined.select(
        F.col("__id").alias("doc_id"), F.coalesce("n_lines", zero).alias("n_lines"),
        F.size(F.coalesce("dropped", none)).cast("long").alias("n_repeated"), F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("dropped", none).alias("dropped"),
    )
