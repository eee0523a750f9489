"""Token sequences of one length from documents of any length, as a cutting-stock problem solved by column generation.

Documents become ids. What fills whole sequences by itself is cut off; the rests, one per document, have lengths below the capacity, and only
their histogram (at most ``capacity`` numbers) reaches the driver. Lengths within a few per cent form a class. A linear program
over patterns (how many rests of each class share a sequence) is solved by generating columns: the duals price the classes, a knapsack by
dynamic programming finds the best new pattern, until none pays. Patterns are used as often as their values rounded down say;
what is left over, and the rests of the worst-filled sequences, closes the gaps of the others, whole where one fits and cut where none does. So
all sequences are full but the last few, which have lengths of a power of two.

All of this works on runs: consecutive ranks of rests of one length that are treated alike. The outcome is a table of runs whose size depends on
the capacity, not on the data. A document finds its place by its length and its rank among those of that length, which is its number in
its own block of rows plus what earlier blocks hold: no document is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewell.llm.batches import sized, slices
from scorewell.llm.word_ids import encoder
from scorewell.session import materialize

CAPACITY = 4096
CLASS_WIDTH, CLASS_IDS = 1.04, 8  # the lengths of a class differ by 4 %, or by less than 8
GAP = 1e-3  # sequences beyond the linear program's bound, as a share, at which no more patterns are made

# ---------------------------------------------------------------- patterns


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of sizes that fits, by dynamic programming over the capacity, size by size."""
    best, history = np.zeros(capacity + 1), []
    for u, v in zip(sizes.tolist(), prices.tolist()):
        history.append(best)
        if v <= 0:
            continue
        rows = -(-(capacity + 1) // u)
        grid = np.full(rows * u, -np.inf)
        grid[: capacity + 1] = best
        paid = np.arange(rows)[:, None] * v
        best = (np.maximum.accumulate(grid.reshape(rows, u) - paid, axis=0) + paid).ravel()[: capacity + 1]
    counts, at, worth = np.zeros(len(sizes)), capacity, best[capacity]
    for k in reversed(range(len(sizes))):
        if prices[k] > 0:
            choices = history[k][at :: -sizes[k]] if sizes[k] <= at else history[k][at : at + 1]
            j = int(np.argmax(choices + np.arange(len(choices)) * prices[k]))
            counts[k] = j
            at -= j * int(sizes[k])
    return float(worth), counts


def generate_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per row) and how often to use each, so that every size is met exactly with the fewest sequences, up to GAP.

    Revised simplex: patterns of one size alone to begin with, then the pattern that the duals price highest. Duals divided by that
    price are feasible, so the sum of ``x`` over the price is a lower bound, and so is the sum of all ids over the capacity.
    """
    alone = capacity // sizes
    inverse, columns, x = np.diag(1.0 / alone), np.diag(alone).astype(float), demand / alone
    bound = sizes @ demand / capacity
    for _ in range(30 * len(sizes)):  # every basis is a valid plan, so a stop here costs fill only
        worth, pattern = knapsack(sizes, inverse.sum(0), capacity)
        bound = max(bound, x.sum() / max(worth, 1))
        if x.sum() <= (1 + GAP) * bound:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        r = int(np.argmin(ratio))
        x = np.maximum(x - ratio[r] * step, 0)
        x[r] = ratio[r]
        inverse[r] /= step[r]
        others = np.arange(len(x)) != r
        inverse[others] -= np.outer(step[others], inverse[r])
        columns[r] = pattern
    return columns.astype(np.int64), x


# ---------------------------------------------------------------- runs

# A run (rest, first, n, cut, length): documents ranked first .. first + n - 1 among those with a rest of that length, and of each its ids from cut on.
# A group (rest, first, cut, length, m): sequence i of several holds the documents ranked first + i * m .. first + i * m + m - 1.


class Bins:
    """``count`` sequences filled alike: groups, and how much room is left."""

    def __init__(self, count: int, groups: list[tuple], room: int, capacity: int):
        self.count, self.groups, self.room, self.capacity = count, groups, room, capacity

    def split(self, count: int) -> Bins:
        """Keep the first ``count`` sequences and return the others."""
        rest = [(s, a + count * m, o, l, m) for s, a, o, l, m in self.groups]
        other = Bins(self.count - count, rest, self.room, self.capacity)
        self.count = count
        return other

    def add(self, group: tuple) -> None:
        self.groups.append(group)
        self.room -= group[3] * group[4]


class Pool:
    """Runs by length."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []
        self.ids = 0

    def put(self, run: tuple) -> None:
        if run[2] and run[4]:
            if run[4] not in self.runs:
                self.runs[run[4]] = []
                insort(self.lengths, run[4])
            self.runs[run[4]].append(run)
            self.ids += run[2] * run[4]

    def take(self, length: int, most: int) -> tuple:
        """Up to ``most`` documents of one run of a length."""
        rest, first, n, cut, _ = self.runs[length].pop()
        if not self.runs[length]:
            del self.runs[length]
            self.lengths.remove(length)
        self.ids -= n * length
        got = min(n, most)
        self.put((rest, first + got, n - got, cut, length))
        return rest, first, got, cut, length

    def fill(self, bins: Bins) -> list[Bins]:
        """Close all room: the longest that fits, as often as it fits; where none fits, the longest is cut."""
        todo, done = [bins], []
        while todo:
            b = todo.pop()
            while b.room and self.lengths:
                at = bisect_right(self.lengths, b.room)
                length = self.lengths[at - 1] if at else self.lengths[-1]
                have = self.runs[length][-1][2]
                times = max(1, min(b.room // length, have // b.count)) if at else 1
                if have < b.count * times:
                    todo.append(b.split(have))
                rest, first, n, cut, _ = self.take(length, b.count * times)
                size = length if at else b.room
                b.add((rest, first, cut, size, times))
                self.put((rest, first, n, cut + size, length - size))
            done.append(b)
        return done


def _classes(histogram: dict[int, int]) -> list[list[int]]:
    """Lengths in descending order, cut where the next is too short for the class."""
    out: list[list[int]] = []
    for length in sorted(histogram, reverse=True):
        if out and (length * CLASS_WIDTH >= out[-1][0] or length > out[-1][0] - CLASS_IDS):
            out[-1].append(length)
        else:
            out.append([length])
    return out


def _draw(queue: list[list], n: int, m: int) -> Iterator[tuple[int, list[tuple]]]:
    """``m`` documents for each of ``n`` sequences from the end of a queue of runs: (sequences, their groups)."""
    while n:
        rest, first, have, cut, length = queue[-1]
        if have >= m:
            c = min(n, have // m)
            yield c, [(rest, first, cut, length, m)]
            used, n = c * m, n - c
        else:
            groups, need = [], m
            while need:
                rest, first, have, cut, length = queue[-1]
                used = min(need, have)
                groups.append((rest, first, cut, length, used))
                need -= used
                if need:
                    queue.pop()
            yield 1, groups
            n -= 1
        if used == have:
            queue.pop()
        else:
            queue[-1] = [rest, first + used, have - used, cut, length]


def _use(pattern: np.ndarray, n: int, queues: list[list], capacity: int) -> Iterator[Bins]:
    """``n`` sequences of a pattern, parted where any class goes on to its next length."""
    drawn = [[list(x) for x in _draw(queues[k], n, int(pattern[k]))] for k in np.flatnonzero(pattern)]
    while n:
        c = min(d[0][0] for d in drawn)
        groups = [g for d in drawn for g in d[0][1]]
        yield Bins(c, groups, capacity - sum(g[3] * g[4] for g in groups), capacity)
        for d in drawn:
            d[0][0] -= c
            d[0][1] = [(s, a + c * m, o, l, m) for s, a, o, l, m in d[0][1]]
            if not d[0][0]:
                d.pop(0)
        n -= c


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Where the rests of each length go: rows (rest, first, n, cut, length, m, sequence, offset), n documents from rank ``first`` on."""
    found: list[Bins] = []
    pool = Pool()
    classes = _classes({k: n for k, n in histogram.items() if k < capacity})
    if classes:
        queues = [[[l, 0, histogram[l], 0, l] for l in c] for c in classes]
        sizes = np.array([c[0] for c in classes])
        patterns, times = generate_columns(sizes, np.array([sum(histogram[l] for l in c) for c in classes], float), capacity)
        for pattern, x in zip(patterns, np.floor(times + 1e-6).astype(np.int64)):
            # Rounding errors must not ask for more than there is.
            x = min([int(x), *[sum(r[2] for r in queues[k]) // int(pattern[k]) for k in np.flatnonzero(pattern)]])
            found += _use(pattern, x, queues, capacity)
        for run in (r for q in queues for r in q):
            pool.put(tuple(run))
    # Take the worst-filled sequences apart until there is enough to fill the others.
    found.sort(key=lambda b: (-b.room, b.count))
    lacking = sum(b.count * b.room for b in found) - pool.ids
    kept = []
    for b in found:
        apart = min(b.count, max(0, -(-lacking // capacity)))
        if apart:
            rest = b.split(apart)
            for s, a, o, l, m in b.groups:
                pool.put((s, a, apart * m, o, l))
            lacking -= apart * capacity
            b = rest
        if b.count:
            kept.append(b)
    kept.sort(key=lambda b: -b.count)  # long runs first, while they find long runs
    done = [x for b in kept for x in pool.fill(b)]
    while pool.ids >= capacity:
        length = pool.lengths[-1]
        n = min(pool.ids // capacity, max(1, pool.runs[length][-1][2] // (capacity // length)))
        done += pool.fill(Bins(n, [], capacity, capacity))
    size = 1 << max(capacity.bit_length() - 1, 0)
    while pool.ids:
        if pool.ids >= size:
            done += pool.fill(Bins(1, [], size, size))
        size >>= 1
    rows, sequence = [], 0
    for b in done:
        offset = 0
        for s, a, o, l, m in b.groups:
            rows.append((s, a, b.count * m, o, l, m, sequence, offset))
            offset += l * m
        sequence += b.count
    if histogram.get(capacity):
        rows.append((capacity, 0, histogram[capacity], 0, capacity, 1, sequence, 0))
    return np.array(rows, np.int64).reshape(-1, 8)


# ---------------------------------------------------------------- documents


def _rests(docs: DataFrame, kind: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per stretch of ``capacity`` ids and one for the rest: with its task's block, and its number there among those of its length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen, end = TaskContext.get().partitionId(), {}, np.array([end_id], "<u4").tobytes()
        encode = encoder(tokenizer).encode
        for batch in sized(batches, 1):
            row, start, total, nth, ids = [], [], [], [], []
            for i, data in enumerate(encode(pc.fill_null(batch.column(1), ""))):
                data += end
                for at in range(0, len(data), 4 * capacity):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    start.append(at // 4)
                    total.append(len(data) // 4)
                    nth.append(seen.get(len(part), 0))
                    seen[len(part)] = nth[-1] + 1
                    ids.append(part)
            numbers = [pa.array(x, pa.int64()) for x in (start, total, [len(x) // 4 for x in ids], nth, [block] * len(row))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *numbers, pa.array(ids, pa.binary())],
                ["key", "start", "total", "rest", "nth", "block", "ids"],
            )

    return docs.mapInArrow(work, f"key {kind}, start long, total long, rest long, nth long, block long, ids binary")


def _placed(rests: DataFrame, kind: str, rows: np.ndarray, capacity: int, id_col: str) -> DataFrame:
    """Look up the plan for every rest: its first piece, then what follows where it is cut."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 3], rows[:, 0]))]
    shift = 38
    keys = (rows[:, 0] * (capacity + 1) + rows[:, 3] << shift) + rows[:, 1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            start, total, rest, rank = (batch.column(k).to_numpy() for k in range(1, 5))
            ids = batch.column(5).to_pylist()
            left, cut, out = np.arange(len(rest)), np.zeros(len(rest), np.int64), []
            while len(left):
                at = np.searchsorted(keys, (rest[left] * (capacity + 1) + cut[left] << shift) + rank[left], side="right") - 1
                _, first, _, _, length, m, sequence, offset = rows[at].T
                i = rank[left] - first
                out.append(np.stack([left, cut[left], length, sequence + i // m, offset + i % m * length]))
                cut[left] += length
                left = left[cut[left] < rest[left]]
            if not out:
                continue
            row, cut, length, sequence, offset = np.concatenate(out, 1)
            pieces = [ids[r][4 * c : 4 * (c + n)] for r, c, n in zip(row.tolist(), cut.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), *map(pa.array, (start[row] + cut, length, total[row], sequence, offset)), pa.array(pieces, pa.binary())],
                [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    schema = f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return rests.select("key", "start", "total", "rest", "rank", "ids").mapInArrow(work, schema)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` ids: (id, start, length, doc_tokens, sequence_id, offset, ids).

    ``start`` counts the document's ids before the piece, ``offset`` those of the sequence; ``ids`` are little-endian unsigned 32-bit
    integers, ``end_id`` ends every document. A null text is an empty one. Null and repeated ids are allowed: every row is a document of its own.
    Extra columns are ignored. A text longer than a sequence fills whole ones first; a task needs room for its longest text. An empty
    table gives an empty result. All sequences are full but at most log2(capacity) + 1 last ones, whose lengths are powers of two.
    """
    if capacity < 2:
        raise ValueError("a sequence holds at least two ids")
    kind = docs.schema[id_col].dataType.simpleString()
    bare = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    rests = materialize(_rests(bare, kind, tokenizer, end_id, capacity), "rests")
    sums = materialize(rests.groupBy("rest", "block").agg((F.max("nth") + 1).alias("n")), "rest_counts")
    earlier = Window.partitionBy("rest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    base = sums.select("rest", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r["rest"]: r["n"] for r in sums.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # ``capacity`` rows at most
    ranked = rests.join(base, ["rest", "block"]).withColumn("rank", F.col("base") + F.col("nth"))
    return _placed(ranked, kind, plan(histogram, capacity), capacity, id_col)


def sequences(pieces: DataFrame, pad_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: (sequence_id, length, ids), padded to ``capacity`` where the length is no power of two.

    One shuffle of the ids; a group is one sequence.
    """
    parts = F.expr("aggregate(sort_array(collect_list(struct(offset, ids))), cast('' AS binary), (x, p) -> concat(x, p.ids))")
    found = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("ids"))
    pad = np.array([pad_id], "<u4").tobytes().hex()
    missing = f"cast(if(length & (length - 1) = 0, 0, {capacity} - length) AS int)"
    return found.withColumn("ids", F.expr(f"concat(ids, unhex(repeat('{pad}', {missing})))"))
