"""Periodic runs in the words of texts, by difference-cover LCE and harmonic-grid enumeration.

A run is a stretch of words with smallest period q that is at least ``repeats`` periods and ``least`` words long and
that no neighbouring word extends keeping period q. Words at i and i + q are equal all along a run but its
last q words, so such a stretch of equal pairs has at least (repeats - 1) * q places and holds a multiple of (repeats - 1) * q: for every q
it is enough to look at that grid, which is n/1 + n/2 + n/3 + ... pairs in all. From each grid pair the longest common extension (LCE) to
either side gives the run.

An LCE takes constant time. Only suffixes at the places of a difference cover are sorted (6 of 31 places); two
suffixes are compared word by word until both are at such a place, which takes at most 30 words, and the rest
is the least of the sorted neighbours' common prefixes between them, from a sparse table.

Several texts are worked on at once, with words of their own between them that no run can hold.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.batches import slices

LEAST_WORDS, REPEATS = 6, 4
CYCLE, COVER = 31, (0, 1, 3, 8, 12, 18)  # every difference modulo 31 is that of two places of the cover
WORDS_AT_ONCE = 1 << 15
PAIRS_AT_ONCE = 1 << 20
RUN = "struct<start:long,length:long,period:long>"


def _shifts() -> np.ndarray:
    """The least step that brings places with residues a and b onto the cover together."""
    out = np.full((CYCLE, CYCLE), -1, np.int64)
    a, b = np.meshgrid(np.arange(CYCLE), np.arange(CYCLE), indexing="ij")
    on = np.isin(np.arange(CYCLE), COVER)
    for s in reversed(range(CYCLE)):
        out[on[(a + s) % CYCLE] & on[(b + s) % CYCLE]] = s
    return out


SHIFTS = _shifts()


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows, the first key weighing most."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty_like(new)
    out[order] = np.cumsum(new)
    return out


class Extensions:
    """Longest common extensions of places in ``words``, whose first and last word occur once. Suffixes are sorted on first need."""

    def __init__(self, words: np.ndarray):
        self.words, self.table = words, None

    def _sort(self) -> None:
        n = len(self.words)
        places = np.sort(np.concatenate([np.arange(c, n, CYCLE) for c in COVER]))
        nth = np.full(n + 1, -1, np.int64)
        nth[places] = np.arange(len(places))
        padded = np.concatenate([self.words, np.full(CYCLE + 1, -1, np.int64)]) + 1
        # Ranks by the first CYCLE words (two to a key), then by twice as many at every step.
        keys = [padded[places + t] << 32 | (padded[places + t + 1] if t + 1 < CYCLE else 0) for t in range(0, CYCLE, 2)]
        ranks, step = [_rank(*keys)], CYCLE
        while ranks[-1].max() + 1 < len(places):
            after = np.where(places + step < n, nth[np.minimum(places + step, n)], -1)
            ranks.append(_rank(ranks[-1], np.where(after < 0, -1, ranks[-1][after])))
            step *= 2
        order = np.argsort(ranks[-1])
        # Common prefixes of sorted neighbours: the widest equal steps first, then word by word.
        a, b = places[order[:-1]].copy(), places[order[1:]].copy()
        common = np.zeros(len(a), np.int64)
        for level in reversed(range(len(ranks))):
            i, j = nth[np.minimum(a, n)], nth[np.minimum(b, n)]
            same = (i >= 0) & (j >= 0) & (ranks[level][i] == ranks[level][j])
            jump = same * (CYCLE << level)
            a, b, common = a + jump, b + jump, common + jump
        left = np.arange(len(a))
        for _ in range(CYCLE):
            left = left[(a[left] < n) & (b[left] < n)]
            left = left[self.words[a[left]] == self.words[b[left]]]
            a[left] += 1
            b[left] += 1
            common[left] += 1
        self.nth, self.rank, self.table = nth, ranks[-1], [common]
        while 2 << (len(self.table) - 1) <= len(common):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places a (< b) on equal those from b on."""
        out = SHIFTS[a % CYCLE, b % CYCLE]
        left, step = np.arange(len(a)), 0
        while len(left):
            left = left[out[left] > step]
            differ = self.words[a[left] + step] != self.words[b[left] + step]
            out[left[differ]] = ~step  # negative: settled before the cover is reached
            left, step = left[~differ], step + 1
        far = np.flatnonzero(out >= 0)
        if len(far):
            if self.table is None:
                self._sort()
            i, j = self.rank[self.nth[a[far] + out[far]]], self.rank[self.nth[b[far] + out[far]]]
            low, high = np.minimum(i, j), np.maximum(i, j)
            level = np.frexp(high - low)[1] - 1
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                row = self.table[k]
                out[far[at]] += np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return np.where(out < 0, ~out, out)


def runs_in(words: np.ndarray, longest: int, least: int = LEAST_WORDS, repeats: int = REPEATS) -> np.ndarray:
    """(start, end, period) of all runs, by start, then period. ``words`` begins and ends with numbers that occur once."""
    n, forward, back, found = len(words), Extensions(words), Extensions(words[::-1].copy()), []
    stride = repeats - 1
    periods = np.arange(1, longest // repeats + 1)
    sizes = (n - 1 - periods) // (stride * periods) + 1  # grid places 0, stride * q, ... below n - q
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS_AT_ONCE, sizes.sum(), PAIRS_AT_ONCE)) + 1
    for q, size in zip(np.split(periods, cuts), np.split(sizes, cuts)):
        q = np.repeat(q, size)
        a = (np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)) * q * stride
        equal = words[a] == words[a + q]
        a, q = a[equal], q[equal]
        end = a + q + forward.between(a, a + q)
        start = a + 1 - back.between(n - 1 - a - q, n - 1 - a)
        ok = end - start >= np.maximum(least, repeats * q)
        found.append(np.stack([start[ok], end[ok], q[ok]], 1))
    all_found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    # A multiple of the smallest period gives the same stretch again.
    order = np.lexsort((all_found[:, 2], all_found[:, 1], all_found[:, 0]))
    all_found = all_found[order]
    new = np.ones(len(all_found), bool)
    new[1:] = (all_found[1:, :2] != all_found[:-1, :2]).any(1)
    all_found = all_found[new]
    return all_found[np.lexsort((all_found[:, 2], all_found[:, 0]))]


def _groups(texts: list[list[bytes]]) -> Iterator[list[int]]:
    """Texts of like length together, up to WORDS_AT_ONCE words; a longer text alone."""
    group, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if group and size + len(texts[i]) > WORDS_AT_ONCE:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(texts[i])
    if group:
        yield group


def periodic(texts: list[list[bytes]], least: int, repeats: int) -> tuple[list[np.ndarray], list[bytes]]:
    """The runs of each text, and its words but those that a run holds after its first period, joined by spaces."""
    runs, collapsed = [None] * len(texts), [b""] * len(texts)
    for group in _groups(texts):
        number = defaultdict(count(len(group) + 1).__next__)
        parts, starts, at = [np.zeros(1, np.int64)], [], 1
        for k, i in enumerate(group):
            starts.append(at)
            parts.append(np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i])))
            parts.append(np.array([k + 1]))
            at += len(texts[i]) + 1
        found = runs_in(np.concatenate(parts), len(texts[group[-1]]), least, repeats)
        edges = np.zeros(at + 1, np.int64)
        np.add.at(edges, found[:, 0] + found[:, 2], 1)
        np.add.at(edges, found[:, 1], -1)
        dropped = np.cumsum(edges) > 0
        firsts = np.searchsorted(found[:, 0], np.array([*starts, at]))
        for k, i in enumerate(group):
            mine = found[firsts[k] : firsts[k + 1]] - [starts[k], starts[k], 0]
            mine[:, 1] -= mine[:, 0]
            runs[i] = mine
            words = texts[i]
            if len(mine):
                keep = ~dropped[starts[k] : starts[k] + len(words)]
                words = [w for w, x in zip(words, keep.tolist()) if x]
            collapsed[i] = b" ".join(words)
    return runs, collapsed


def with_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS, repeats: int = REPEATS) -> DataFrame:
    """``docs`` with ``runs`` (structs of start, length and period in words, by start, then period) and ``collapsed``, the text without what runs repeat.

    Words are what stands between ASCII white space. A null text and one without words have no runs and an empty
    ``collapsed``. Every row is worked on by itself, repeated ids and rows too; whatever other columns there are
    stay, one named runs or collapsed is replaced. No text is cut: time grows as n log n and memory as n, so a task needs room for its
    longest text. An empty table gives an empty table. Nothing is shuffled.
    """
    if repeats < 2:
        raise ValueError("a run has at least two periods")
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    at = kept.index(text_col)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column(at), "").cast(pa.binary()).to_pylist()
            runs, collapsed = periodic([t.split() for t in texts], least, repeats)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
            all_runs = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(all_runs[:, k]) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(offsets, structs)
            strings = pa.array(collapsed, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, strings], [*kept, "runs", "collapsed"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(work, f"{fields}, runs array<{RUN}>, collapsed string")


WORDS = r"[^\x20\x09-\x0D]+"


def with_echoes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where one text in ten repeats a stretch of its words to its end.

    With h the crc32 of the decimal id (of nothing for a null id), g = h div 10 and n words, h % 10 = 0 and n > 0: from word a = g % n on,
    words repeat with period 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    split = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    parts = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), split.alias("w"))
    parts = parts.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n AS int)")))
    parts = parts.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    echo = "array_join(transform(sequence(0, n - 1), i -> w[if(i < a, i, a + (i - a) % p)]), ' ')"
    return parts.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {echo} ELSE text END").alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of ``with_runs``: how many runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(concat_ws(',', r.start, r.length, r.period), '\n')), '')")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
