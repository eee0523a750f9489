"""Statistics of many columns from one aggregation, and exact order statistics at any size."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewell.functions.exprs import (
    EDGE_SPACE,
    FALSE_WORDS,
    NUMBER_DECORATION,
    NUMBER_PATTERN,
    TRUE_WORDS,
    as_double,
    c,
    count_sql,
    double_sql,
    inline_sql,
    is_numeric,
    lit_double,
    lit_text,
    looks_like_date,
    missing_sql,
    nan_to_null,
    present_sql,
    q,
    row_fingerprint,
)
from scorewell.session import materialize

COLUMNS_PER_PASS = 200
# A sketch of 2**12 registers has a relative error of about 1.04 / sqrt(2**12).
DISTINCT_SKETCH_BITS = 12
DISTINCT_ERROR = 0.0163
BUFFER_VALUES = 500_000
PAIRS_PER_PASS = 400
# A task holds five square blocks of so many columns (10 MB), and so many rows as doubles.
DENSE_COLUMNS, DENSE_ROWS = 512, 8_192
# Below this share of the sum of squares a spread has lost too many digits.
DIGITS_LEFT = 1e-7
SKETCH_ACCURACY = 5_000


def sketched_distinct(value: str) -> str:
    """Distinct non-missing values from a sketch whose buffer is a few kilobytes."""
    sketch = f"hll_sketch_agg(if({value} IS NULL, null, xxhash64({value})), {DISTINCT_SKETCH_BITS})"
    return f"coalesce(hll_sketch_estimate({sketch}), 0L)"


def aggregate(df: DataFrame, exprs: dict[str, str]) -> Row:
    """One row of aggregates, each given as SQL text under its name."""
    return df.selectExpr(*[f"{sql} AS {q(name)}" for name, sql in exprs.items()]).first()


def _measures(df: DataFrame, name: str, wanted: Iterable[str]) -> dict[str, str]:
    dtype = df.schema[name].dataType
    value = present_sql(name, dtype)
    text = isinstance(dtype, T.StringType)
    out: dict[str, str] = {}
    if "missing" in wanted:
        out["missing"] = count_sql(missing_sql(name, dtype))
    if "range" in wanted:
        out["min"], out["max"] = f"min({value})", f"max({value})"
    if "constant" in wanted:
        out["constant"] = f"coalesce(min({value}) = max({value}), true)"
    if "distinct" in wanted:
        out["distinct"] = sketched_distinct(value)
    if "moments" in wanted and is_numeric(dtype):
        x = double_sql(df, name)
        out |= {"mean": f"avg({x})", "std": f"stddev_samp({x})", "std_pop": f"stddev_pop({x})", "skew_pop": f"skewness({x})"}
    if "text" in wanted and text:
        out["avg_len"] = f"avg(length({value}))"
    if "numeric_like" in wanted and text:
        out["numeric_like"] = count_sql(f"regexp_replace({value}, r'{NUMBER_DECORATION}', '') RLIKE r'{NUMBER_PATTERN}'")
    if "padded" in wanted and text:
        out["padded"] = count_sql(f"regexp_replace({value}, r'{EDGE_SPACE}', '') <> {value}")
    if "boolean_like" in wanted and text:
        words = ", ".join(lit_text(w) for w in TRUE_WORDS + FALSE_WORDS)
        known = f"lower({value}) IN ({words})"
        out["boolean_like"] = count_sql(known)
        # A set of at most twelve words.
        out["boolean_words"] = f"size(collect_set(if({known}, lower({value}), null)))"
    return out


def summarize(df: DataFrame, wanted: Sequence[str], cols: Sequence[str] | None = None) -> tuple[int, dict[str, dict]]:
    """Row count and the wanted measures per column, as driver values.

    One aggregation for up to ``COLUMNS_PER_PASS`` columns; wider tables take a scan per batch of
    columns, each reading its own columns only.
    """
    cols = list(df.columns if cols is None else cols)
    result: dict[str, dict] = {}
    n_rows = 0
    for start in range(0, max(len(cols), 1), COLUMNS_PER_PASS):
        batch = cols[start : start + COLUMNS_PER_PASS]
        places, exprs = [], {"n": "count(1)"}
        for name in batch:
            for key, sql in _measures(df, name, wanted).items():
                places.append((name, key))
                exprs[f"m{len(places)}"] = sql
        source = df
        if "date_like" in wanted:
            texts = [x for x in batch if isinstance(df.schema[x].dataType, T.StringType)]
            source = df.select("*", *[looks_like_date(c(x)).alias(f"__date{i}") for i, x in enumerate(texts)])
            for i, name in enumerate(texts):
                places.append((name, "date_like"))
                exprs[f"m{len(places)}"] = count_sql(f"__date{i}")
        row = aggregate(source, exprs)
        n_rows = row["n"]
        for i, (name, key) in enumerate(places, 1):
            result.setdefault(name, {})[key] = row[f"m{i}"]
    return n_rows, result


def adjusted_skew(skew_pop: float | None, n: int) -> float | None:
    """Sample skewness from the population one; null below three values."""
    if skew_pop is None or n < 3:
        return None
    return skew_pop * math.sqrt(n * (n - 1)) / (n - 2)


def long_cells(df: DataFrame, cols: Sequence[str], as_type: str, keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value) rows of the given columns, after those to ``keep``; missing cells are left out."""
    cells = [
        f"struct({lit_text(x)} AS feature, cast({present_sql(x, df.schema[x].dataType)} AS {as_type}) AS value)" for x in cols
    ]
    return df.selectExpr(*map(q, keep), inline_sql(cells)).where("value IS NOT NULL")


def value_counts(
    df: DataFrame, cols: Sequence[str], as_type: str = "string", extra: dict[str, Column] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """(feature, value, n): each column's values counted, folded per task before the shuffle; ``extra`` aggregates read the columns to ``keep``."""
    more = [column.alias(name) for name, column in (extra or {}).items()]
    return long_cells(df, cols, as_type, keep).groupBy("feature", "value").agg(F.count("*").alias("n"), *more)


def exact_distinct(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Distinct non-missing values per column."""
    if not cols:
        return {}
    counts = value_counts(df, cols).groupBy("feature").agg(F.count("*").alias("n"))
    found = {row["feature"]: row["n"] for row in counts.collect()}
    return {name: found.get(name, 0) for name in cols}


def settle_distinct(df: DataFrame, approx: dict[str, int], cutoffs: dict[str, Sequence[float]]) -> dict[str, int]:
    """Distinct counts good enough to compare with ``cutoffs``.

    The sketched count stands where it is far from every cut-off of its column; columns whose
    count could fall on either side are counted exactly, together in one pass.
    """
    slack = 6 * DISTINCT_ERROR
    near = [
        name
        for name, count in approx.items()
        if any(abs(count - cut) <= max(3.0, slack * cut) for cut in cutoffs.get(name, ()))
    ]
    return {**approx, **exact_distinct(df, near)}


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], buffer_values: int = BUFFER_VALUES, min_values: int = 0
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, exact at any size, as driver values.

    ``percentile`` keeps every distinct value of its input in one buffer, so it only ever sees a
    bounded number of them. Columns with few distinct values go to it whole. For the others each
    quantile is first enclosed in an interval from a sketch, the values below and inside are
    counted, and this repeats until few enough are inside; each step is a scan with no shuffle.
    Where a value that is repeated a lot keeps an interval wide, the interval's ends are cut off.
    Columns with fewer than ``min_values`` values are left out.
    """
    cols, probs = list(cols), list(probs)
    if not cols:
        return {}
    values = {name: double_sql(df, name) for name in cols}
    margin = 3.0 / SKETCH_ACCURACY
    around = ", ".join(lit_double(e) for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin)))
    row = aggregate(
        df,
        {f"n{i}": f"count({v})" for i, v in enumerate(values.values())}
        | {f"d{i}": sketched_distinct(v) for i, v in enumerate(values.values())}
        | {f"c{i}": f"percentile_approx({v}, array({around}), {SKETCH_ACCURACY})" for i, v in enumerate(values.values())},
    )
    sizes = {name: row[f"n{i}"] for i, name in enumerate(cols)}
    share = max(1_000, buffer_values // (len(cols) * max(len(probs), 1)))
    # (column, prob) -> [interval or None for the whole column, values below it, inside it, small enough].
    bands = {(x, p): [None, 0, sizes[x], row[f"d{i}"] <= share] for i, x in enumerate(cols) for p in probs}
    # The first intervals come with the sizes.
    ends = {
        (x, p): (row[f"c{i}"][2 * j], row[f"c{i}"][2 * j + 1]) if row[f"c{i}"] else None
        for i, x in enumerate(cols)
        for j, p in enumerate(probs)
    }

    def rank(name: str, p: float) -> float:
        return (sizes[name] - 1) * p

    def inside(name: str, band: tuple[float, float] | None) -> str:
        v = values[name]
        return f"{v} IS NOT NULL" if band is None else f"{v} BETWEEN {lit_double(band[0])} AND {lit_double(band[1])}"

    def peel(keys: list[tuple[str, float]]) -> None:
        """Cut the least and the greatest value off intervals that a sketch does not narrow: often one is repeated a lot."""
        facts = {}
        for k, (name, p) in enumerate(keys):
            band, v = bands[name, p][0], values[name]
            within = inside(name, band)
            if band is None:
                low, high, facts[f"a{k}"], facts[f"b{k}"] = "true", "true", "0", "0"
            else:
                low, high = f"{v} > {lit_double(band[0])}", f"{v} < {lit_double(band[1])}"
                facts[f"a{k}"], facts[f"b{k}"] = (count_sql(f"{v} = {lit_double(x)}") for x in band)
            facts[f"l{k}"] = f"min(if({within} AND {low}, {v}, null))"
            facts[f"h{k}"] = f"max(if({within} AND {high}, {v}, null))"
        found = aggregate(df, facts)
        for k, (name, p) in enumerate(keys):
            band, below, count, _ = bands[name, p]
            first, last, least, most = found[f"a{k}"], found[f"b{k}"], found[f"l{k}"], found[f"h{k}"]
            at = rank(name, p)
            low, high = math.floor(at) - below, math.ceil(at) - below
            if band is None:
                bands[name, p] = [(least, most), 0, count, least == most]
            elif high < first:
                bands[name, p] = [(band[0], band[0]), below, first, True]
            elif low >= count - last:
                bands[name, p] = [(band[1], band[1]), below + count - last, last, True]
            elif low < first or high >= count - last:
                # Between an end and its neighbour: both values are known.
                a, b = (band[0], least) if low < first else (most, band[1])
                settled[name, p] = a + (b - a) * (at - math.floor(at))
                bands[name, p][3] = True
            else:
                bands[name, p] = [(least, most), below + first, count - first - last, least == most]

    settled: dict[tuple, float] = {}
    while wide := [key for key, b in bands.items() if not b[3] and b[2] > share]:
        if not ends:
            cuts = {}
            for k, (name, p) in enumerate(wide):
                band, below, count, _ = bands[name, p]
                at = (rank(name, p) - below) / count
                kept = f"if({inside(name, band)}, {values[name]}, null)"
                pair = f"{lit_double(max(0.0, at - margin))}, {lit_double(min(1.0, at + 1 / count + margin))}"
                cuts[f"c{k}"] = f"percentile_approx({kept}, array({pair}), {SKETCH_ACCURACY})"
            found = aggregate(df, cuts)
            ends = {key: tuple(found[f"c{k}"]) for k, key in enumerate(wide)}
        counted = aggregate(
            df,
            {f"b{k}": count_sql(f"{values[x]} < {lit_double(ends[x, p][0])}") for k, (x, p) in enumerate(wide)}
            | {f"i{k}": count_sql(inside(x, ends[x, p])) for k, (x, p) in enumerate(wide)},
        )
        slow = []
        for k, (name, p) in enumerate(wide):
            below, count = counted[f"b{k}"], counted[f"i{k}"]
            holds = below <= math.floor(rank(name, p)) and math.ceil(rank(name, p)) < below + count
            before = bands[name, p][2]
            if holds and count < before:
                # One repeated value is small whatever its count.
                bands[name, p] = [ends[name, p], below, count, ends[name, p][0] == ends[name, p][1]]
            if not bands[name, p][3] and (not holds or 2 * count > before):
                slow.append((name, p))
        if slow:
            peel(slow)
        ends = {}

    def place(name: str, p: float) -> float:
        _, below, count, _ = bands[name, p]
        return min(1.0, max(0.0, (rank(name, p) - below) / (count - 1))) if count > 1 else 0.0

    # Quantiles read from the same interval share one buffer.
    shared: dict[tuple, list[float]] = {}
    for name, p in bands:
        if (name, p) not in settled:
            shared.setdefault((name, bands[name, p][0]), []).append(p)
    row = {} if not shared else aggregate(
        df,
        {
            f"q{k}": f"percentile(if({inside(name, band)}, {values[name]}, null), "
            f"array({', '.join(lit_double(place(name, p)) for p in ps)}))"
            for k, ((name, band), ps) in enumerate(shared.items())
        },
    )
    flat: dict[tuple, float | None] = dict(settled)
    for k, ((name, _), ps) in enumerate(shared.items()):
        for p, value in zip(ps, row[f"q{k}"] or [None] * len(ps)):
            flat[name, p] = value
    return {name: [flat[name, p] for p in probs] for name in cols if sizes[name] >= min_values}


def exact_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest among equals, in the column's own type."""
    if not cols:
        return {}
    by_type: dict[str, list[str]] = {}
    for name in cols:
        by_type.setdefault(df.schema[name].dataType.simpleString(), []).append(name)
    modes: dict[str, object] = {}
    for dtype, names in by_type.items():
        best = (
            value_counts(df, names, dtype)
            .groupBy("feature")
            .agg(F.max("n").alias("n"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
        )
        modes |= {row["feature"]: row["value"] for row in best.collect()}
    return {name: modes.get(name) for name in cols}


def duplicate_count(df: DataFrame) -> int:
    """Rows beyond the first of each set of equal rows, from 16 bytes per row."""
    clean = nan_to_null(df)
    folded = clean.select(*row_fingerprint(clean)).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    row = folded.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra")).first()
    return int(row["extra"])


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width counts between the smallest and largest value; empty bins are kept."""
    x = as_double(df, col)
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if span["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    low, high = span["lo"], span["hi"]
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    slot = F.least(F.lit(bins), F.floor((x - F.lit(low)) / F.lit(width)).cast("int") + 1)
    counted = df.where(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return frame.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def co_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, si, sj, qi, qj, p, endless) for places i < j of ``cols``, over the rows where both are present.

    Sums, sums of squares and of products of the distances from each column's mean over the table; ``endless`` counts rows
    with an infinite value. Each task multiplies its batches as dense blocks, missing cells as zeros beside a mask, and gives one
    row per pair; those are added up by pair. Two scans (one for the means) for 200 columns; the scans grow with the columns
    for the means, and beyond ``DENSE_COLUMNS`` with pairs of blocks of columns. A table without partitions gives no rows.
    """
    cols = list(cols)
    values = df.selectExpr(*[f"{double_sql(df, x)} AS v{i}" for i, x in enumerate(cols)])
    finite = "if(abs(v{0}) < double('infinity'), v{0}, null)"
    facts: dict = {}
    for start in range(0, len(cols), COLUMNS_PER_PASS):
        some = range(start, min(start + COLUMNS_PER_PASS, len(cols)))
        row = values.selectExpr(*[f"{agg}({finite.format(i)}) AS {agg}{i}" for i in some for agg in ("avg", "min", "max")])
        facts |= row.first().asDict()
    # A constant's mean may be off in its last digit; its distances must be exactly zero.
    center = [facts[f"min{i}"] if facts[f"min{i}"] == facts[f"max{i}"] else facts[f"avg{i}"] for i in range(len(cols))]
    center = [x if x is not None and math.isfinite(x) else 0.0 for x in center]
    parts = [_block_moments(values, at, front, center) for at, front in _column_blocks(len(cols))]
    sums = ("n", "si", "sj", "qi", "qj", "p", "endless")
    return reduce(DataFrame.unionByName, parts).groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in sums])


def _column_blocks(n: int) -> list[tuple[list[int], int]]:
    """Lists of columns that hold each pair once: of a list with a front, the pairs between the front (of that length) and the others."""
    if n <= DENSE_COLUMNS:
        return [(list(range(n)), 0)]
    half = DENSE_COLUMNS // 2
    blocks = [list(range(a, min(a + half, n))) for a in range(0, n, half)]
    out = [(block, 0) for block in blocks]
    return out + [(x + y, len(x)) for k, x in enumerate(blocks) for y in blocks[k + 1 :]]


def _block_moments(values: DataFrame, at: list[int], front: int, center: list[float]) -> DataFrame:
    """The task's own sums for pairs of the columns ``at``: all of them, or, with a ``front``, one of it and one after it."""
    k, shift = len(at), np.array([center[i] for i in at])
    left, right = np.triu_indices(k, 1)
    if front:
        across = (left < front) & (right >= front)
        left, right = left[across], right[across]
    place = np.array(at)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, first, square, cross, endless = np.zeros((5, k, k))
        for batch in batches:
            for start in range(0, batch.num_rows, DENSE_ROWS):
                part = batch.slice(start, DENSE_ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
                known, wild = ~np.isnan(x), np.isinf(x)
                x = np.where(known & ~wild, x - shift, 0.0)
                mask = known.astype(float)
                both += mask.T @ mask
                first += x.T @ mask
                square += (x * x).T @ mask
                cross += x.T @ x
                if wild.any():
                    endless += wild.astype(float).T @ mask
        facts = {
            "i": place[left], "j": place[right], "n": both[left, right].astype(np.int64), "si": first[left, right], "sj": first[right, left],
            "qi": square[left, right], "qj": square[right, left], "p": cross[left, right],
            "endless": (endless[left, right] + endless[right, left]).astype(np.int64),
        }
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in facts.values()], list(facts))

    schema = "i long, j long, n long, si double, sj double, qi double, qj double, p double, endless long"
    return values.select(*[f"v{i}" for i in at]).mapInArrow(work, schema)


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr) for every pair of columns over the rows where both are present.

    From the co-moments of all pairs. Where a pair's rows lie so far from the mean of the whole column that the sums lose digits, the pair
    is measured by an aggregation of its own; no scan more is needed where there is no such pair. Null where a column has fewer
    than two values there, no spread, or an infinite value.
    """
    cols = list(cols)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    spread = "least((qi - si * si / n) / qi, (qj - sj * sj / n) / qj)"
    found = co_moments(df, cols).selectExpr("*", f"if(n > 1 AND endless = 0 AND qi > 0 AND qj > 0, {spread}, null) AS left_over")
    found = materialize(found, "moments")
    if found.isEmpty():
        return reduce(DataFrame.unionByName, _measured_pairs(df, [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]))
    corr = "(p - si * sj / n) / sqrt((qi - si * si / n) * (qj - sj * sj / n))"
    names = f"array({', '.join(map(lit_text, cols))})"
    doubtful = [(cols[r["i"]], cols[r["j"]]) for r in found.where(F.col("left_over") < DIGITS_LEFT).select("i", "j").collect()]
    certain = found.where(f"left_over IS NULL OR left_over >= {lit_double(DIGITS_LEFT)}")
    sure = certain.selectExpr(f"{names}[i] AS a", f"{names}[j] AS b", f"if(left_over IS NULL OR isnan({corr}), null, {corr}) AS corr")
    return reduce(DataFrame.unionByName, [sure, *_measured_pairs(df, doubtful)])


def _measured_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> list[DataFrame]:
    """Correlations by one aggregation per ``PAIRS_PER_PASS`` pairs."""
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        batch = pairs[start : start + PAIRS_PER_PASS]
        sides = [(double_sql(df, a), double_sql(df, b)) for a, b in batch]
        # A column without spread has no correlation; corr() would divide by zero.
        spread = [f"sqrt(var_pop(if({y} IS NULL, null, {x})) * var_pop(if({x} IS NULL, null, {y})))" for x, y in sides]
        row = df.selectExpr(*[f"try_divide(covar_pop({x}, {y}), {s}) AS r{i}" for i, ((x, y), s) in enumerate(zip(sides, spread))])
        rows = [
            f"struct({lit_text(a)} AS a, {lit_text(b)} AS b, if(isnan(r{i}), null, r{i}) AS corr)"
            for i, (a, b) in enumerate(batch)
        ]
        parts.append(row.selectExpr(inline_sql(rows)))
    return parts


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing, rate): one aggregation, then one report row per column."""
    counts = df.selectExpr(
        "count(1) AS n", *[f"{count_sql(missing_sql(f.name, f.dataType))} AS m{i}" for i, f in enumerate(df.schema)]
    )
    rows = [
        f"struct({lit_text(name)} AS column, m{i} AS missing, coalesce(try_divide(double(m{i}), n), 0D) AS rate)"
        for i, name in enumerate(df.columns)
    ]
    return counts.selectExpr(inline_sql(rows))
