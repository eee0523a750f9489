"""Drift between a reference table and a batch: population stability and two-sample KS."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewell.functions.exprs import double_sql, inline_sql, lit_double, lit_text, q
from scorewell.operators.prefix import MIN_RANGES, quantile_cuts, range_count, running_totals, with_ranges
from scorewell.operators.sampling import uniform_sample
from scorewell.operators.stats import exact_quantiles, long_cells, summarize

# Bins, outer percentiles, epsilon, and the limits of the drift rules.
PSI_BINS = 10
PSI_PERCENTILES = (0.01, 0.99)
PSI_EPSILON = 1e-6
PSI_THRESHOLD, PSI_MODERATE, PSI_HIGH = 0.2, 0.1, 0.2
KS_ALPHA = 0.05
MIN_VALUES = 10
RATIO_HIGH, RATIO_MODERATE = 0.3, 0.1
KS_TERMS = 100


FACTS = ["n", "mean", "std_pop", "lo", "hi", "bins"]
FACTS_SCHEMA = "feature string, n long, mean double, std_pop double, lo double, hi double, bins array<long>"


@dataclass
class DriftReference:
    """What is kept of a reference table: facts, bin edges and bin counts per feature, and its values.

    ``values`` holds (feature, value, n) with one row per distinct value, so it can be saved and
    compared later without the table it came from. While that table is at hand as ``base`` its
    columns are read instead, which saves a shuffle.
    """

    facts: dict[str, dict]
    values: DataFrame
    psi_threshold: float = PSI_THRESHOLD
    ks_alpha: float = KS_ALPHA
    base: DataFrame | None = None

    @property
    def features(self) -> list[str]:
        return list(self.facts)

    def facts_frame(self, spark: SparkSession) -> DataFrame:
        rows = [tuple([f, *[s[k] for k in FACTS]]) for f, s in self.facts.items()]
        return spark.createDataFrame(rows, FACTS_SCHEMA)


def drift_fit(
    df: DataFrame,
    features: Sequence[str],
    sample: int | None = None,
    keys: Sequence[str] = (),
    psi_threshold: float = PSI_THRESHOLD,
    ks_alpha: float = KS_ALPHA,
) -> DriftReference:
    """Fit on all rows, or on a repeatable sample of ``sample`` of them by ``keys``."""
    features = list(features)
    n_rows, full = summarize(df, ["missing", "moments"], features)
    base = uniform_sample(df, sample, keys) if sample else df
    stats = summarize(base, ["missing", "moments"], features)[1] if sample else full
    kept_rows = min(sample, n_rows) if sample else n_rows
    ends = exact_quantiles(base, features, PSI_PERCENTILES)
    facts = {
        f: {
            "n": kept_rows - stats[f]["missing"],
            "mean": full[f]["mean"],
            "std_pop": stats[f]["std_pop"],
            "lo": ends[f][0],
            "hi": ends[f][1],
        }
        for f in features
        if stats[f]["mean"] is not None
    }
    for f, fact in facts.items():
        fact["bins"] = [0] * PSI_BINS
    if facts:
        for r in _bin_counts(base, facts).where("bin IS NOT NULL").collect():
            facts[r["feature"]]["bins"][r["bin"] - 1] = r["n"]
    counts = long_cells(base, list(facts), "double").groupBy("feature", "value").agg(F.count("*").alias("n"))
    return DriftReference(facts, counts, psi_threshold, ks_alpha, base)


def save_reference(reference: DriftReference, path: str) -> None:
    """Facts, values and thresholds below ``path`` as parquet."""
    spark = reference.values.sparkSession
    reference.values.write.mode("overwrite").parquet(f"{path}/values")
    reference.facts_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    settings = json.dumps({"psi_threshold": reference.psi_threshold, "ks_alpha": reference.ks_alpha})
    spark.createDataFrame([(settings,)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_reference(spark: SparkSession, path: str) -> DriftReference:
    settings = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    facts = {
        r["feature"]: {k: r[k] for k in FACTS}
        for r in spark.read.parquet(f"{path}/facts").collect()
    }
    return DriftReference(facts, spark.read.parquet(f"{path}/values"), settings["psi_threshold"], settings["ks_alpha"])


def with_bins(df: DataFrame, facts: dict[str, dict], keep: Sequence[str] = ()) -> DataFrame:
    """The columns of ``keep``, and per feature, in the order of ``facts``, its value ``v0``, ``v1``, ... and the reference's bin that
    holds it ``b0``, ``b1``, ...: 1 to 10, null for missing values and those outside all bins.

    A value's bin is first guessed from the width of the bins, then moved by one where the exact
    edges say so: a few operations however many bins there are.
    """
    clean = df.selectExpr(*[q(k) for k in keep], *[f"{double_sql(df, f)} AS v{i}" for i, f in enumerate(facts)])
    guesses, bins = [], []
    for i, (f, fact) in enumerate(facts.items()):
        low, high = lit_double(fact["lo"]), lit_double(fact["hi"])
        step = (fact["hi"] - fact["lo"]) / PSI_BINS
        guess = f"greatest(0, least({PSI_BINS - 1}, int((v{i} - {low}) / {lit_double(step)})))" if step else str(PSI_BINS - 1)
        guesses.append(f"if(v{i} BETWEEN {low} AND {high}, {guess}, null) AS g{i}")
        edge = f"{low} + {{0}} * {lit_double(step)}"
        below = f"g{i} > 0 AND v{i} < {edge.format(f'g{i}')}"
        above = f"g{i} < {PSI_BINS - 1} AND v{i} >= {edge.format(f'(g{i} + 1)')}"
        bins.append(f"g{i} + 1 + int({above}) - int({below}) AS b{i}")
    kept = [*[q(k) for k in keep], *[f"v{i}" for i in range(len(facts))]]
    return clean.selectExpr("*", *guesses).selectExpr(*kept, *bins)


def _bin_counts(df: DataFrame, facts: dict[str, dict]) -> DataFrame:
    """(feature, bin, n) over the reference's bins; the null bin counts values outside all of them."""
    cells = [f"struct({lit_text(f)} AS feature, b{i} AS bin, v{i} IS NOT NULL AS known)" for i, f in enumerate(facts)]
    found = with_bins(df, facts).selectExpr(inline_sql(cells)).where("known")
    return found.groupBy("feature", "bin").agg(F.count("*").alias("n"))


def _numbered_cells(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(f, value) with the place of the feature in the list, missing cells left out."""
    clean = df.selectExpr(*[f"{double_sql(df, x)} AS v{i}" for i, x in enumerate(features)])
    return clean.selectExpr(inline_sql([f"struct({i} AS f, v{i} AS value)" for i in range(len(features))])).where("value IS NOT NULL")


def _both_sides(reference: DriftReference, batch: DataFrame, present: Sequence[str]) -> DataFrame:
    """(f, value, n_ref, n_cur) with rows of either side, not yet folded."""
    if reference.base is not None:
        ref = _numbered_cells(reference.base, present).selectExpr("f", "value", "1L AS n_ref", "0L AS n_cur")
    else:
        place = " ".join(f"WHEN {lit_text(x)} THEN {i}" for i, x in enumerate(present))
        ref = reference.values.selectExpr(f"CASE feature {place} END AS f", "value", "n AS n_ref", "0L AS n_cur").where("f IS NOT NULL")
    return ref.unionByName(_numbered_cells(batch, present).selectExpr("f", "value", "0L AS n_ref", "1L AS n_cur"))


def _present(reference: DriftReference, batch: DataFrame) -> list[str]:
    return [f for f in reference.features if f in batch.columns]


def psi(reference: DriftReference, batch: DataFrame) -> DataFrame:
    """(feature, psi) over the reference's ten bins.

    Values outside the outer edges fall in no bin but stay in the denominators; a reference
    without spread gives 0. Features absent from the batch or with few values are left out.
    """
    spark = batch.sparkSession
    present = _present(reference, batch)
    if not present:
        return spark.createDataFrame([], "feature string, psi double")
    facts = {f: reference.facts[f] for f in present}
    per = _bin_counts(batch, facts).groupBy("feature").agg(
        F.expr("sum(n) AS n_cur"),
        F.expr("map_from_entries(collect_list(if(bin IS NULL, null, struct(bin, n)))) AS cur"),
    )
    sizes = " ".join(f"WHEN {lit_text(f)} THEN struct({s['n']}L AS n, array({', '.join(f'{b}L' for b in s['bins'])}) AS bins)" for f, s in facts.items())
    epsilon = lit_double(PSI_EPSILON)
    shares = (
        f"transform(ref.bins, (r, i) -> struct((r + {epsilon}) / ref.n AS r, "
        f"(coalesce(cur[i + 1], 0L) + {epsilon}) / n_cur AS q))"
    )
    total = f"abs(aggregate({shares}, 0D, (acc, s) -> acc + (s.q - s.r) * ln(s.q / s.r)))"
    flat = [lit_text(f) for f, s in facts.items() if not s["std_pop"]]
    value = f"if(feature IN ({', '.join(flat)}), 0D, {total})" if flat else total
    enough = per.where(F.col("n_cur") >= MIN_VALUES).select("*", F.expr(f"CASE feature {sizes} END AS ref"))
    return enough.selectExpr("feature", f"{value} AS psi")


def psi_sql(counts: str, n: str, fact: dict) -> str:
    """PSI of one feature as SQL, from the array of its counts in the reference's bins and the number of its values."""
    if not fact["std_pop"]:
        return "0D"
    epsilon = lit_double(PSI_EPSILON)
    shares = ", ".join(lit_double((b + PSI_EPSILON) / fact["n"]) for b in fact["bins"])
    both = f"zip_with(array({shares}), {counts}, (r, k) -> named_struct('r', r, 'q', (k + {epsilon}) / {n}))"
    return f"abs(aggregate({both}, 0D, (acc, s) -> acc + (s.q - s.r) * ln(s.q / s.r)))"


def drift_status(ratio: Column) -> Column:
    return F.when(ratio >= RATIO_HIGH, "HIGH DRIFT").when(ratio >= RATIO_MODERATE, "MODERATE DRIFT").otherwise("NO DRIFT")


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p-value of the two-sample statistic by the Kolmogorov series with the usual
    finite-size correction of its argument; 1 where the series does not settle."""
    size = n1.cast("double") * n2.cast("double") / (n1 + n2).cast("double")
    root = F.sqrt(size)
    lam = (root + 0.12 + 0.11 / root) * d
    terms = F.sequence(F.lit(1), F.lit(KS_TERMS))
    series = F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))


def exact_ks_pvalue(d: float, n1: int, n2: int) -> float:
    """The chance of a gap of at least ``d`` when both samples come from one continuous law.

    Every order of the pooled sample is a path through an n1 x n2 grid; the paths that stay inside
    the band of smaller gaps are counted row by row, scaled as they grow.
    """
    reach = round(d * n1 * n2)
    if reach <= 0:
        return 1.0
    ways = np.zeros(n2 + 1)
    ways[0] = 1.0
    log_scale = 0.0
    for i in range(n1 + 1):
        low = max(0, (i * n2 - reach) // n1 + 1)
        high = min(n2, -((-i * n2 - reach) // n1) - 1)
        if high < low:
            return 1.0
        ways[:low] = 0.0
        ways[high + 1 :] = 0.0
        ways[low : high + 1] = np.cumsum(ways[low : high + 1])
        top = ways[high]
        if top == 0.0:
            return 1.0
        ways /= top
        log_scale += math.log(top)
    log_paths = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    inside = math.exp(math.log(ways[n2]) + log_scale - log_paths) if ways[n2] > 0 else 0.0
    return min(1.0, max(0.0, 1.0 - inside))


def _exact_where_small(limit: int):
    @F.pandas_udf("double")
    def pvalue(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([exact_ks_pvalue(x, a, b) if max(a, b) <= limit else math.nan for x, a, b in zip(d, n1, n2)], dtype="float64")

    return pvalue


def ks_two_sample(reference: DriftReference, batch: DataFrame, exact_below: int = 0) -> DataFrame:
    """(feature, n_ref, n_cur, d, pvalue): the largest gap between the two empirical distributions.

    The p-value is by the series at every size. On request, features neither side of which has more than ``exact_below``
    values get the exact one.

    Equal values are folded first; the running counts per feature go range by range, so a feature
    with most of the values is spread over many tasks.
    """
    spark = batch.sparkSession
    present = _present(reference, batch)
    if not present:
        return spark.createDataFrame([], "feature string, n_ref long, n_cur long, d double, pvalue double")
    cuts = _joint_cuts(reference, batch, present)
    folded = (
        _both_sides(reference, batch, present)
        .groupBy("f", "value")
        .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    )
    run = running_totals(_with_feature_range(folded, cuts), "value", ["n_ref", "n_cur"], "range", by=["f"])
    gap = "abs((n_ref_before + n_ref) / n_ref_total - (n_cur_before + n_cur) / n_cur_total)"
    best = run.groupBy("f").agg(
        F.expr("max(n_ref_total) AS n_ref"), F.expr("max(n_cur_total) AS n_cur"), F.expr(f"max({gap}) AS d")
    )
    names = ", ".join(map(lit_text, present))
    best = best.selectExpr(f"array({names})[f] AS feature", "n_ref", "n_cur", "d")
    enough = best.where((F.col("n_cur") >= MIN_VALUES) & (F.col("n_ref") > 0))
    size = (F.col("d"), F.col("n_ref"), F.col("n_cur"))
    if not exact_below:
        return enough.withColumn("pvalue", ks_pvalue(*size))
    both = enough.withColumns({"exact": _exact_where_small(exact_below)(*size), "series": ks_pvalue(*size)})
    return both.select("feature", "n_ref", "n_cur", "d", F.coalesce(F.when(~F.isnan("exact"), F.col("exact")), "series").alias("pvalue"))


def _joint_cuts(reference: DriftReference, batch: DataFrame, present: Sequence[str]) -> list[list[float]]:
    """Quantile cut points per feature taken from both sides, so that neither crowds one range."""
    ranges = max(MIN_RANGES, -(-range_count(batch) // len(present)))
    wide = batch.selectExpr(*[f"{double_sql(batch, x)} AS {q(x)}" for x in present])
    cuts = {x: set(v) for x, v in quantile_cuts(wide, present, ranges).items()}
    if reference.base is not None:
        base = reference.base.selectExpr(*[f"{double_sql(reference.base, x)} AS {q(x)}" for x in present])
        for x, v in quantile_cuts(base, present, ranges).items():
            cuts[x] |= set(v)
    else:
        at = ", ".join(lit_double(i / ranges) for i in range(1, ranges))
        sketch = F.expr(f"percentile_approx(value, array({at}), {max(1_000, 10 * ranges)})").alias("q")
        for r in reference.values.groupBy("feature").agg(sketch).collect():
            if r["feature"] in cuts:
                cuts[r["feature"]] |= set(r["q"])
    return [sorted(cuts[x]) for x in present]


def _with_feature_range(folded: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Add ``range``: the place of ``value`` among its own feature's cut points."""
    own = folded.selectExpr("*", *[f"if(f = {i}, value, null) AS v{i}" for i in range(len(cuts))])
    spread = with_ranges(own, {f"v{i}": points for i, points in enumerate(cuts)})
    # A row has a value, and so a range above 0, in its own feature's column only.
    return spread.selectExpr(*folded.columns, " + ".join(f"v{i}__range" for i in range(len(cuts))) + " AS range")


def drift_report(reference: DriftReference, batch: DataFrame, exact_below: int = 0) -> DataFrame:
    """(feature, psi, pvalue, d, drifted, status) per feature present in both."""
    joined = psi(reference, batch).join(ks_two_sample(reference, batch, exact_below), "feature")
    psi4 = F.round("psi", 4)
    drifted = (psi4 >= reference.psi_threshold) | (F.col("pvalue") < reference.ks_alpha)
    status = F.when(psi4 >= PSI_HIGH, "HIGH").when(psi4 >= PSI_MODERATE, "MODERATE").otherwise("OK")
    return joined.select(
        "feature", psi4.alias("psi"), F.round("pvalue", 4).alias("pvalue"), "d", drifted.alias("drifted"), status.alias("status")
    )


def drift_summary(report: DataFrame, listed: int | None = None) -> DataFrame:
    """One row: status, ratio, counts, and the drifted features in name order (the first ``listed`` of them)."""
    ratio = F.coalesce(F.try_divide(F.col("drifted_count").cast("double"), F.col("total_features")), F.lit(0.0))
    counted = report.agg(
        F.coalesce(F.sum(F.col("drifted").cast("long")), F.lit(0)).alias("drifted_count"),
        F.count("*").alias("total_features"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("names"),
    )
    return counted.select(
        drift_status(ratio).alias("status"),
        F.round(ratio, 3).alias("drift_ratio"),
        "drifted_count",
        "total_features",
        F.array_join(F.slice("names", 1, listed) if listed else F.col("names"), ",").alias("drifted_features"),
    )


def top_drifted(report: DataFrame, n: int = 5) -> DataFrame:
    return report.orderBy(F.col("psi").desc(), "feature").limit(n)

