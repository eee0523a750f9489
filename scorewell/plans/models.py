"""Training, ranking, saving and applying binary classifiers with Spark ML."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from scorewell.functions.exprs import c, double_sql, lit_double, lit_text, q
from scorewell.operators.balance import balanced_weight, smote
from scorewell.operators.boosting import SecondOrderBoosting, Settings
from scorewell.operators.cleaning import alignment, clean_smart, drop_null_target
from scorewell.operators.curves import roc_auc, score_curve
from scorewell.operators.encode import MAX_CATEGORIES, POOLED, feature_kinds, fit_medians, fit_one_hot, fit_standard_scale, fit_target
from scorewell.operators.evaluate import classification_summary
from scorewell.operators.folds import ColumnStatistics, fold_statistics
from scorewell.operators.quality import dataset_profile
from scorewell.operators.sampling import stratified_folds, stratified_sample, stratified_split, uniform_sample
from scorewell.operators.scoring import add_risk_band, decide
from scorewell.operators.thresholds import FALSE_ALARM_COST, MISS_COST, best_threshold, choose_threshold, cost_at
from scorewell.session import materialize

log = logging.getLogger(__name__)

# The models and their trees or iterations, and the limits of the complexity probe.
AUTO_MODELS = {"LogisticRegression": 3000, "RandomForest": 300, "GBT_Deep": 300, "GBT": 200, "Newton": 200}
FRAUD_MODELS = {"LogisticRegression": 3000, "RandomForest": 500, "GBT_Balanced": 500, "GBT_HighRecall": 500, "Newton_HighRecall": 300}
#: Second-order boosting: a bounded step for rare classes, and one with samples of columns.
NEWTON = {
    "Newton_HighRecall": {"leaves": 64, "rate": 0.3, "least_hessian": 1.0, "least_rows": 1, "delta": 1.0},
    "Newton": {"leaves": 63, "rate": 0.1, "least_rows": 20, "columns": 0.8},
}
#: Cross-validation folds, and the most labelled rows that ``auto_train`` fits and ranks candidates on: the same at every size.
FOLDS = 3
FIT_ROWS = 2_000_000
PROBE_ROWS, PROBE_TEST, PROBE_TREES = 5_000, 0.3, 50
NONLINEAR_GAP, LINEAR_GAP = 0.05, -0.03


def build_preprocessor(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_categories: int | None = MAX_CATEGORIES,
    known: ColumnStatistics | None = None,
) -> tuple[PipelineModel, list[str]]:
    """Fitted stages that end in a ``features`` vector, and the name of each of its places.

    Numeric columns: median for missing cells, then centred and scaled by the population
    deviation. Others: most frequent value for missing cells, then sparse one-hot columns with
    the rarest categories pooled; unseen values get zeros. Statistics of the training rows that are ``known`` are not measured again.
    """
    numeric, categorical = list(numeric), list(categorical)
    if not numeric and not categorical:
        raise ValueError("no usable columns")
    exprs, names, stages = [], [], []
    medians = known.medians if known else fit_medians(train, numeric).values
    usable = [x for x in numeric if medians.get(x) is not None]
    if known:
        scale = known.scale
    else:
        filled = train.selectExpr(*[f"coalesce({double_sql(train, x)}, {lit_double(medians[x])}) AS {q(x)}" for x in usable])
        scale = fit_standard_scale(filled, usable).stats if usable else {}
    for x in usable:
        mean, std = scale[x]
        value = f"coalesce({double_sql(train, x)}, {lit_double(medians[x])})"
        exprs.append(f"({value} - {lit_double(mean)}) / {lit_double(std or 1.0)} AS {q('num__' + x)}")
        names.append(f"num__{x}")
    labels = []
    if categorical:
        texts = train.selectExpr(*[f"cast({q(x)} AS string) AS {q(x)}" for x in categorical])
        fitted = known.categories if known else fit_one_hot(texts, categorical, max_categories)
        for x in list(categorical):
            kept, rest = fitted.kept[x], fitted.pooled[x]
            if not kept:
                categorical.remove(x)
                continue
            text = f"coalesce(cast({q(x)} AS string), {lit_text(fitted.modes[x])})"
            if rest is None:
                # Too many pooled values to list: anything not kept counts as pooled.
                text = f"if({text} IN ({', '.join(map(lit_text, kept))}), {text}, {lit_text(POOLED)})"
            elif rest:
                text = f"if({text} IN ({', '.join(map(lit_text, rest))}), {lit_text(POOLED)}, {text})"
            exprs.append(f"{text} AS {q('cat__' + x)}")
            labels.append(kept + ([POOLED] if rest != [] else []))
    stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__"))
    inputs = [f"num__{x}" for x in usable]
    if categorical:
        cats = [f"cat__{x}" for x in categorical]
        indexers = [StringIndexerModel.from_labels(v, x, f"{x}__i", "keep") for x, v in zip(cats, labels)]
        sample = PipelineModel([stages[0], *indexers]).transform(train.limit(0))
        encoder = OneHotEncoder(inputCols=[f"{x}__i" for x in cats], outputCols=[f"{x}__v" for x in cats], dropLast=True)
        stages += [*indexers, encoder.fit(sample)]
        inputs += [f"{x}__v" for x in cats]
        names += [f"cat__{x}={v}" for x, vs in zip(categorical, labels) for v in vs]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return PipelineModel(stages), names


def candidates(plan: dict[str, int], seed: int = 42, weight: str | None = None) -> dict[str, Estimator]:
    """Estimators by name, each with its number of trees or iterations."""
    common = {"featuresCol": "features", "labelCol": "label", **({"weightCol": weight} if weight else {})}
    made: dict[str, Estimator] = {}
    for name, n in plan.items():
        if name == "LogisticRegression":
            made[name] = LogisticRegression(maxIter=n, **common)
        elif name == "RandomForest":
            made[name] = RandomForestClassifier(numTrees=n, maxDepth=10, subsamplingRate=1.0, seed=seed, **common)
        elif name in NEWTON:
            made[name] = SecondOrderBoosting.of(Settings(trees=n, seed=seed, **NEWTON[name]), **common)
        else:
            deep = name in ("GBT_Deep", "GBT_HighRecall")
            made[name] = GBTClassifier(
                maxIter=n, maxDepth=5 if deep else 4, stepSize=0.1, minInstancesPerNode=5 if deep else 20,
                subsamplingRate=0.8, seed=seed, **common,
            )
    return made


def positive_score(predicted: DataFrame, name: str = "score") -> DataFrame:
    """Add the probability of class 1."""
    return predicted.withColumn(name, vector_to_array("probability")[1])


def auc_of(predicted: DataFrame) -> float:
    value = roc_auc(score_curve(positive_score(predicted).select("label", "score"))).first()["roc_auc"]
    if value is None:
        raise ValueError("ROC AUC is not defined for one class")
    return value


def with_weight(df: DataFrame, balanced: bool) -> DataFrame:
    return df.withColumn("weight", balanced_weight(df, "label") if balanced else F.lit(1.0))


def cross_validate(
    train: DataFrame,
    keys: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    estimators: dict[str, Estimator],
    folds: int,
    parallelism: int = 8,
    max_categories: int | None = MAX_CATEGORIES,
) -> dict[str, float]:
    """Mean ROC AUC per model over stratified folds; a model that fails scores 0.

    The preprocessors of all folds are fitted together, each from its fold's training rows, and a fold's output is shared
    by all models, which are fitted side by side. The dealt rows are written once, so that no later scan derives them again.
    """
    used = list(dict.fromkeys([*numeric, *categorical, "label", "weight", "fold"]))
    dealt = materialize(stratified_folds(train, keys, "label", folds).select(*[c(x) for x in used]), "dealt")
    known = fold_statistics(dealt, "fold", range(folds), numeric, categorical, max_categories)
    totals: dict[str, list[float]] = {name: [] for name in estimators}
    for fold in range(folds):
        inside = dealt.where(F.col("fold") != fold)
        pre, _ = build_preprocessor(inside, numeric, categorical, max_categories, known[fold])
        fit_rows = pre.transform(inside).select("features", "label", "weight").persist(StorageLevel.MEMORY_AND_DISK)
        test_rows = pre.transform(dealt.where(F.col("fold") == fold)).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)

        def evaluate(name: str) -> float:
            return auc_of(estimators[name].fit(fit_rows).transform(test_rows))

        with ThreadPoolExecutor(parallelism) as pool:
            jobs = {name: pool.submit(inheritable_thread_target(train.sparkSession)(evaluate), name) for name in estimators}
            for name, job in jobs.items():
                try:
                    totals[name].append(job.result())
                except Exception as e:  # noqa: BLE001
                    log.warning("%s failed: %s", name, e)
                    totals[name].append(float("nan"))
        fit_rows.unpersist()
        test_rows.unpersist()
    if all(any(v != v for v in values) for values in totals.values()):
        raise RuntimeError("no candidate could be fitted")
    return {name: 0.0 if any(v != v for v in values) else sum(values) / len(values) for name, values in totals.items()}


def leaderboard(spark: SparkSession, scores: dict[str, float]) -> DataFrame:
    """(model, cv_roc_auc, best) by falling score; the first model with the top score is the best."""
    best = max(scores, key=lambda name: scores[name])
    rows = [(name, round(score, 5), name == best) for name, score in scores.items()]
    frame = spark.createDataFrame(rows, "model string, cv_roc_auc double, best boolean")
    return frame.orderBy(F.col("cv_roc_auc").desc(), "model")


@dataclass
class TrainedModel:
    """A fitted pipeline with its threshold and what is known about it."""

    pipeline: PipelineModel
    threshold: float
    features: list[str]
    feature_names: list[str]
    name: str
    metrics: dict = field(default_factory=dict)

    def facts(self) -> dict:
        return {
            "threshold": self.threshold, "features": self.features, "feature_names": self.feature_names,
            "name": self.name, "metrics": self.metrics,
        }

    def score(self, df: DataFrame, strict: bool = False) -> DataFrame:
        """Input columns, score, prediction. Absent features count as 0, or raise when ``strict``."""
        match = alignment(df, self.features)
        if strict and match.missing:
            raise ValueError(f"missing features: {match.missing}")
        ready = df.withColumns({f: F.lit(0) for f in match.missing}) if match.missing else df
        scored = positive_score(self.pipeline.transform(ready))
        return decide(scored, self.threshold).select(*[c(x) for x in df.columns], "score", "prediction")

    def vectors(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Kept columns and the assembled ``features`` vector."""
        stages = PipelineModel(self.pipeline.stages[:-1])
        return stages.transform(df).select(*[c(x) for x in keep], "features")

    @property
    def classifier(self):
        return self.pipeline.stages[-1]

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        facts = spark.createDataFrame([(json.dumps(self.facts()),)], "facts string")
        facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainedModel:
        try:
            facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                raise FileNotFoundError(path) from e
            raise
        return cls(
            PipelineModel.load(f"{path}/pipeline"), facts["threshold"], facts["features"], facts["feature_names"],
            facts["name"], facts["metrics"],
        )


def score_batch(trained: TrainedModel, df: DataFrame, band: str = "relative") -> DataFrame:
    """Scored rows with their risk band."""
    return add_risk_band(trained.score(df), band, trained.threshold)


def fit_best(
    train: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str],
    estimators: dict[str, Estimator], folds: int, cv_rows: int | None = None, max_categories: int | None = MAX_CATEGORIES,
    validation: DataFrame | None = None,
) -> tuple[PipelineModel, list[str], str, dict[str, float]]:
    """Rank the candidates and fit the best on all training rows.

    Without folds the candidates are fitted once and ranked on the validation rows.
    """
    pre, names = build_preprocessor(train, numeric, categorical, max_categories)
    ready = pre.transform(train).select("features", "label", "weight").persist(StorageLevel.MEMORY_AND_DISK)
    if folds:
        cv = stratified_sample(train, cv_rows, keys, "label") if cv_rows else train
        scores = cross_validate(cv, keys, numeric, categorical, estimators, folds, max_categories=max_categories)
        best = max(scores, key=lambda name: scores[name])
        model = estimators[best].fit(ready)
    else:
        models = {name: e.fit(ready) for name, e in estimators.items()}
        scores = {name: auc_of(m.transform(pre.transform(validation))) for name, m in models.items()}
        best = max(scores, key=lambda name: scores[name])
        model = models[best]
    ready.unpersist()
    return PipelineModel([*pre.stages, model]), names, best, scores


def complexity_probe(
    df: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], rows: int = PROBE_ROWS, trees: int = PROBE_TREES
) -> dict:
    """Linear against boosted ROC AUC on a sample of ``rows`` labelled rows; any failure gives "unknown"."""
    try:
        sample = with_weight(uniform_sample(df, rows, keys), False)
        train, test = stratified_split(sample, keys, "label", PROBE_TEST)
        pre, _ = build_preprocessor(train, numeric, categorical)
        fit_rows, test_rows = pre.transform(train).persist(), pre.transform(test).persist()
        linear = auc_of(LogisticRegression(maxIter=500).fit(fit_rows).transform(test_rows))
        boosted = auc_of(GBTClassifier(maxIter=trees, seed=42).fit(fit_rows).transform(test_rows))
        fit_rows.unpersist()
        test_rows.unpersist()
        gap = boosted - linear
        kind = "nonlinear" if gap > NONLINEAR_GAP else "linear" if gap < LINEAR_GAP else "mixed"
        return {"complexity": kind, "linear_auc": linear, "boosted_auc": boosted, "gap": gap}
    except Exception as e:  # noqa: BLE001
        log.warning("complexity probe failed: %s", e)
        return {"complexity": "unknown", "linear_auc": None, "boosted_auc": None, "gap": None}


def auto_train(
    df: DataFrame,
    target: str,
    keys: Sequence[str] = (),
    positive_label: object = None,
    test_size: float = 0.2,
    clean_data: bool = True,
    outlier_method: str = "iqr",
    plan: dict[str, int] | None = None,
    folds: int = FOLDS,
    fit_rows: int = FIT_ROWS,
    probe_rows: int = PROBE_ROWS,
    overrides: dict[str, str] | None = None,
) -> TrainedModel:
    """Any table with a binary target: clean, profile, encode, probe, split, rank, fit, choose the
    F1 threshold, evaluate.

    ``keys`` identify the rows for the split; without them the whole row does. ``plan`` names the
    candidates with their trees or iterations (AUTO_MODELS). Tables of more than ``fit_rows`` labelled rows are fitted and
    evaluated on a stratified sample of that many.
    """
    df = drop_null_target(df, target)
    report = None
    if clean_data:
        df, report = clean_smart(df, target, outlier_method, protect=keys)
    profile = dataset_profile(df.drop(*keys), target, overrides)
    if profile["n_classes"] != 2:
        raise ValueError(f"binary classification only: the target has {profile['n_classes']} classes")
    numeric, categorical = profile["numeric_cols"], profile["categorical_cols"]
    if not numeric and not categorical:
        raise ValueError("no usable features")
    encoding = fit_target(df, target, positive_label)
    # Without keys the whole cleaned row is the key: equal rows then stay on one side of a split.
    keys = list(keys) or [x for x in df.columns if x != target]
    kept = list(dict.fromkeys([*keys, *numeric, *categorical]))
    labelled = df.select(*[c(x) for x in kept], encoding.column(target).alias("label"))
    labelled = stratified_sample(labelled, fit_rows, keys, "label")
    probe = complexity_probe(labelled, keys, numeric, categorical, probe_rows)
    train, val = stratified_split(labelled, keys, "label", test_size)
    train = with_weight(train, profile["is_imbalanced"])
    estimators = candidates(plan or AUTO_MODELS, weight="weight")
    pipeline, names, best, scores = fit_best(train, keys, numeric, categorical, estimators, folds, validation=val)
    scored = positive_score(pipeline.transform(val)).select("label", "score").persist(StorageLevel.MEMORY_AND_DISK)
    threshold = float(best_threshold(scored, "maximize_f1").first()["threshold"])
    metrics = classification_summary(scored, threshold).first().asDict()
    scored.unpersist()
    metrics |= {"best_model": best, "cv_roc_auc": scores[best], "all_scores": scores, "threshold": threshold,
                "tier": profile["tier"], "complexity": probe["complexity"], "n_rows": profile["n_rows"],
                "cleaning": report.steps if report else []}
    return TrainedModel(pipeline, threshold, numeric + categorical, names, best, metrics)


def fraud_train(
    train: DataFrame,
    val: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    objective: str = "cost",
    manual_threshold: float | None = None,
    miss_cost: float = MISS_COST,
    alarm_cost: float = FALSE_ALARM_COST,
    plan: dict[str, int] | None = None,
    folds: int = FOLDS,
    fit_rows: int | None = None,
    oversample: bool = False,
) -> TrainedModel:
    """Rank the fraud models by CV on ``train``, choose the threshold on ``val``, evaluate there.

    ``train`` and ``val`` carry ``label``; ``plan`` names the candidates (FRAUD_MODELS). All rows are fitted and ranked on,
    unless the caller names a size for a stratified sample (``fit_rows``). With ``oversample`` the best model is fitted on
    synthetic minority rows as well; cross-validation never sees them.
    """
    numeric, categorical = feature_kinds(train, features)
    # Written once: every scan of the fit would derive the rows, and look for a sample among them, again.
    train = train.select(*[c(x) for x in dict.fromkeys([*keys, *features, "label"])])
    train = materialize(train if fit_rows is None else stratified_sample(train, fit_rows, keys, "label"), "train" if fit_rows is None else "sample")
    weighted = with_weight(train, True)
    estimators = candidates(plan or FRAUD_MODELS, weight="weight")
    if not oversample:
        pipeline, names, best, scores = fit_best(weighted, keys, numeric, categorical, estimators, folds, max_categories=None)
    else:
        if categorical or len(keys) != 1:
            raise ValueError("oversampling needs numeric features and one key column")
        scores = cross_validate(weighted, keys, numeric, categorical, estimators, folds, max_categories=None)
        best = max(scores, key=lambda name: scores[name])
        grown = with_weight(smote(train, keys[0], "label", features), False)
        pre, names = build_preprocessor(grown, numeric, [], None)
        pipeline = PipelineModel([*pre.stages, estimators[best].fit(pre.transform(grown))])
    scored = positive_score(pipeline.transform(val)).select("label", "score").persist(StorageLevel.MEMORY_AND_DISK)
    threshold = choose_threshold(scored, objective, manual_threshold, miss_cost, alarm_cost)
    metrics = classification_summary(scored, threshold).first().asDict()
    metrics |= cost_at(scored, threshold, miss_cost, alarm_cost).first().asDict()
    scored.unpersist()
    metrics |= {"best_model": best, "cv_roc_auc": scores[best], "all_scores": scores, "threshold": threshold, "objective": objective}
    return TrainedModel(pipeline, threshold, list(features), names, best, metrics)


def metrics_frame(spark: SparkSession, metrics: dict) -> DataFrame:
    """(metric, value) rows of the numeric facts of a training run."""
    rows = [(k, float(v)) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "metric string, value double")


def champions(runs: DataFrame, model: str = "model_name", version: str = "version", metric: str = "test_roc_auc") -> DataFrame:
    """Runs with ``is_champion``: per model the version with the best metric, the later among equals."""
    best = runs.groupBy(c(model).alias("__model")).agg(
        F.max(F.struct(F.coalesce(c(metric), F.lit(0.0)).alias("m"), c(version).alias("v"))).alias("__top")
    )
    joined = runs.join(best, c(model) == F.col("__model"))
    return joined.select(*[c(x) for x in runs.columns], (c(version) == F.col("__top.v")).alias("is_champion"))


def set_champion(runs: DataFrame, name: str, chosen: object, model: str = "model_name", version: str = "version") -> DataFrame:
    """Override the champion of one model by version."""
    forced = F.when(c(model) == F.lit(name), c(version) == F.lit(chosen)).otherwise(F.col("is_champion"))
    return runs.withColumn("is_champion", forced)
