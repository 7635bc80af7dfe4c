"""Fitting, scoring and evaluating detectors with MLlib, at an operating point under a false-positive budget."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from hostwatch.config import DAILY_FLOWS, FPR_BUDGET, FPR_BUDGET_V1
from hostwatch.operators import metrics as M, sampling as SA, sessions as SS, splits as SP, transforms as TR
from hostwatch.operators.lineage import cut


@dataclass(frozen=True)
class Detector:
    """A fitted model with everything that has to be applied before and after it."""

    model: PipelineModel
    threshold: float | None
    budget: float = FPR_BUDGET
    transforms: TR.TransformConfig = TR.TransformConfig()
    normalizer: DataFrame | None = None
    metrics: dict = field(default_factory=dict)

    def operating_point(self) -> DataFrame:
        spark = self.normalizer.sparkSession if self.normalizer is not None else None
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.active()
        row = spark.createDataFrame([(self.threshold, self.budget, list(self.transforms.log_scale), list(self.transforms.ablate))],
                                    "threshold double, budget double, log_scale array<string>, ablate array<string>")
        return row.join(self.normalizer, F.lit(True)) if self.normalizer is not None else row


def detector_from(model: PipelineModel, point: DataFrame) -> Detector:
    """Restore a detector that was saved with its operating point."""
    row = point.first()
    stats = point.drop("threshold", "budget", "log_scale", "ablate") if "orig_bytes_mean" in point.columns else None
    return Detector(model, row["threshold"], row["budget"], TR.TransformConfig(tuple(row["log_scale"]), tuple(row["ablate"])), stats)


def as_vectors(sessions: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Pooled features (or given columns) as one vector column."""
    if features is None:
        sessions, features = SS.pool_sessions(sessions), SS.pooled_names()
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(sessions)


def apply_saved(sessions: DataFrame, detector: Detector) -> DataFrame:
    """The transforms and normaliser the detector was fitted with."""
    out = TR.apply_transforms(sessions, detector.transforms)
    return TR.apply_normalizer(out, detector.normalizer) if detector.normalizer is not None else out


def score(df: DataFrame, model: Transformer, keep: Sequence[str] = ("sample_id", "label")) -> DataFrame:
    """``(sample_id, label, score)`` from a fitted classifier; score is the probability of the positive class."""
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.select(*[c for c in keep if c in out.columns], "score")


def score_with(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], keep: Sequence[str] = ("sample_id", "label")) -> DataFrame:
    """Score with a user-supplied model over Arrow batches of sessions."""
    names = [c for c in keep if c in df.columns]
    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names) + ", score double"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[names].copy()
            out["score"] = predict(frame)
            yield out

    return df.mapInPandas(batches, schema)


def balanced_weights(df: DataFrame) -> DataFrame:
    n = SA.label_counts(df)
    total = n[0] + n[1]
    weight = {c: total / (2.0 * n[c]) if n[c] else 0.0 for c in n}
    return df.withColumn("weight", F.when(F.col("label") == 1, weight[1]).otherwise(weight[0]))


def default_candidates() -> list:
    return [LogisticRegression(labelCol="label", featuresCol="features", regParam=r, maxIter=50) for r in (0.001, 0.1)]


def candidate_families(features: int | None = None, seed: int = 42) -> list:
    """Candidates of several families over the same vectors: logistic models, boosted trees and a perceptron with one hidden layer."""
    width = features or len(SS.pooled_names())
    return [*default_candidates(), GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=4, seed=seed),
            MultilayerPerceptronClassifier(labelCol="label", featuresCol="features", layers=[width, 16, 2], maxIter=60, seed=seed)]


def train_under_budget(train: DataFrame, val: DataFrame, candidates: Sequence | None = None, budget: float = FPR_BUDGET,
                       guard: float = 1.0, transforms: TR.TransformConfig = TR.TransformConfig(),
                       normalizer: DataFrame | None = None) -> Detector:
    """Fit candidates on natural priors; keep the one with the best validation operating point within ``budget * guard``.

    All candidates read the same stored vectors, and each scores the validation part once.  ``metrics`` of the result holds the chosen one's metrics and,
    as ``candidates``, the operating point of every one.
    """
    train, val = cut(train.select("label", "features")), cut(val.select("label", "features"))
    best: Detector | None = None
    points = []
    models = []
    for i, estimator in enumerate(candidates or default_candidates()):
        model = Pipeline(stages=[estimator]).fit(train)
        scored = cut(score(val, model, keep=("label",)))
        at = M.threshold_under_fpr(scored, budget * guard).first()
        row = M.binary_metrics(scored, at["threshold"], budget).first()
        models.append((model, at["threshold"], row.asDict()))
        points.append((f"{i:04d}", float(at["recall"]), float(row["f1"]), float(at["fpr"])))
    frame = train.sparkSession.createDataFrame(points, "candidate string, recall double, f1 double, fpr double")
    chosen = int(M.rank_operating_points(frame).first()["candidate"])
    model, threshold, metrics = models[chosen]
    metrics["candidates"] = [{"candidate": type(m.stages[-1]).__name__, "chosen": i == chosen, **{c: float(row[c]) for c in ("threshold", "recall", "fpr", "f1", "auc")}}
                             for i, (m, _, row) in enumerate(models)]
    best = Detector(model, threshold, budget, transforms, normalizer, metrics)
    return best


def train_detector(sessions: DataFrame, cfg: TR.TransformConfig = TR.TransformConfig(), min_flows: int = 5, budget: float = FPR_BUDGET,
                   guard: float = 1.0, candidates: Sequence | None = None, seed: int = 42) -> tuple[Detector, DataFrame]:
    """Split, transform, normalise, fit and select; also the scores of the untouched test part.

    Counting, splitting and normalising read the sessions again and again, so they are built once and stored.
    """
    frames, stats = TR.prepare(cut(SS.min_flows(sessions, min_flows)), cfg, min_flows, seed)
    vectors = cut(as_vectors(frames).select("sample_id", "label", "split", "features"))
    part = {s: vectors.filter(F.col("split") == s) for s in ("train", "val", "test")}
    detector = train_under_budget(part["train"], part["val"], candidates, budget, guard, cfg, stats)
    return detector, score(part["test"], detector.model)


def evaluate_external(sessions: DataFrame, detector: Detector, daily_flows: int = DAILY_FLOWS) -> DataFrame:
    """Metrics on other data with the threshold, budget and transforms saved with the detector."""
    if detector.threshold is None:
        raise ValueError("the detector has no validation-derived threshold; refusing to tune on evaluation data")
    scored = score(as_vectors(apply_saved(sessions, detector)), detector.model)
    return M.binary_metrics(scored, detector.threshold, detector.budget, daily_flows)


def holdout(sessions: DataFrame, detector: Detector, min_flows: int = 5, seed: int = 42) -> DataFrame:
    """Scores of the test part of the same split the detector was trained from."""
    split = SP.random_stratified(SS.min_flows(sessions, min_flows), seed=seed)
    if detector.normalizer is None:
        changed = TR.apply_transforms(split, detector.transforms)
        stats = TR.fit_normalizer(changed.filter(F.col("split") == "train"))
        test = TR.apply_normalizer(changed.filter(F.col("split") == "test"), stats)
    else:
        test = apply_saved(split.filter(F.col("split") == "test"), detector)
    return score(as_vectors(test), detector.model)


def evaluate_holdout(sessions: DataFrame, detector: Detector, budget: float = FPR_BUDGET, min_flows: int = 5, seed: int = 42,
                     daily_flows: int = DAILY_FLOWS) -> DataFrame:
    out = M.binary_metrics(holdout(sessions, detector, min_flows, seed), detector.threshold, budget, daily_flows)
    return out.withColumns({"n_c2": F.col("tp") + F.col("fn"), "n_benign": F.col("fp") + F.col("tn"),
                            "n_test": F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")})


def score_report(sessions: DataFrame, detector: Detector, split: str = "full", min_flows: int = 5, seed: int = 42) -> DataFrame:
    """Score distribution on all sessions or on the holdout."""
    if split == "holdout":
        scored = holdout(sessions, detector, min_flows, seed)
    else:
        scored = score(as_vectors(apply_saved(SS.min_flows(sessions, min_flows), detector)), detector.model)
    return M.score_summary(scored, detector.threshold, split)


# A fit of MLlib passes on the sums of all bins of every open node from every partition, and there are nodes in proportion to the rows.  Above
# ROWS_AT_ONCE rows a forest is therefore fitted some trees at a time, side by side, each on few partitions of about ROWS_PER_TASK rows at most.
ROWS_AT_ONCE = 4_096
TREES_AT_ONCE = 5
ROWS_PER_TASK = 1 << 18
# Every scoring task reads the forests of its stage, so a stage takes about this many nodes.
NODES_PER_STAGE = 1 << 19
VOTES = "_votes"


class Votes(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the probabilities of forests, each as often as it has trees, to the votes of the stages before.

    With ``total``, the trees of all forests, the sum becomes ``probability``.  Without it more forests follow, and a shuffle parts them from these,
    so that no task is sent all of them.
    """

    trees = Param(Params._dummy(), "trees", "trees of each forest", TypeConverters.toListInt)
    total = Param(Params._dummy(), "total", "trees of all forests; 0: more follow", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, trees: list[int] | None = None, total: int = 0):
        super().__init__()
        self._setDefault(total=0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        names, total = self.getInputCols(), self.getOrDefault(self.total)
        parts = [F.col(VOTES)] if VOTES in df.columns else []
        for c, n in zip(names, map(float, self.getOrDefault(self.trees))):
            parts.append(F.transform(vector_to_array(F.col(c)), lambda p: p * n))
        votes = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
        if not total:
            return df.withColumn(VOTES, votes).drop(*names).repartition(df.sparkSession.sparkContext.defaultParallelism)
        return df.withColumn("probability", array_to_vector(F.transform(votes, lambda v: v / F.lit(float(total))))).drop(VOTES, *names)


def deal_rows(train: DataFrame) -> DataFrame:
    """A large training table on few partitions, sorted, so that the random draws don't depend on the files or cores it came from."""
    rows = train.count()
    if rows <= ROWS_AT_ONCE:
        return train
    values = vector_to_array("features")
    return cut(train.repartition(math.ceil(rows / ROWS_PER_TASK), "sample_id", values).sortWithinPartitions("sample_id", "label", values))


def fit_forests(train: DataFrame, forest: RandomForestClassifier, seed: int = 42) -> list[RandomForestClassificationModel]:
    """The trees of ``forest`` in one fit of a small table, else in several that run side by side; every tree draws from all rows."""
    rows, trees, spark = train.count(), forest.getNumTrees(), train.sparkSession
    if rows <= ROWS_AT_ONCE:
        return [forest.fit(train)]

    def fit(i: int) -> RandomForestClassificationModel:
        part = forest.copy({forest.numTrees: min(TREES_AT_ONCE, trees - i), forest.seed: seed + 1_000_003 * i, forest.probabilityCol: f"_p{i}"})
        return part.setRawPredictionCol("").setPredictionCol("").fit(train)

    starts = range(0, trees, TREES_AT_ONCE)
    at_once = spark.sparkContext.defaultParallelism // math.ceil(rows / ROWS_PER_TASK)
    with ThreadPool(max(1, min(len(starts), at_once))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(lambda i=i: fit(i)) for i in starts], chunksize=1)


def voting(forests: Sequence[RandomForestClassificationModel]) -> list[Transformer]:
    """Stages that give the ``probability`` of all trees of the forests."""
    if len(forests) == 1:
        return [forests[0].setProbabilityCol("probability")]
    stages: list[Transformer] = []
    held: list[RandomForestClassificationModel] = []
    for i, forest in enumerate(forests):
        held.append(forest)
        last = i + 1 == len(forests)
        if last or sum(f.totalNumNodes for f in held) >= NODES_PER_STAGE:
            stages += [*held, Votes(inputCols=[f.getProbabilityCol() for f in held], trees=[f.getNumTrees for f in held],
                                    total=sum(f.getNumTrees for f in forests) if last else 0)]
            held = []
    return stages


def rf_baseline(df: DataFrame, features: Sequence[str] | None = None, ratio: float = 10.0, test: float = 0.2, val: float = 0.15,
                trees: int = 200, depth: int = 20, leaf: int = 5, min_flows: int = 3, seed: int = 42) -> tuple[Detector, DataFrame, DataFrame]:
    """Random forest on pooled features: undersampled training part, balanced weights, threshold tuned for F1 on validation.

    Returns the detector, the scores of the test part and the feature importances.  The scaler is a stage of the model, so
    the detector scores pooled sessions (or the given columns as a vector) as it did when it was fitted, also after saving.
    """
    if features is None:
        df, features = SS.pool_sessions(SS.min_flows(df, min_flows)), SS.pooled_names()
    features = list(features)
    outer = SP.stratified_two_way(df.select("sample_id", "label", *features), test, seed, part="test").withColumnRenamed("split", "outer")
    outer = cut(outer)
    inner = SP.stratified_two_way(outer.filter(F.col("outer") == "train"), val, seed + 1)
    small = SA.undersample(inner.filter(F.col("split") == "train"), ratio, seed)

    def vectors(frame: DataFrame) -> DataFrame:
        return as_vectors(frame.select("sample_id", "label", *features), features).select("sample_id", "label", "features")

    def few(frame: DataFrame) -> DataFrame:  # every scoring task reads the model
        return frame.coalesce(frame.sparkSession.sparkContext.defaultParallelism)

    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    forest = RandomForestClassifier(labelCol="label", featuresCol="scaled", weightCol="weight", numTrees=trees, maxDepth=depth,
                                    minInstancesPerNode=leaf, seed=seed, cacheNodeIds=True, featureSubsetStrategy="sqrt" if trees > 1 else "all")
    train = deal_rows(cut(balanced_weights(vectors(small))))
    scaled = scaler.fit(train)
    forests = fit_forests(scaled.transform(train), forest, seed)
    model = PipelineModel([scaled, *voting(forests)])
    best = M.best_f1_threshold(cut(score(few(vectors(inner.filter(F.col("split") == "val"))), model))).first()
    scored = score(few(vectors(outer.filter(F.col("outer") == "test"))), model)
    return Detector(model, best["threshold"], transforms=TR.TransformConfig(log_scale=())), scored, importances(forests, features)


def importances(forests: Sequence[RandomForestClassificationModel], features: Sequence[str]) -> DataFrame:
    """Mean importance over the trees that split at all, as MLlib gives it for one forest."""
    from pyspark.sql import SparkSession

    values, n = [0.0] * len(features), 0
    for forest in forests:
        grown = sum(t.numNodes > 1 for t in forest.trees) if len(forests) > 1 else 1
        values, n = [v + grown * x for v, x in zip(values, forest.featureImportances.toArray().tolist())], n + grown
    values = [v / max(n, 1) for v in values]
    return SparkSession.active().createDataFrame(list(zip(features, values)), "feature string, importance double")


def top_importances(table: DataFrame, k: int = 10) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(k)


# The variants of the ablation study.
VARIANTS = {"baseline": (), "drop_ports": ("src_port", "dst_port"), "drop_is_outbound": ("is_outbound",),
            "drop_ports_and_is_outbound": ("src_port", "dst_port", "is_outbound")}
COMPARED = ("recall", "fpr", "f1", "auc", "expected_false_alerts_per_day")


def vs_baseline(metrics: DataFrame, baseline: str = "baseline", by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Difference of each variant's metrics to the baseline of the same dataset."""
    base = metrics.filter(F.col("variant") == baseline).select(*by, *[F.col(c).alias(f"_{c}") for c in COMPARED])
    out = metrics.join(base, list(by))
    return out.withColumns({f"delta_{c}": F.col(c) - F.col(f"_{c}") for c in COMPARED}).drop(*[f"_{c}" for c in COMPARED])


def ablation(sessions: DataFrame, external: DataFrame, variants: dict[str, tuple[str, ...]] = VARIANTS, min_flows: int = 5,
             budget: float = FPR_BUDGET_V1, guard: float = 0.8, candidates: Sequence | None = None, seed: int = 42) -> DataFrame:
    """Train every variant, evaluate on the holdout and on other data, compare with the first."""
    sessions, external = cut(sessions), cut(external)
    rows = None
    for name, ablate in variants.items():
        detector, _ = train_detector(sessions, TR.TransformConfig(ablate=ablate), min_flows, budget, guard, candidates, seed)
        inside = evaluate_holdout(sessions, detector, budget, min_flows, seed).withColumn("dataset", F.lit("internal"))
        outside = evaluate_external(external, detector).withColumn("dataset", F.lit("external"))
        for part in (inside, outside):
            part = part.select(F.lit(name).alias("variant"), "dataset", "threshold", "tp", "fp", "fn", "tn", *COMPARED)
            rows = part if rows is None else rows.unionByName(part)
    return vs_baseline(rows, next(iter(variants)))
