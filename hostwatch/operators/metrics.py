"""Detector metrics from scored samples ``(label, score)``.

Scores are counted per distinct value once; every metric is an aggregate over those counts and their
running sums, so ties are exact and no step sorts all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostwatch.config import DAILY_FLOWS, FPR_BUDGET
from hostwatch.functions.scalars import focal_loss
from hostwatch.operators.rank import global_running_sum, interpolated

INF = float("inf")


def score_points(scored: DataFrame) -> DataFrame:
    """Distinct scores with their counts, and true and false positives at "score or higher"."""
    counts = scored.groupBy("score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("n_pos"), F.count(F.when(F.col("label") == 0, 1)).alias("n_neg"))
    return global_running_sum(counts, "score", {"tp": "n_pos", "fp": "n_neg"}, descending=True)


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def roc_curve(scored: DataFrame) -> DataFrame:
    """Every distinct score as a threshold, and the start point above all scores."""
    points = score_points(scored).select(F.col("score").alias("threshold"), _share(F.col("fp"), F.col("fp_total")).alias("fpr"),
                                         _share(F.col("tp"), F.col("tp_total")).alias("tpr"))
    start = scored.sparkSession.createDataFrame([(INF, 0.0, 0.0)], points.schema)
    return points.unionByName(start)


def _auc() -> Column:
    area = F.sum(F.col("n_neg") * (F.col("tp") - F.col("n_pos") / 2.0))
    pairs = F.max("tp_total").cast("double") * F.max("fp_total")
    return F.coalesce(F.when(pairs > 0, area / pairs), F.lit(0.0))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Exact area under the ROC curve, ties count half; 0 with a single class."""
    return score_points(scored).agg(_auc().alias("auc"))


def threshold_under_fpr(scored: DataFrame, max_fpr: float = FPR_BUDGET) -> DataFrame:
    """Highest threshold among those with the best recall whose false-positive rate is within the budget."""
    if not 0.0 <= max_fpr <= 1.0:
        raise ValueError(f"max_fpr must be in [0, 1], got {max_fpr}")
    tpr, fpr = F.col("tp") / F.col("tp_total"), F.col("fp") / F.col("fp_total")
    ok = (F.col("fp_total") > 0) & (F.col("tp_total") > 0) & (F.col("tp") > 0)
    usable = F.when(ok, F.when(fpr <= max_fpr, F.struct(tpr.alias("recall"), F.col("score").cast("double").alias("threshold"),
                                                        fpr.alias("fpr"))))
    best = score_points(scored).agg(F.max(usable).alias("b"), F.coalesce(F.max("tp_total"), F.lit(0)).alias("p"),
                                    F.coalesce(F.max("fp_total"), F.lit(0)).alias("n"))
    none, only = F.col("p") == 0, F.col("n") == 0

    def result(without_positives: float, without_negatives: float, start: float, field: str) -> Column:
        return (F.when(none, F.lit(without_positives)).when(only, F.lit(without_negatives))
                .otherwise(F.coalesce(F.col(f"b.{field}"), F.lit(start))).alias(field))

    return best.select(result(1.0, 0.0, INF, "threshold"), result(0.0, 1.0, 0.0, "recall"), result(0.0, 0.0, 0.0, "fpr"),
                       (~none).alias("feasible"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision, recall and F1 at every distinct score."""
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp_total"))
    out = score_points(scored).select(F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def best_f1_threshold(scored: DataFrame) -> DataFrame:
    """Threshold with the highest F1; the lowest of several."""
    best = pr_curve(scored).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("neg"))).alias("b"))
    return best.select((-F.col("b.neg")).alias("threshold"), F.col("b.f1").alias("f1"))


def _cells(threshold: float) -> dict[str, Column]:
    up, pos, neg = F.col("score") >= F.lit(float(threshold)), F.col("label") == 1, F.col("label") == 0
    return {"tp": F.count(F.when(up & pos, 1)), "fp": F.count(F.when(up & neg, 1)),
            "fn": F.count(F.when(~up & pos, 1)), "tn": F.count(F.when(~up & neg, 1))}


def confusion(scored: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The four counts; zero where a class is missing."""
    return scored.groupBy(*by).agg(*[c.alias(n) for n, c in _cells(threshold).items()])


def rates(df: DataFrame) -> DataFrame:
    """Recall, false-positive rate and F1 from confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"recall": _share(tp, tp + fn), "fpr": _share(fp, fp + tn), "f1": _share(2.0 * tp, 2 * tp + fp + fn)})


def with_budget(df: DataFrame, budget: float = FPR_BUDGET, daily_flows: int = DAILY_FLOWS) -> DataFrame:
    """Whether the budget holds, and the false alerts to expect per day."""
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    benign = _share((F.col("fp") + F.col("tn")).cast("double"), total)
    return df.withColumns({"budget_met": F.col("fpr") <= F.lit(budget + 1e-12),
                           "expected_false_alerts_per_day": F.lit(float(daily_flows)) * benign * F.col("fpr")})


def binary_metrics(scored: DataFrame, threshold: float, budget: float = FPR_BUDGET, daily_flows: int = DAILY_FLOWS) -> DataFrame:
    """One row with all operating-point metrics."""
    up = F.col("score") >= F.lit(float(threshold))

    def total(column: str, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0))

    cells = score_points(scored).agg(
        total("n_pos", up).alias("tp"), total("n_neg", up).alias("fp"), total("n_pos", ~up).alias("fn"),
        total("n_neg", ~up).alias("tn"), _auc().alias("auc"))
    return with_budget(rates(cells.withColumn("threshold", F.lit(float(threshold)))), budget, daily_flows)


def classification_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support per class, their averages, and accuracy."""
    c = confusion(scored, threshold)
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))

    def row(name: str, hit: Column, false: Column, missed: Column) -> Column:
        p, r = _share(hit, hit + false), _share(hit, hit + missed)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        _share(2.0 * hit, 2 * hit + false + missed).alias("f1"), (hit + missed).alias("support"))

    c = c.withColumns({"b": row("benign", tn, fn, fp), "c": row("c2", tp, fp, fn)})
    b, p = F.col("b"), F.col("c")
    total = b["support"] + p["support"]

    def average(name: str, wb: Column, wp: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), *[_share(b[m] * wb + p[m] * wp, wb + wp).alias(m)
                                                      for m in ("precision", "recall", "f1")], total.alias("support"))

    right = _share(tp + tn, total)
    accuracy = F.struct(F.lit("accuracy").alias("class"), right.alias("precision"), right.alias("recall"), right.alias("f1"),
                        total.alias("support"))
    one = F.lit(1.0)
    return c.select(F.inline(F.array(b, p, accuracy, average("macro avg", one, one),
                                     average("weighted avg", b["support"].cast("double"), p["support"].cast("double")))))


def score_summary(scored: DataFrame, threshold: float, name: str = "full") -> DataFrame:
    """Score distribution per class, and rates at the threshold; one row."""
    s, p, n = F.col("score"), F.col("n_pos"), F.col("n_neg")
    both = p + n
    up = s >= F.lit(float(threshold))

    def total(e: Column) -> Column:
        return F.coalesce(F.sum(e), F.lit(0))

    def quantile(count: str, cum: str, q: float) -> Column:
        # tp and fp count from the top; quantile positions count from the bottom.
        up_to = F.col(f"{cum}_total") - F.col(cum) + F.col(count)
        return F.coalesce(interpolated(s, up_to, F.col(count), F.col(f"{cum}_total"), q), F.lit(0.0))

    mean = F.sum(s * both) / F.sum(both)
    out = score_points(scored).agg(
        total(both).alias("n_total"), total(p).alias("n_positive"), total(n).alias("n_negative"), mean.alias("score_mean"),
        F.sqrt(F.greatest(F.sum(s * s * both) / F.sum(both) - mean * mean, F.lit(0.0))).alias("score_std"),
        _share(F.sum(s * p), F.sum(p)).alias("positive_mean"), _share(F.sum(s * n), F.sum(n)).alias("negative_mean"),
        quantile("n_pos", "tp", 0.5).alias("positive_p50"), quantile("n_pos", "tp", 0.95).alias("positive_p95"),
        quantile("n_neg", "fp", 0.5).alias("negative_p50"), quantile("n_neg", "fp", 0.95).alias("negative_p95"),
        _share(total(F.when(up, both)), F.sum(both)).alias("predicted_positive_rate"),
        _share(total(F.when(up, p)), F.sum(p)).alias("recall_at_threshold"),
        _share(total(F.when(up, n)), F.sum(n)).alias("fpr_at_threshold"))
    return out.withColumns({"split_name": F.lit(name), "threshold": F.lit(float(threshold))})


def mean_focal_loss(df: DataFrame, logit: str = "logit", label: str = "label", alpha: float = 0.5, gamma: float = 1.0,
                    reduction: str = "mean") -> DataFrame:
    """Focal loss per row, or its mean or sum."""
    loss = focal_loss(logit, label, alpha, gamma)
    if reduction == "none":
        return df.withColumn("loss", loss)
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction: {reduction}")
    return df.agg((F.avg(loss) if reduction == "mean" else F.sum(loss)).alias("loss"))


def rank_operating_points(points: DataFrame, name: str = "candidate") -> DataFrame:
    """The best candidate: recall, then F1, then low false-positive rate; equal ones by name."""
    def key(c: Column) -> Column:
        return F.round(c, 12)

    order = [F.desc(key(F.col("recall"))), F.desc(key(F.col("f1"))), F.asc(key(F.col("fpr"))), F.asc(name)]
    return points.orderBy(*order).limit(1)
