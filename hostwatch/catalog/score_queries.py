"""Queries over scored samples, and feature drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostwatch.catalog import frames as fr, query, sql
from hostwatch.catalog.frames import tidy
from hostwatch.config import FEATURES
from hostwatch.operators import drift as DR, metrics as M, rank as R
from hostwatch.operators.lineage import cut
from hostwatch.sources import tables as T

TIED, FINE = f"WITH {sql.SCORES}", f"WITH {sql.FINE}"


def _cells(threshold: str) -> str:
    up = f"score >= CAST({threshold} AS DOUBLE)"
    return (f"count(*) FILTER ({up} AND label = 1) AS tp, count(*) FILTER ({up} AND label = 0) AS fp, "
            f"count(*) FILTER (NOT {up} AND label = 1) AS fn, count(*) FILTER (NOT {up} AND label = 0) AS tn")


def tied(spark, sf):
    return T.scored_from_lineitem(spark, sf)


def fine(spark, sf):
    return T.scored_from_lineitem(spark, sf, fine=True)


def _summary_sql(scores: str, threshold: float, name: str) -> str:
    def per(kind: str, label: int) -> str:
        return (f"round(coalesce(avg(score) FILTER (label = {label}), 0), 8) AS {kind}_mean, "
                f"round(coalesce(quantile_cont(score, 0.5) FILTER (label = {label}), 0), 8) AS {kind}_p50, "
                f"round(coalesce(quantile_cont(score, 0.95) FILTER (label = {label}), 0), 8) AS {kind}_p95")

    return (f"{scores} SELECT '{name}' AS split_name, CAST({threshold} AS DOUBLE) AS threshold, count(*) AS n_total, count(*) FILTER (label = 1) AS n_positive, "
            f"count(*) FILTER (label = 0) AS n_negative, round(avg(score), 8) AS score_mean, round(stddev_pop(score), 8) AS score_std, {per('positive', 1)}, {per('negative', 0)}, "
            f"round(avg(CAST(score >= CAST({threshold} AS DOUBLE) AS INTEGER)), 8) AS predicted_positive_rate, "
            f"round(count(*) FILTER (score >= CAST({threshold} AS DOUBLE) AND label = 1) / CAST(count(*) FILTER (label = 1) AS DOUBLE), 8) AS recall_at_threshold, "
            f"round(count(*) FILTER (score >= CAST({threshold} AS DOUBLE) AND label = 0) / CAST(count(*) FILTER (label = 0) AS DOUBLE), 8) AS fpr_at_threshold FROM scored")


@query("a19_score_summary", _summary_sql(TIED, 0.3, "full"))
def a19(spark, sf):
    return tidy(M.score_summary(tied(spark, sf), 0.3), 8)


@query("a19_score_summary_fine", _summary_sql(FINE, 0.4, "fine"))
def a19_fine(spark, sf):
    return tidy(M.score_summary(fine(spark, sf), 0.4, "fine"), 8)


@query("a20_confusion", f"{TIED} SELECT l_linestatus, {_cells('0.3')} FROM scored GROUP BY l_linestatus")
def a20(spark, sf):
    return M.confusion(tied(spark, sf), 0.3, by=("l_linestatus",))


@query("a21_rates", f"{TIED}, c AS (SELECT l_linestatus, {_cells('0.3')} FROM scored GROUP BY l_linestatus) SELECT *, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, "
                    "round(fp / CAST(fp + tn AS DOUBLE), 6) AS fpr, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM c")
def a21(spark, sf):
    return tidy(M.rates(M.confusion(tied(spark, sf), 0.3, by=("l_linestatus",))))


AUC = "round(sum(n_neg * (tp - n_pos / CAST(2 AS DOUBLE))) / (CAST(any_value(p) AS DOUBLE) * any_value(n)), 8)"


@query("a22_roc_auc", f"{TIED}, {sql.POINTS} SELECT {AUC} AS auc FROM points")
def a22(spark, sf):
    return tidy(M.roc_auc(tied(spark, sf)), 8)


@query("a22_roc_auc_fine", f"{FINE}, {sql.POINTS} SELECT {AUC} AS auc FROM points")
def a22_fine(spark, sf):
    return tidy(M.roc_auc(fine(spark, sf)), 8)


@query("a23_classification_report", f"""{TIED}, c AS (SELECT {_cells('0.3')} FROM scored), k AS (
  SELECT 'benign' AS class, tn / CAST(tn + fn AS DOUBLE) AS precision, tn / CAST(tn + fp AS DOUBLE) AS recall, 2 * tn / CAST(2 * tn + fn + fp AS DOUBLE) AS f1, tn + fp AS support FROM c
  UNION ALL SELECT 'c2', tp / CAST(tp + fp AS DOUBLE), tp / CAST(tp + fn AS DOUBLE), 2 * tp / CAST(2 * tp + fn + fp AS DOUBLE), tp + fn FROM c),
  r AS (SELECT * FROM k UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS a, tp + tn + fp + fn AS n FROM c)
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM k
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM k)
  SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r""")
def a23(spark, sf):
    return tidy(M.classification_report(tied(spark, sf), 0.3))


ROC = "score AS threshold, fp / CAST(n AS DOUBLE) AS fpr, tp / CAST(p AS DOUBLE) AS tpr"


@query("a24_roc_curve", f"{TIED}, {sql.POINTS}, r AS (SELECT {ROC} FROM points UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0) "
                        "SELECT threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM r")
def a24(spark, sf):
    d = M.roc_curve(tied(spark, sf))
    return d.select("threshold", F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"))


@query("a24_roc_curve_fine", f"{FINE}, {sql.POINTS}, r AS (SELECT {ROC} FROM points UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0) "
                             "SELECT threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM r")
def a24_fine(spark, sf):
    d = M.roc_curve(fine(spark, sf))
    return d.select("threshold", F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"))


def _threshold_sql(scores: str, budget: float) -> str:
    return (f"{scores}, {sql.POINTS}, r AS (SELECT {ROC} FROM points UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0) SELECT threshold, round(tpr, 8) AS recall, round(fpr, 8) AS fpr, "
            f"TRUE AS feasible FROM r WHERE fpr <= CAST({budget} AS DOUBLE) ORDER BY tpr DESC, threshold DESC LIMIT 1")


@query("a25_fpr_threshold", _threshold_sql(TIED, 0.015))
def a25(spark, sf):
    d = M.threshold_under_fpr(tied(spark, sf), 0.015)
    return d.select("threshold", F.round("recall", 8).alias("recall"), F.round("fpr", 8).alias("fpr"), "feasible")


@query("a25_fpr_threshold_fine", _threshold_sql(FINE, 0.03))
def a25_fine(spark, sf):
    d = M.threshold_under_fpr(fine(spark, sf), 0.03)
    return d.select("threshold", F.round("recall", 8).alias("recall"), F.round("fpr", 8).alias("fpr"), "feasible")


PR = "score AS threshold, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(p AS DOUBLE) AS recall, CASE WHEN tp > 0 THEN 2 * tp / CAST(tp + fp + p AS DOUBLE) ELSE 0 END AS f1"


@query("a26_pr_curve", f"{TIED}, {sql.POINTS}, r AS (SELECT {PR} FROM points) SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def a26(spark, sf):
    return tidy(M.pr_curve(tied(spark, sf)))


@query("a26_best_f1", f"{FINE}, {sql.POINTS}, r AS (SELECT {PR} FROM points) SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM r ORDER BY round(f1, 12) DESC, threshold LIMIT 1")
def a26_best(spark, sf):
    return tidy(M.best_f1_threshold(fine(spark, sf)))


def _metrics_sql(scores: str, threshold: float, budget: float) -> str:
    return (f"{scores}, {sql.POINTS}, c AS (SELECT {_cells(str(threshold))} FROM scored), a AS (SELECT {AUC} AS auc FROM points), "
            "m AS (SELECT *, tp / CAST(tp + fn AS DOUBLE) AS recall, fp / CAST(fp + tn AS DOUBLE) AS fpr, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1 FROM c, a) "
            f"SELECT tp, fp, fn, tn, CAST({threshold} AS DOUBLE) AS threshold, round(auc, 6) AS auc, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1, "
            f"fpr <= CAST({budget} AS DOUBLE) + 1e-12 AS budget_met, round(CAST(1000000 AS DOUBLE) * (fp + tn) / (tp + fp + fn + tn) * fpr, 4) AS expected_false_alerts_per_day FROM m")


def _metrics(d):
    return d.select("tp", "fp", "fn", "tn", "threshold", *[F.round(c, 6).alias(c) for c in ("auc", "recall", "fpr", "f1")], "budget_met",
                    F.round("expected_false_alerts_per_day", 4).alias("expected_false_alerts_per_day"))


@query("a27_false_alerts", _metrics_sql(TIED, 0.6, 0.015))
def a27(spark, sf):
    return _metrics(M.binary_metrics(tied(spark, sf), 0.6, budget=0.015))


@query("a28_budget_met", _metrics_sql(FINE, 0.45, 0.6))
def a28(spark, sf):
    return _metrics(M.binary_metrics(fine(spark, sf), 0.45, budget=0.6))


@query("a29_mean_focal_loss", f"""{TIED}, z AS (SELECT label, score * 10 - 3 AS z FROM scored), p AS (SELECT *, 1 / (1 + exp(-z)) AS p, greatest(z, 0) - z * label + ln(1 + exp(-abs(z))) AS bce FROM z),
  l AS (SELECT CASE WHEN label = 1 THEN 0.5 * (1 - p) * bce ELSE 0.5 * p * bce END AS loss FROM p) SELECT 'mean' AS reduction, round(avg(loss), 6) AS loss FROM l UNION ALL SELECT 'sum', round(sum(loss), 3) FROM l""")
def a29(spark, sf):
    d = tied(spark, sf).withColumn("logit", F.col("score") * 10 - 3)
    mean = M.mean_focal_loss(d).select(F.lit("mean").alias("reduction"), F.round("loss", 6).alias("loss"))
    return mean.unionByName(M.mean_focal_loss(d, reduction="sum").select(F.lit("sum").alias("reduction"), F.round("loss", 3).alias("loss")))


@query("m03_rank_operating_points", f"""{TIED}, c AS (SELECT 'status ' || l_linestatus AS candidate, {_cells('0.5')} FROM scored GROUP BY l_linestatus
    UNION ALL SELECT 'tight', {_cells('0.6')} FROM scored UNION ALL SELECT 'wide', {_cells('0.5')} FROM scored),
  r AS (SELECT candidate, tp / CAST(tp + fn AS DOUBLE) AS recall, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1, fp / CAST(fp + tn AS DOUBLE) AS fpr FROM c)
  SELECT candidate, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr FROM r ORDER BY round(recall, 12) DESC, round(f1, 12) DESC, round(fpr, 12), candidate LIMIT 1""")
def m03(spark, sf):
    d = tied(spark, sf)
    parts = M.confusion(d, 0.5, by=("l_linestatus",)).withColumn("candidate", F.concat(F.lit("status "), "l_linestatus")).drop("l_linestatus")
    for name, threshold in (("tight", 0.6), ("wide", 0.5)):
        parts = parts.unionByName(M.confusion(d, threshold).withColumn("candidate", F.lit(name)))
    return tidy(M.rank_operating_points(M.rates(parts)).select("candidate", "recall", "f1", "fpr"))


@query("x01_global_rank", "SELECT l_orderkey, l_linenumber, l_extendedprice, rank() OVER (ORDER BY l_extendedprice) AS rank FROM lineitem")
def x01(spark, sf):
    line = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return R.global_rank(line, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("x01_exact_quantiles", "SELECT l_shipmode, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 "
                              "FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_extendedprice FROM lineitem) GROUP BY l_shipmode")
def x01_quantiles(spark, sf):
    line = T.table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"), "l_extendedprice")
    return tidy(R.exact_quantiles(line, "l_extendedprice", {"median": 0.5, "p95": 0.95}, by=("l_shipmode",)))


# --- drift -----------------------------------------------------------------------------------------------

HALF = 1705363200  # the middle of the month the events cover


def _side(side: str, test: str) -> str:
    return f"{side} AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg(least({f}, 1e6)) AS {side}_mean, stddev_pop(least({f}, 1e6)) AS {side}_std, median(least({f}, 1e6)) AS {side}_median, "
        f"quantile_cont(least({f}, 1e6), 0.95) AS {side}_p95 FROM kept WHERE n_flows >= 3 AND start_ts {test} {HALF}" for f in FEATURES) + ")"


DRIFT = (f"WITH {sql.kept()}, {_side('source', '<')}, {_side('target', '>=')}, d AS (SELECT *, abs(target_mean - source_mean) / (sqrt((source_std ** 2 + target_std ** 2) / 2) + 1e-9) "
         "AS standardized_mean_shift, (target_median + 1e-9) / CASE WHEN abs(source_median + 1e-9) > 1e-9 THEN abs(source_median + 1e-9) ELSE 1e-9 END AS median_ratio "
         "FROM source JOIN target USING (feature))")
COLUMNS = ("source_mean", "target_mean", "source_std", "target_std", "source_median", "target_median", "source_p95", "target_p95")


def drift(spark, sf):
    from hostwatch.operators.transforms import map_flows

    # Both sides and all statistics read the sessions: build them once.
    s = cut(map_flows(fr.sessions(spark, sf), lambda f, x: F.least(x, F.lit(1e6))))
    return DR.feature_drift(s.filter(F.col("start_ts") < HALF), s.filter(F.col("start_ts") >= HALF), min_flows=3)


@query("a18_feature_drift", f"{DRIFT} SELECT feature, {', '.join(f'round({c}, 4) AS {c}' for c in COLUMNS)}, round(standardized_mean_shift, 6) AS standardized_mean_shift, "
                            "round(median_ratio, 6) AS median_ratio FROM d")
def a18(spark, sf):
    d = drift(spark, sf)
    return d.select("feature", *[F.round(c, 4).alias(c) for c in COLUMNS], F.round("standardized_mean_shift", 6).alias("standardized_mean_shift"),
                    F.round("median_ratio", 6).alias("median_ratio"))


@query("j04_source_target_join", f"{DRIFT} SELECT feature, round(target_mean - source_mean, 4) AS mean_change, round(target_p95 - source_p95, 4) AS p95_change FROM d")
def j04(spark, sf):
    d = drift(spark, sf)
    return d.select("feature", F.round(F.col("target_mean") - F.col("source_mean"), 4).alias("mean_change"),
                    F.round(F.col("target_p95") - F.col("source_p95"), 4).alias("p95_change"))


@query("j08_top_drift", f"{DRIFT} SELECT feature, round(standardized_mean_shift, 6) AS standardized_mean_shift FROM d ORDER BY d.standardized_mean_shift DESC, feature LIMIT 5")
def j08(spark, sf):
    return tidy(DR.top_drift(drift(spark, sf), 5).select("feature", "standardized_mean_shift"))


def _limited_side(side: str, test: str) -> str:
    return f"{side} AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg({f}) AS {side}_mean, stddev_pop({f}) AS {side}_std, median({f}) AS {side}_median, quantile_cont({f}, 0.95) AS {side}_p95 "
        f"FROM limited WHERE n_flows >= 3 AND start_ts {test} {HALF}" for f in FEATURES) + ")"


@query("a18_drift_limited", f"WITH {sql.limited()}, {_limited_side('source', '<')}, {_limited_side('target', '>=')} SELECT feature, {', '.join(f'round({c}, 4) AS {c}' for c in COLUMNS)}, "
                            "round(abs(target_mean - source_mean) / (sqrt((source_std ** 2 + target_std ** 2) / 2) + 1e-9), 6) AS standardized_mean_shift FROM source JOIN target USING (feature)")
def a18_limited(spark, sf):
    s = cut(fr.limited(spark, sf))
    d = DR.feature_drift(s.filter(F.col("start_ts") < HALF), s.filter(F.col("start_ts") >= HALF), min_flows=3)
    return d.select("feature", *[F.round(c, 4).alias(c) for c in COLUMNS], F.round("standardized_mean_shift", 6).alias("standardized_mean_shift"))
