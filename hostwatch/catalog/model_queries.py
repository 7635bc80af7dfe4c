"""Model-facing queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from hostwatch.catalog import frames as fr, query, sql
from hostwatch.catalog.frames import tidy
from hostwatch.operators import metrics as M, sessions as SS, splits as SP, transforms as TR
from hostwatch.operators.lineage import cut
from hostwatch.plans import models as ML
from hostwatch.sources import tables as T


def vectors(spark, sf):
    """Embeddings as labelled samples with 64 feature columns."""
    e = T.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), (F.col("label") < 5).cast("int").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])


X = [f"x{i}" for i in range(64)]


@query("m01_forest_baseline")
def m01(spark, sf):
    _, scored, _ = ML.rf_baseline(vectors(spark, sf), X)
    return scored


@query("j10_top_importances")
def j10(spark, sf):
    return ML.top_importances(ML.rf_baseline(vectors(spark, sf), X)[2])


@query("m02_train_under_budget")
def m02(spark, sf):
    detector, scored = ML.train_detector(fr.stored(spark, sf), min_flows=3, budget=0.03)
    return M.binary_metrics(scored, detector.threshold, detector.budget)


@query("m02_candidate_families")
def m02_families(spark, sf):
    """The validation operating point of every family, from one training run."""
    detector, _ = ML.train_detector(fr.stored(spark, sf), min_flows=3, budget=0.03, candidates=ML.candidate_families())
    rows = [(i, r["candidate"], r["chosen"], r["threshold"], r["recall"], r["fpr"], r["f1"], r["auc"]) for i, r in enumerate(detector.metrics["candidates"])]
    return spark.createDataFrame(rows, "place int, candidate string, chosen boolean, threshold double, recall double, fpr double, f1 double, auc double")


@query("m04_batch_scoring")
def m04(spark, sf):
    data = ML.as_vectors(vectors(spark, sf), X)
    model = ML.Pipeline(stages=[LogisticRegression(regParam=0.1)]).fit(data)
    return ML.score(data, model)


# A fixed linear rule stands in for a fitted model where results must be the same in SQL.
def _rule(frame):
    values = np.stack(frame["embedding"]).astype(np.float64)
    return (values @ np.where(np.arange(values.shape[1]) % 2, -1.0, 1.0) > 0).astype(np.float64)


EMB = "WITH scored AS (SELECT vec_id AS sample_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, CASE WHEN list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)) > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS score FROM embeddings)"


def ruled(spark, sf):
    e = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") < 5).cast("int").alias("label"), "embedding")
    return ML.score_with(e, _rule)


@query("m04_user_model", f"{EMB} SELECT sample_id, label, score FROM scored")
def m04_user(spark, sf):
    return ruled(spark, sf)


CELLS = "count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn"


@query("m05_evaluate_external", f"{EMB}, c AS (SELECT {CELLS} FROM scored), r AS (SELECT *, tp / CAST(tp + fn AS DOUBLE) AS recall, fp / CAST(fp + tn AS DOUBLE) AS fpr, "
                                "2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1 FROM c) SELECT tp, fp, fn, tn, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1, "
                                "round((tp * tn + (tp * fp + fn * tn) / CAST(2 AS DOUBLE)) / (CAST(tp + fn AS DOUBLE) * (fp + tn)), 6) AS auc, fpr <= 0.015 AS budget_met, "
                                "round(CAST(1000000 AS DOUBLE) * (fp + tn) / (tp + fp + fn + tn) * fpr, 4) AS expected_false_alerts_per_day FROM r")
def m05(spark, sf):
    d = M.binary_metrics(ruled(spark, sf), 0.5, 0.015)
    return d.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("recall", "fpr", "f1", "auc")], "budget_met",
                    F.round("expected_false_alerts_per_day", 4).alias("expected_false_alerts_per_day"))


HELD = """n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(sample_id AS VARCHAR))) AS r, count(*) OVER (PARTITION BY label) AS m, count(*) OVER () AS total FROM scored),
  k AS (SELECT DISTINCT label, m, total, CAST(total - ceil(CAST(0.15 AS DOUBLE) * total) AS BIGINT) AS t FROM n),
  x AS (SELECT *, m * t / CAST(total AS DOUBLE) AS ex, CAST(floor(m * t / CAST(total AS DOUBLE)) AS BIGINT) AS fl FROM k),
  h AS (SELECT label, m - (fl + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, label) <= t - sum(fl) OVER () THEN 1 ELSE 0 END) AS held FROM x),
  test AS (SELECT n.* FROM n JOIN h ON n.label = h.label WHERE r <= held)"""


@query("m06_evaluate_holdout", f"{EMB}, {HELD} SELECT {CELLS}, count(*) AS n_test, count(*) FILTER (label = 1) AS n_c2, count(*) FILTER (label = 0) AS n_benign FROM test")
def m06(spark, sf):
    split = SP.random_stratified(ruled(spark, sf)).filter(F.col("split") == "test")
    d = M.confusion(split, 0.5)
    return d.withColumns({"n_test": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "n_c2": F.col("tp") + F.col("fn"), "n_benign": F.col("fp") + F.col("tn")})


@query("m07_score_report", f"{EMB}, {HELD} SELECT 'holdout' AS split_name, count(*) AS n_total, count(*) FILTER (label = 1) AS n_positive, round(avg(score), 6) AS score_mean, "
                           "round(avg(score) FILTER (label = 1), 6) AS positive_mean, round(quantile_cont(score, 0.5) FILTER (label = 0), 6) AS negative_p50, "
                           "round(avg(CAST(score >= 0.5 AS INTEGER)), 6) AS predicted_positive_rate FROM test")
def m07(spark, sf):
    split = SP.random_stratified(ruled(spark, sf)).filter(F.col("split") == "test")
    d = M.score_summary(split, 0.5, "holdout")
    return tidy(d.select("split_name", "n_total", "n_positive", "score_mean", "positive_mean", "negative_p50", "predicted_positive_rate"))


# A detector with fixed coefficients: its transforms, normaliser, pooling and operating point are the engine's, and SQL can follow them.
class LinearRule(Transformer):
    """Logistic score of some pooled features with given weights."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def _transform(self, df):
        values, names = vector_to_array("features"), SS.pooled_names()
        z = sum((values[names.index(n)] * w for n, w in self.weights.items()), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


HALF, RULE_WEIGHTS = 1705363200, {"iat_mean": 1.0, "orig_bytes_mean": -1.5, "is_outbound_mean": 0.25}


def fixed_detector(stored, min_flows=3):
    early = TR.apply_transforms(SS.min_flows(stored.filter(F.col("start_ts") < HALF), min_flows))
    return ML.Detector(LinearRule(RULE_WEIGHTS), 0.5, 0.03, normalizer=cut(TR.fit_normalizer(early)))


ENGINE = f"""WITH {sql.kept()}, v AS (SELECT session_id, start_ts, n_flows, ln(1 + iat) AS li, ln(1 + orig_bytes) AS lb, is_outbound AS o FROM kept),
  fit AS (SELECT avg(li) AS im, CASE WHEN stddev_pop(li) < 1e-6 THEN 1 ELSE stddev_pop(li) END AS isd, avg(lb) AS bm, CASE WHEN stddev_pop(lb) < 1e-6 THEN 1 ELSE stddev_pop(lb) END AS bsd,
    avg(o) AS om, CASE WHEN stddev_pop(o) < 1e-6 THEN 1 ELSE stddev_pop(o) END AS osd FROM v WHERE start_ts < {HALF} AND n_flows >= 3),
  labels_of AS (SELECT session_id, CASE WHEN 2 * sum(label) > count(label) THEN 1 ELSE 0 END AS label FROM tagged GROUP BY session_id),
  every AS (SELECT session_id AS sample_id, any_value(label) AS label, any_value(start_ts) AS start_ts, any_value(n_flows) AS n_flows,
    1 / (1 + exp(-(avg((li - im) / isd) - CAST(1.5 AS DOUBLE) * avg((lb - bm) / bsd) + CAST(0.25 AS DOUBLE) * avg((o - om) / osd)))) AS score
    FROM v JOIN labels_of USING (session_id), fit GROUP BY session_id)"""
RATES = """r AS (SELECT *, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall, coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0) AS fpr,
    coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1 FROM c),
  a AS (SELECT coalesce((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / CAST(2 AS DOUBLE))
    / nullif(CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0), 0), 0) AS auc
    FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS k FROM test))"""


@query("m05_engine_external", f"""{ENGINE}, test AS (SELECT * FROM every WHERE start_ts >= {HALF}), c AS (SELECT {CELLS} FROM test), {RATES}
  SELECT tp, fp, fn, tn, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1, round(auc, 6) AS auc, fpr <= CAST(0.03 AS DOUBLE) AS budget_met,
    round(CAST(1000000 AS DOUBLE) * (fp + tn) / (tp + fp + fn + tn) * fpr, 4) AS expected_false_alerts_per_day FROM r, a""")
def m05_engine(spark, sf):
    stored = cut(fr.stored(spark, sf))
    d = ML.evaluate_external(stored.filter(F.col("start_ts") >= HALF), fixed_detector(stored))
    return d.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("recall", "fpr", "f1", "auc")], "budget_met",
                    F.round("expected_false_alerts_per_day", 4).alias("expected_false_alerts_per_day"))


ENGINE_HELD = f"{ENGINE}, scored AS (SELECT sample_id, label, score FROM every WHERE n_flows >= 3), {HELD}"


@query("m06_engine_holdout", f"""{ENGINE_HELD}, c AS (SELECT {CELLS} FROM test), {RATES}
  SELECT tp, fp, fn, tn, tp + fn AS n_c2, fp + tn AS n_benign, tp + fp + fn + tn AS n_test, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1, round(auc, 6) AS auc FROM r, a""")
def m06_engine(spark, sf):
    stored = cut(fr.stored(spark, sf))
    d = ML.evaluate_holdout(stored, fixed_detector(stored), min_flows=3)
    return d.select("tp", "fp", "fn", "tn", "n_c2", "n_benign", "n_test", *[F.round(c, 6).alias(c) for c in ("recall", "fpr", "f1", "auc")])


SUMMARY_SQL = """count(*) AS n_total, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std,
  round(coalesce(avg(score) FILTER (label = 1), 0), 6) AS positive_mean, round(coalesce(avg(score) FILTER (label = 0), 0), 6) AS negative_mean,
  round(coalesce(quantile_cont(score, 0.5) FILTER (label = 1), 0), 6) AS positive_p50, round(coalesce(quantile_cont(score, 0.95) FILTER (label = 1), 0), 6) AS positive_p95,
  round(coalesce(quantile_cont(score, 0.5) FILTER (label = 0), 0), 6) AS negative_p50, round(coalesce(quantile_cont(score, 0.95) FILTER (label = 0), 0), 6) AS negative_p95,
  round(avg(CAST(score >= 0.5 AS INTEGER)), 6) AS predicted_positive_rate, round(coalesce(avg(CAST(score >= 0.5 AS INTEGER)) FILTER (label = 1), 0), 6) AS recall_at_threshold,
  round(coalesce(avg(CAST(score >= 0.5 AS INTEGER)) FILTER (label = 0), 0), 6) AS fpr_at_threshold"""


@query("m07_engine_report", f"""{ENGINE_HELD}, whole AS (SELECT * FROM every WHERE n_flows >= 3)
  SELECT 'holdout' AS split_name, {SUMMARY_SQL} FROM test UNION ALL SELECT 'full' AS split_name, {SUMMARY_SQL} FROM whole""")
def m07_engine(spark, sf):
    stored = cut(fr.stored(spark, sf))
    detector = fixed_detector(stored)
    reports = [ML.score_report(stored, detector, split, min_flows=3).drop("threshold") for split in ("holdout", "full")]
    return tidy(reports[0].unionByName(reports[1]))


@query("m07_detector_report")
def m07_detector(spark, sf):
    stored = cut(fr.stored(spark, sf))
    detector, _ = ML.train_detector(stored, min_flows=3, budget=0.03, candidates=[LogisticRegression(regParam=0.1, maxIter=20)])
    return ML.score_report(stored, detector, "holdout", min_flows=3)


@query("m08_ablation")
def m08(spark, sf):
    s = cut(fr.stored(spark, sf))
    early = F.col("start_ts") < 1705363200
    return ML.ablation(s.filter(early), s.filter(~early), min_flows=3, budget=0.03, candidates=[LogisticRegression(regParam=0.1, maxIter=20)])


@query("m09_prepare_frames", f"""WITH {sql.kept()}, s AS (SELECT session_id AS sample_id, label FROM (SELECT session_id, CASE WHEN 2 * sum(label) > count(label) THEN 1 ELSE 0 END AS label FROM tagged GROUP BY session_id)
    JOIN (SELECT DISTINCT session_id FROM kept WHERE n_flows >= 3) USING (session_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id)) AS r FROM s), k AS (SELECT label, count(*) AS m FROM s GROUP BY label),
  q AS (SELECT label, m, t, m * t / CAST(total AS DOUBLE) AS ex, CAST(floor(m * t / CAST(total AS DOUBLE)) AS BIGINT) AS fl FROM (SELECT *, CAST(sum(m) OVER () AS BIGINT) AS total,
    CAST(sum(m) OVER () - ceil(CAST(0.15 AS DOUBLE) * sum(m) OVER ()) AS BIGINT) AS t FROM k)),
  o1 AS (SELECT label, m, m - (fl + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, label) <= t - sum(fl) OVER () THEN 1 ELSE 0 END) AS held FROM q),
  q2 AS (SELECT label, m, t, m * t / CAST(total AS DOUBLE) AS ex, CAST(floor(m * t / CAST(total AS DOUBLE)) AS BIGINT) AS fl FROM (SELECT *, CAST(sum(m) OVER () AS BIGINT) AS total,
    CAST(sum(m) OVER () - ceil(CAST(0.15 AS DOUBLE) / (1 - CAST(0.15 AS DOUBLE)) * sum(m) OVER ()) AS BIGINT) AS t FROM (SELECT label, m - held AS m FROM o1))),
  o2 AS (SELECT label, m - (fl + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, label) <= t - sum(fl) OVER () THEN 1 ELSE 0 END) AS held FROM q2),
  sp AS (SELECT sample_id, CASE WHEN r <= o1.held THEN 'test' WHEN r <= o1.held + o2.held THEN 'val' ELSE 'train' END AS split FROM n JOIN o1 ON n.label = o1.label JOIN o2 ON n.label = o2.label),
  v AS (SELECT k.session_id AS sample_id, split, pos, ln(1 + iat) AS iat, ln(1 + orig_bytes) AS orig_bytes FROM kept k JOIN sp ON k.session_id = sp.sample_id),
  fit AS (SELECT avg(iat) AS im, stddev_pop(iat) AS isd, avg(orig_bytes) AS bm, stddev_pop(orig_bytes) AS bsd FROM v WHERE split = 'train')
  SELECT sample_id, split, pos, round((iat - im) / isd, 6) AS iat, round((orig_bytes - bm) / bsd, 6) AS orig_bytes FROM v, fit""")
def m09(spark, sf):
    frames, _ = TR.prepare(cut(fr.stored(spark, sf)), min_flows=3)
    d = frames.select("sample_id", "split", F.posexplode("flows").alias("p", "x"))
    return tidy(d.select("sample_id", "split", (F.col("p") + 1).cast("bigint").alias("pos"), "x.iat", "x.orig_bytes"))


@query("j03_vs_baseline", """WITH m AS (SELECT l_linestatus AS dataset, v.variant, count(*) FILTER (s >= t AND label = 1) / CAST(count(*) FILTER (label = 1) AS DOUBLE) AS recall,
    count(*) FILTER (s >= t AND label = 0) / CAST(count(*) FILTER (label = 0) AS DOUBLE) AS fpr
  FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, round(l_discount * 5 + l_tax * 2, 2) AS s, l_linestatus FROM lineitem),
    (VALUES ('baseline', CAST(0.3 AS DOUBLE)), ('strict', CAST(0.5 AS DOUBLE))) v(variant, t) GROUP BY ALL)
  SELECT m.dataset, m.variant, round(m.recall - b.recall, 6) AS delta_recall, round(m.fpr - b.fpr, 6) AS delta_fpr FROM m JOIN m b ON m.dataset = b.dataset AND b.variant = 'baseline'""")
def j03(spark, sf):
    d, rows = T.scored_from_lineitem(spark, sf), None
    for name, t in (("baseline", 0.3), ("strict", 0.5)):
        part = M.with_budget(M.rates(M.confusion(d, t, by=("l_linestatus",)))).withColumns({"variant": F.lit(name), "auc": F.lit(0.0)})
        rows = part if rows is None else rows.unionByName(part)
    out = ML.vs_baseline(rows.withColumnRenamed("l_linestatus", "dataset"))
    return tidy(out.select("dataset", "variant", "delta_recall", "delta_fpr"))


@query("c07_sessions_to_timelines", f"""WITH {sql.kept()}, s AS (SELECT session_id, min(start_ts) AS start_ts, min(start_ts) + sum(duration) AS end_ts,
    'unknown:events:dp' || CAST(CAST(trunc(median(dst_port)) AS BIGINT) AS VARCHAR) || ':sp' || CAST(CAST(trunc(median(src_port)) AS BIGINT) AS VARCHAR)
    || ':br' || CAST(CAST(trunc(median(least(byte_ratio, 1e6)) * 100) AS BIGINT) AS VARCHAR) || ':pr' || CAST(CAST(trunc(median(least(packet_ratio, 1e6)) * 100) AS BIGINT) AS VARCHAR)
    || ':o' || CAST(CAST(round_even(avg(is_outbound), 0) AS BIGINT) AS VARCHAR) AS host_id FROM kept GROUP BY session_id)
  SELECT session_id, host_id, row_number() OVER h AS n, round(start_ts - lag(end_ts) OVER h, 6) AS inter_session_gap FROM s WINDOW h AS (PARTITION BY host_id ORDER BY start_ts, end_ts, session_id)""")
def c07(spark, sf):
    from hostwatch.operators import sessions as SS, timeline as TL

    d = TR.map_flows(fr.stored(spark, sf), lambda f, x: F.least(x, F.lit(1e6)) if f in ("byte_ratio", "packet_ratio") else x)
    rows = TL.build_host_sessions(TL.cut(SS.summarize_sequences(SS.with_host_key(d))))
    return tidy(rows.select("session_id", "host_id", "n", "inter_session_gap"))
