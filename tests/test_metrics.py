import math
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from hostwatch.operators import drift as DR, metrics as M
from hostwatch.plans import models as ML
from hostwatch.sources.datasets import load_model, save_model
from test_sessions import stored


def scored(spark, pairs):
    return spark.createDataFrame([(y, float(s)) for y, s in pairs], "label int, score double")


CASE = [(0, .01), (0, .02), (0, .30), (1, .80), (1, .90)]


def test_threshold_under_budget(spark):
    assert tuple(M.threshold_under_fpr(scored(spark, CASE), 0.005).first()) == (0.80, 1.0, 0.0, True)
    assert tuple(M.threshold_under_fpr(scored(spark, [(0, .1), (0, .2)]), 0.1).first()) == (1.0, 0.0, 0.0, False)
    assert tuple(M.threshold_under_fpr(scored(spark, [(1, .1), (1, .2)]), 0.1).first()) == (0.0, 1.0, 0.0, True)
    assert tuple(M.threshold_under_fpr(scored(spark, []), 0.1).first()) == (1.0, 0.0, 0.0, False)
    assert tuple(M.threshold_under_fpr(scored(spark, [(0, .9), (1, .1)]), 0.0).first()) == (math.inf, 0.0, 0.0, True)
    with pytest.raises(ValueError):
        M.threshold_under_fpr(scored(spark, CASE), 1.5)


def brute(pairs, budget):
    p, n = sum(y for y, _ in pairs), sum(1 - y for y, _ in pairs)
    best = (0.0, math.inf, 0.0)
    for t in {s for _, s in pairs}:
        tpr, fpr = sum(y for y, s in pairs if s >= t) / p, sum(1 - y for y, s in pairs if s >= t) / n
        if fpr <= budget and (tpr, t) > best[:2] and tpr > 0:
            best = (tpr, t, fpr)
    auc = sum((a > b) + 0.5 * (a == b) for ya, a in pairs if ya for yb, b in pairs if not yb) / (p * n)
    return best, auc


@pytest.mark.parametrize("digits", [1, 6])
def test_against_brute_force(spark, digits):
    rnd = random.Random(digits)
    pairs = [(int(rnd.random() < 0.3), round(rnd.random(), digits)) for _ in range(300)]
    df = scored(spark, pairs)
    best, auc = brute(pairs, 0.1)
    r = M.threshold_under_fpr(df, 0.1).first()
    assert (r.recall, r.threshold, r.fpr) == pytest.approx(best)
    assert M.roc_auc(df).first().auc == pytest.approx(auc)
    row = M.binary_metrics(df, 0.5).first()
    assert (row.tp, row.fp) == (sum(y and s >= 0.5 for y, s in pairs), sum((not y) and s >= 0.5 for y, s in pairs))
    assert row.auc == pytest.approx(auc)


def test_single_class(spark):
    df = scored(spark, [(0, .1), (0, .9)])
    r = M.binary_metrics(df, 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.auc, r.recall, r.f1, r.fpr, r.expected_false_alerts_per_day) == (0, 1, 0, 1, 0.0, 0.0, 0.0, 0.5, 500000.0)
    s = M.score_summary(df, 0.5).first()
    assert (s.n_positive, s.positive_mean, s.positive_p95, s.negative_p50) == (0, 0.0, 0.0, 0.5)


def test_budget_flag(spark):
    df = scored(spark, [(0, .9)] + [(0, .1)] * 199 + [(1, .95)])
    assert M.binary_metrics(df, 0.5, budget=0.005).first().budget_met is True
    assert M.binary_metrics(df, 0.5, budget=0.004).first().budget_met is False


def test_best_f1(spark):
    r = M.best_f1_threshold(scored(spark, CASE)).first()
    assert (r.threshold, r.f1) == (0.80, 1.0)
    assert M.best_f1_threshold(scored(spark, [(0, .3), (0, .1)])).first().threshold == 0.1


def test_report(spark):
    got = {r["class"]: r for r in M.classification_report(scored(spark, CASE + [(1, .1)]), 0.5).collect()}
    assert got["c2"].precision == 1.0 and got["c2"].recall == pytest.approx(2 / 3) and got["accuracy"].f1 == pytest.approx(5 / 6)
    assert got["macro avg"].recall == pytest.approx((1 + 2 / 3) / 2) and got["weighted avg"].support == 6


def test_rank_operating_points(spark):
    df = spark.createDataFrame([("a", .8, .5, .01), ("b", .9, .4, .02), ("c", .9, .6, .03), ("d", .9, .6, .02)],
                               "candidate string, recall double, f1 double, fpr double")
    assert M.rank_operating_points(df).first().candidate == "d"


def test_focal_reductions(spark):
    df = spark.createDataFrame([(0.3, 1), (-0.7, 0)], "logit double, label int")
    each = [r.loss for r in M.mean_focal_loss(df, reduction="none").collect()]
    assert M.mean_focal_loss(df).first().loss == pytest.approx(sum(each) / 2)
    assert M.mean_focal_loss(df, reduction="sum").first().loss == pytest.approx(sum(each))
    with pytest.raises(ValueError):
        M.mean_focal_loss(df, reduction="max")


def test_drift(spark):
    a = stored(spark, [[{"orig_bytes": v, "iat": 1} for v in (1, 2, 3, 4, 10)]]).withColumn("n_flows", F.size("flows"))
    b = stored(spark, [[{"orig_bytes": v + 5, "iat": 1} for v in (1, 2, 3, 4, 10)], [{"orig_bytes": 1e6}]]).withColumn("n_flows", F.size("flows"))
    got = {r.feature: r for r in DR.feature_drift(a, b).collect()}
    r = got["orig_bytes"]
    assert (r.source_median, r.target_median, r.target_mean) == (3.0, 8.0, 9.0) and r.source_p95 == pytest.approx(8.8)
    assert r.standardized_mean_shift == pytest.approx(5 / r.source_std) and r.median_ratio == pytest.approx(8 / 3)
    assert got["iat"].standardized_mean_shift == 0.0 and got["resp_bytes"].median_ratio == pytest.approx(1.0)
    assert DR.top_drift(DR.feature_drift(a, b), 1).first().feature == "orig_bytes"
    approx = {r.feature: r for r in DR.feature_drift(a, b, exact=False).collect()}
    assert approx["orig_bytes"].source_median == 3.0


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(9)
    data = []
    for i in range(200):
        y = int(i % 4 == 0)
        data.append([{"orig_bytes": rnd.gauss(50 + 400 * y, 20), "iat": rnd.gauss(5 - 3 * y, 1), "dst_port": 443} for _ in range(6)])
    df = stored(spark, data).withColumns({"n_flows": F.size("flows"), "sample_id": F.col("session_id")})
    return df.withColumn("label", (F.substr("session_id", F.lit(2), F.lit(9)).cast("int") % 4 == 0).cast("int")).cache()


def fast():
    return [LogisticRegression(regParam=0.1)]


def test_train_evaluate_save(spark, labelled, tmp_path):
    from hostwatch.sources import datasets as DS

    detector, test = ML.train_detector(labelled, candidates=fast())
    assert detector.metrics["recall"] > 0.9 and test.count() == 30
    external = ML.evaluate_external(labelled, detector).first()
    assert external.auc > 0.95 and external.tp + external.fp + external.fn + external.tn == 200
    inside = ML.evaluate_holdout(labelled, detector).first()
    assert inside.n_test == 30 and inside.n_c2 + inside.n_benign == 30
    assert ML.score_report(labelled, detector, "holdout").first().n_total == 30
    assert ML.score_report(labelled, detector).first().n_total == 200
    DS.save_model(detector.model, detector.operating_point(), str(tmp_path / "m"))
    back = ML.detector_from(*DS.load_model(spark, str(tmp_path / "m")))
    assert back.threshold == detector.threshold and back.transforms == detector.transforms
    assert ML.evaluate_external(labelled, back).first() == external
    with pytest.raises(ValueError, match="refusing"):
        ML.evaluate_external(labelled, ML.Detector(detector.model, None))


def test_sessions_are_built_once_for_training(spark, labelled):
    """Counts, split, normaliser and vectors all read the sessions; what gives them runs once."""
    built = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            built.add(batch.num_rows)
            yield batch

    small = labelled.select("sample_id", "label", "n_flows", "flows")
    detector, test = ML.train_detector(small.mapInArrow(counted, small.schema), candidates=fast())
    assert test.count() == 30 and detector.metrics["recall"] > 0.9
    assert built.value == 200


def test_candidates_of_several_families(labelled):
    """Every family is fitted and scored on the same vectors; the best point is chosen, and scores rows it has not seen."""
    detector, test = ML.train_detector(labelled, candidates=ML.candidate_families())
    found = detector.metrics["candidates"]
    assert [c["candidate"] for c in found] == ["LogisticRegressionModel"] * 2 + ["GBTClassificationModel", "MultilayerPerceptronClassificationModel"]
    assert all(c["auc"] > 0.9 for c in found) and sum(c["chosen"] for c in found) == 1
    best = max(found, key=lambda c: (round(c["recall"], 12), round(c["f1"], 12), -round(c["fpr"], 12)))
    assert next(c for c in found if c["chosen"])["recall"] == best["recall"]
    assert M.roc_auc(test).first().auc > 0.9 and test.count() == 30


def test_forest(labelled):
    detector, test, table = ML.rf_baseline(labelled, trees=5, depth=4)
    assert test.count() == 40 and M.roc_auc(test).first().auc > 0.9
    assert ML.top_importances(table).count() == 10 and table.count() == 48


def test_forest_scores_alike_after_saving(spark, labelled, tmp_path):
    detector, test, _ = ML.rf_baseline(labelled, trees=5, depth=4)
    want = {r.sample_id: r.score for r in test.collect()}

    def scores(d):
        return {r.sample_id: r.score for r in ML.score(ML.as_vectors(ML.apply_saved(labelled, d)), d.model).collect() if r.sample_id in want}

    save_model(detector.model, detector.operating_point(), str(tmp_path / "forest"))
    again = ML.detector_from(*load_model(spark, str(tmp_path / "forest")))
    for d in (detector, again):
        got = scores(d)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert again.threshold == detector.threshold


@pytest.fixture(scope="module")
def many(spark):
    """More rows than one fit of the forest takes at once."""
    rnd = random.Random(3)
    data = [(f"s{i:05d}", i % 2, rnd.gauss(i % 2, 1), rnd.gauss(0, 1), rnd.gauss(i % 2, 2)) for i in range(6400)]
    return spark.createDataFrame(data, "sample_id string, label int, a double, b double, c double").cache()


def test_large_forest_does_not_depend_on_the_layout(many):
    """Many partitions don't multiply the work of a fit, and the same rows give the same scores however they are dealt."""
    found = []
    for df in (many.coalesce(1), many.repartition(7)):
        detector, test, _ = ML.rf_baseline(df, ["a", "b", "c"], trees=12, depth=3)
        found.append((detector.threshold, {r.sample_id: r.score for r in test.collect()}))
        assert [f.getNumTrees for f in detector.model.stages if hasattr(f, "getNumTrees")] == [5, 5, 2]
        assert test.count() == 1280 and M.roc_auc(test).first().auc > 0.7
    (t, x), (u, y) = found
    assert t == u and x == y


def test_large_forest_is_the_mean_of_its_trees(spark, many, tmp_path, monkeypatch):
    monkeypatch.setattr(ML, "NODES_PER_STAGE", 60)  # two stages of forests
    detector, test, table = ML.rf_baseline(many, ["a", "b", "c"], trees=12, depth=3)
    grown = [t for f in detector.model.stages if hasattr(f, "getNumTrees") for t in f.trees]
    assert len(grown) == 12 and sum(type(s) is ML.Votes for s in detector.model.stages) == 2
    for i, r in enumerate(sorted(table.collect(), key=lambda r: r.feature)):
        assert r.importance == pytest.approx(sum(t.featureImportances[i] for t in grown) / 12)
    want = {r.sample_id: r.score for r in test.collect()}
    vectors = ML.as_vectors(many, ["a", "b", "c"])
    rows = detector.model.stages[0].transform(vectors).select("sample_id", "scaled").limit(400).collect()
    seen = [r for r in rows if r.sample_id in want][:3]
    assert seen
    for r in seen:
        assert want[r.sample_id] == pytest.approx(sum(t.predictProbability(r.scaled)[1] for t in grown) / 12)
    save_model(detector.model, detector.operating_point(), str(tmp_path / "large"))
    again = ML.detector_from(*load_model(spark, str(tmp_path / "large")))
    got = {r.sample_id: r.score for r in ML.score(vectors, again.model).collect() if r.sample_id in want}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ablation(labelled):
    df = ML.ablation(labelled, labelled, {"baseline": (), "drop": ("orig_bytes",)}, candidates=fast(), budget=0.05)
    got = {(r.variant, r.dataset): r for r in df.collect()}
    assert len(got) == 4 and got["baseline", "internal"].delta_f1 == 0.0


def test_user_model(labelled):
    df = ML.score_with(labelled, lambda f: f["n_flows"] / 10.0)
    assert df.columns == ["sample_id", "label", "score"] and {r.score for r in df.collect()} == {0.6}
