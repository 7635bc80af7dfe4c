import math
import warnings

import pytest
from pyspark.sql import functions as F

from hostwatch.config import SkewConfig
from hostwatch.functions.scalars import hash_order
from hostwatch.operators import dedup as DD, sampling as SA, splits as SP

FAMILIES = ("sliver", "havoc", "neris", "emotet")


@pytest.fixture(scope="module")
def samples(spark):
    i = F.col("id")
    c2 = i >= 500
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (i % 4 + 1).cast("int"))
    return spark.range(700).select(
        i.alias("sample_id"), c2.cast("int").alias("label"), F.when(c2, family).otherwise("").alias("c2_family"),
        F.element_at(F.array(F.lit("ctu13"), F.lit("uwf"), F.lit("lab")), (i % 3 + 1).cast("int")).alias("source"),
        F.floor(i / 10).cast("double").alias("start_ts"), (i % 5).cast("string").alias("host_id")).cache()


def by_split(df, column="sample_id", where="true"):
    out = {"train": set(), "val": set(), "test": set()}
    for r in df.filter(where).select("split", column).collect():
        out[r["split"]].add(r[column])
    return out


@pytest.mark.parametrize("strategy", SP.STRATEGIES)
def test_every_strategy_is_a_partition(samples, strategy):
    df = SP.split_sessions(samples, strategy)
    assert df.count() == 700 and df.select("sample_id").distinct().count() == 700
    assert {r.what: r.train_test for r in SP.leakage(df).collect()}["id"] == 0
    assert all(by_split(df).values())


def test_stratified_sizes(samples):
    got = {(r.split, r.label): r["count"] for r in SP.random_stratified(samples).groupBy("split", "label").count().collect()}
    assert got == {("test", 0): 75, ("test", 1): 30, ("val", 0): 75, ("val", 1): 30, ("train", 0): 350, ("train", 1): 140}


def test_families_stay_together(samples):
    for df in (SP.family_separated(samples), SP.zero_shot(samples), SP.family_separated(samples, held_out_families={"neris", "x"})):
        fams = by_split(df, "c2_family", "label = 1")
        assert not fams["train"] & fams["test"] and fams["test"]
    assert fams["test"] == {"neris"}
    sizes = by_split(df, "sample_id", "label = 0")
    assert len(sizes["test"]) == 75


def test_sources_stay_together(spark, samples):
    got = by_split(SP.source_separated(samples), "source")
    assert not got["train"] & got["test"] and len(got["test"]) == 1
    with pytest.warns(UserWarning):
        one = SP.source_separated(samples.withColumn("source", F.lit("lab")))
    assert one.filter("split = 'test'").count() == math.ceil(0.15 * 700)


def test_zero_shot_sources_are_unseen(samples):
    df = SP.zero_shot(samples, zero_shot_sources={"lab"})
    assert df.filter("source = 'lab' AND split <> 'test'").count() == 0 and df.count() == 700


def test_time_order(samples):
    df = SP.time_separated(samples)
    sizes = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    # 700 * 0.70 falls just below 490 in floating point, so the cut is at 489.
    assert sizes == {"train": 415, "val": 74, "test": 211}
    last = {r.split: (r.lo, r.hi) for r in df.groupBy("split").agg(F.min("start_ts").alias("lo"), F.max("start_ts").alias("hi")).collect()}
    assert last["train"][1] <= last["val"][0] and last["val"][1] <= last["test"][0]


def test_fallback_and_errors(samples):
    with pytest.warns(UserWarning):
        SP.split_sessions(samples.select("sample_id", "label"), "family_separated")
    with pytest.raises(ValueError):
        SP.split_sessions(samples.limit(0))
    with pytest.raises(ValueError):
        SP.split_sessions(samples, "nope")
    with pytest.raises(ValueError):
        SP.random_stratified(samples.filter("sample_id <= 500"))


def test_one_class_split(samples):
    df = SP.family_separated(samples.filter("label = 0"))
    assert {r.split: r["count"] for r in df.groupBy("split").count().collect()} == {"test": 75, "train": 361, "val": 64}


def test_summary(samples):
    r = SP.split_summary(SP.family_separated(samples), "family_separated").first()
    assert r.total_samples == 700 and r.train_size + r.val_size + r.test_size == 700
    assert r.family_overlap_train_test == [] and set(r.train_families) | set(r.test_families) == set(FAMILIES)
    assert {r.split: r.total for r in SP.split_report(SP.family_separated(samples)).collect()}["test"] == r.test_size
    assert all(x.unique_hosts <= 5 for x in SP.host_diversity(SP.family_separated(samples)).collect())


def test_nth_hashes_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(SA, "SMALL", 4)
    monkeypatch.setattr(SA, "DIGITS", 1)
    df = spark.range(2000).select(F.col("id").alias("sample_id"))
    hashes = sorted(r[0] for r in df.select(hash_order("sample_id")).collect())
    got = SA.nth_hashes(df, F.lit("g"), {"g": [0, 1, 77, 1999, 2000]}, {"g": 2000})["g"]
    assert got == [SA.NOTHING, hashes[0], hashes[76], hashes[1998], SA.EVERYTHING]


def test_exact_sizes_with_repeated_ids(spark, monkeypatch):
    ids = spark.range(300).selectExpr("CASE WHEN id < 200 THEN 7 ELSE id END AS sample_id", "id % 3 AS x", "0 AS label")
    for small in (10_000, 4):  # 4: the copies of one id are more than are ever listed
        monkeypatch.setattr(SA, "SMALL", small)
        for n in (0, 1, 50, 149, 250, 300):
            kept = SA.keep_benign(ids, n, 300)
            assert kept.count() == n and kept.columns == ids.columns
    rows = ids.withColumn("label", (F.col("sample_id") % 5 == 0).cast("int")).withColumn("start_ts", F.lit(3.0))
    for split in (SP.random_stratified(rows), SP.time_separated(rows)):
        got = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
        assert sum(got.values()) == 300 and split.columns == [*rows.columns, "split"]
    assert got == {"train": int(210 * 0.85) if "val" in got else 210, **({"val": 210 - int(210 * 0.85)} if "val" in got else {}), "test": 90}


def test_many_families_and_sources(spark):
    rows = spark.range(24_000).selectExpr("id AS sample_id", "cast(id % 2 AS int) AS label", "concat('f', id % 11000) AS c2_family", "concat('s', id % 12000) AS source", "cast(id AS double) AS start_ts")
    for split, key in ((SP.family_separated(rows), "c2_family"), (SP.source_separated(rows), "source")):
        test, rest = (split.filter(c).filter("label = 1").select(key).distinct() for c in ("split = 'test'", "split != 'test'"))
        assert test.count() > 500 and test.join(rest, key).count() == 0


def test_sampling(samples):
    c2, benign = samples.filter("label = 1"), samples.filter("label = 0")
    assert SA.mix(c2.limit(30), benign, 0.15).count() == 200
    assert SA.mix(c2, benign, 0.15).count() == 700
    for args in ((c2, benign, 1.0), (benign, c2, 0.15)):
        with pytest.raises(ValueError):
            SA.mix(*args)
    assert SA.rebalance(samples, 0.5).groupBy("label").count().count() == 2 and SA.rebalance(samples, 0.5).count() == 400
    assert SA.rebalance(samples, 0.001).count() == 700
    assert SA.undersample(samples, 2.0).count() == 600 and SA.undersample(samples).count() == 700
    assert SA.enrich_benign(c2, benign, 17).count() == 217
    assert SA.undersample(samples, 2.0).select("sample_id").exceptAll(SA.undersample(samples.repartition(7), 2.0).select("sample_id")).count() == 0


def test_content_overlap(spark):
    a = spark.createDataFrame([(i, "hot" if i < 60 else f"t{i}") for i in range(100)], "id int, content string")
    b = spark.createDataFrame([("t70",), ("t71",), ("t71",), ("zz",)], "content string")
    r = DD.overlap(a, b).first()
    assert (r.candidates, r.shared) == (100, 2)
    for skew in (SkewConfig(), SkewConfig(hot_rows=10)):
        assert sorted(x.id for x in DD.unseen(a, b, skew=skew).collect()) == [i for i in range(100) if i not in (70, 71)]
    hot = b.union(spark.createDataFrame([("hot",)], "content string"))
    assert DD.unseen(a, hot, skew=SkewConfig(hot_rows=10)).count() == 38
