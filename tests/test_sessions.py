import math

import pytest
from pyspark.sql import functions as F

from hostwatch.config import FEATURES, SkewConfig
from hostwatch.operators import behaviour as B, sessions as SS, transforms as TR

FLOW = "flow_id bigint, ts double, src_ip string, dst_ip string, proto string, label int"


def flows(spark, times, key=("a", "b", "tcp"), label=0):
    return spark.createDataFrame([(i, float(t), *key, label) for i, t in enumerate(times)], FLOW)


def test_boundary_gaps(spark):
    df = SS.sessionize(flows(spark, [0, 299, 599, 900, 900]), numbered=True).orderBy("flow_id")
    assert [r.session_no for r in df.collect()] == [1, 1, 1, 2, 2]
    assert [r.start_flow_id for r in df.collect()] == [0, 0, 0, 3, 3]


def test_incomplete_keys_are_dropped(spark):
    df = flows(spark, [0, 1]).unionByName(flows(spark, [5], key=("a", None, "tcp")))
    assert SS.sessionize(df).count() == 2


def test_extra_keys_separate_captures(spark):
    df = flows(spark, [0, 10, 20, 30]).withColumn("capture_id", F.when(F.col("flow_id") % 2 == 0, "x").otherwise("y"))
    assert SS.sessionize(df).select("session_id").distinct().count() == 1
    assert SS.sessionize(df, extra_keys=("capture_id",)).select("session_id").distinct().count() == 2


def test_build_sessions(spark):
    df = flows(spark, range(0, 250, 10)).withColumns({"orig_bytes": F.col("flow_id").cast("double"), "src_port": F.lit("0x1F")})
    df = df.withColumn("label", F.when(F.col("flow_id") < 13, 1).otherwise(0))
    s = SS.build_sessions(df).first()
    assert (s.all_flows, s.n_flows, s.label, s.end_ts) == (25, 20, 1, 240.0)
    assert [x.orig_bytes for x in s.flows] == [float(i) for i in range(5, 25)]
    assert s.flows[0].src_port == 31.0 and s.flows[0].orig_pkts == 1.0 and s.flows[0].iat == 0.0
    assert SS.build_sessions(df, min_flows=26).count() == 0
    tie = df.filter("flow_id < 24 AND flow_id >= 2").withColumn("label", (F.col("flow_id") % 2).cast("int"))
    assert SS.build_sessions(tie).first().label == 0
    with pytest.raises(ValueError):
        SS.build_sessions(df.drop("label"))


def test_summary(spark):
    df = flows(spark, [0, 10, 40]).withColumns({"orig_bytes": F.lit(5.0), "iat": F.col("ts") / 10})
    s = SS.summarize_sessions(df).first()
    assert (s.num_flows, s.start_ts, s.end_ts, s.duration, s.total_orig_bytes, s.total_resp_bytes) == (3, 0.0, 40.0, 40.0, 15.0, 0.0)
    assert s.mean_iat == pytest.approx(5 / 3) and s.cv_iat == pytest.approx(s.std_iat / s.mean_iat)


def stored(spark, sessions):
    """Stored sessions from lists of partial feature dicts."""
    schema = f"session_id string, flows array<{SS.FLOW_TYPE}>"
    data = [(f"s{i}", [tuple(float(x.get(f, 0.0)) for f in FEATURES) for x in xs]) for i, xs in enumerate(sessions)]
    return spark.createDataFrame(data, schema)


def test_padding_and_mask_repair(spark):
    df = stored(spark, [[{"orig_bytes": 1}] * 3, [{"iat": 2}] * 2])
    padded = SS.to_padded(df)
    got = {r.session_id: r for r in padded.collect()}
    assert len(got["s0"].flows) == 20 and got["s0"].mask == [True] * 3 + [False] * 17 and got["s0"].flows[3].orig_bytes == 0.0
    inverted = padded.withColumn("mask", F.transform("mask", lambda m: ~m))
    for version in (padded, inverted, padded.drop("mask")):
        assert {r.session_id: sum(r.mask) for r in SS.repair_mask(version).collect()} == {"s0": 3, "s1": 2}


def test_pooling(spark):
    r = SS.pool_sessions(stored(spark, [[{"orig_bytes": 1}, {"orig_bytes": 3}, {"orig_bytes": 8}]])).first()
    assert (r.orig_bytes_mean, r.orig_bytes_min, r.orig_bytes_max) == (4.0, 1.0, 8.0)
    assert r.orig_bytes_std == pytest.approx(math.sqrt((9 + 1 + 16) / 3))
    assert SS.pooled_names()[:2] == ["orig_bytes_mean", "resp_bytes_mean"] and len(SS.pooled_names()) == 48


def test_host_key_and_sequence_summary(spark):
    flow = {"dst_port": 443, "src_port": 5000, "byte_ratio": 0.257, "packet_ratio": 1.5, "is_outbound": 1, "duration": 2.0, "iat": 3.0}
    df = stored(spark, [[flow, {**flow, "dst_port": 444}], []]).withColumns({"source": F.lit("ctu13"), "capture_id": F.lit("cap")})
    got = {r.session_id: r.host_id for r in SS.with_host_key(df).collect()}
    assert got == {"s0": "ctu13:cap:dp443:sp5000:br25:pr150:o1", "s1": "unknown_cap_ctu13"}
    s = {r.session_id: r for r in SS.summarize_sequences(df.withColumn("start_ts", F.lit(100.0))).collect()}
    assert (s["s0"].num_flows, s["s0"].duration, s["s0"].end_ts, s["s0"].dest_id, s["s0"].protocol) == (2, 4.0, 104.0, "dest_port_443", "tcp")
    assert (s["s1"].num_flows, s["s1"].dest_id, s["s1"].cv_iat) == (0, "dest_port_0", 0.0)


def test_session_deltas(spark):
    r = SS.with_session_deltas(stored(spark, [[{"iat": 1, "orig_bytes": 10}, {"iat": 4, "orig_bytes": 7}]])).first()
    assert [(x.iat_delta, x.byte_delta) for x in r.flows] == [(0.0, 0.0), (3.0, -3.0)]


def test_transforms(spark):
    df = stored(spark, [[{"orig_bytes": 99, "iat": 9, "src_port": 5, "is_outbound": 1}]])
    x = TR.apply_transforms(df).first().flows[0]
    assert x.orig_bytes == pytest.approx(math.log1p(99)) and x.iat == pytest.approx(math.log1p(9)) and x.src_port == 5.0
    x = TR.apply_transforms(df, TR.TransformConfig(ablate=TR.parse_features("src_port, is_outbound"))).first().flows[0]
    assert (x.src_port, x.is_outbound) == (0.0, 0.0)
    assert TR.parse_features(None) == () and TR.parse_features(" a ,b,") == ("a", "b")
    with pytest.raises(ValueError):
        TR.TransformConfig(log_scale=("nope",))


def test_normaliser(spark):
    df = stored(spark, [[{"orig_bytes": 1, "iat": 10}, {"orig_bytes": 3, "iat": 14}], [{"orig_bytes": 5, "iat": 18}]])
    stats = TR.fit_normalizer(df)
    r = stats.first()
    assert (r.orig_bytes_mean, r.iat_mean, r.resp_bytes_std) == (3.0, 14.0, 1.0)
    again = TR.fit_normalizer(TR.apply_normalizer(df, stats)).first()
    assert (again.orig_bytes_mean, again.orig_bytes_std) == (pytest.approx(0.0), pytest.approx(1.0))
    with pytest.raises(ValueError):
        TR.apply_normalizer(df, TR.fit_normalizer(df.limit(0)))


def test_tls_features(spark):
    flow = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "uid string")
    ssl = spark.createDataFrame([("u1", "aa", "TLSv12", "x.org", "f1,f2", "ok"), ("u2", "aa", "TLSv10", None, None, "self signed certificate")],
                                "uid string, ja3 string, version string, server_name string, cert_chain_fuids string, validation_status string")
    got = {r.uid: r for r in B.tls_features(flow, ssl).collect()}
    assert (got["u1"].has_tls, got["u1"].cert_chain_length, got["u1"].sni_present, got["u1"].self_signed_cert) == (1, 2, 1, 0)
    assert (got["u2"].self_signed_cert, got["u2"].sni_present, got["u2"].ja3_hash_rarity) == (1, 0, 0.0)
    assert (got["u3"].has_tls, got["u3"].tls_version_score) == (0, 0.0)


def test_risk_levels(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0, 0.0, 0.0), (0.1, 0.0, 0.0, 0.0, None, 0.0)],
                               "host_anomaly double, behavioral double, persistence double, ml_score double, tls_dns double, beaconing double")
    got = [(round(r.risk_score, 3), r.aligned_signals, r.risk_level) for r in B.risk_score(df).collect()]
    assert got == [(0.85, 4, "high"), (0.55, 2, "medium"), (0.03, 0, "low")]


def test_session_numbers_with_repeated_rows(spark):
    rows = [("a", "b", "tcp", t, f) for t, f in ((1.0, "x"), (1.0, "x"), (2.0, "y"), (900.0, "z"), (900.0, "z"))]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, proto string, ts double, flow_id string")
    for skew in (None, SkewConfig(hot_rows=2)):
        got = SS.sessionize(df, 300.0, numbered=True, skew=skew).orderBy("ts").collect()
        assert [r.session_no for r in got] == [1, 1, 1, 2, 2] and "_cut" not in got[0].asDict()
