import math

import pytest
from pyspark.sql import functions as F

from hostwatch.config import TimelineConfig
from hostwatch.operators import timeline as TL
from hostwatch.plans import ingest
from hostwatch.sources import datasets as DS

SUMMARY = ("session_id string, host_id string, dest_id string, protocol string, start_ts double, end_ts double, duration double, num_flows bigint, label int, "
           "total_orig_bytes double, total_resp_bytes double, total_orig_pkts double, total_resp_pkts double, mean_iat double, std_iat double, cv_iat double, "
           "mean_bytes_per_pkt double, mean_packet_ratio double, mean_byte_ratio double")


def summaries(spark, n, host="h", step=300.0, dest=lambda i: "d", volume=lambda i: 1000.0):
    data = [(f"{host}{i:04d}", host, dest(i), "tcp", 1e9 + i * step, 1e9 + i * step + 100, 100.0, 5, 0, volume(i), 500.0, 5.0, 3.0, 10.0, 2.0, 0.2, 100.0, 1.0, 2.0)
            for i in range(n)]
    return spark.createDataFrame(data, SUMMARY)


def test_deviations_need_a_baseline(spark):
    df = TL.build_host_sessions(summaries(spark, 15)).orderBy("n")
    got = [r.byte_volume_zscore for r in df.collect()]
    assert got[:10] == [None] * 10 and got[10:] == [0.0] * 5


def test_outlier_is_an_alert(spark):
    df = TL.build_host_sessions(summaries(spark, 60, volume=lambda i: 1e6 if i == 59 else 1000.0 + i % 7))
    hit = TL.alerts(df).collect()
    assert [r.n for r in hit] == [60] and hit[0].byte_volume_zscore > 3


def test_new_destination_flag(spark):
    s = summaries(spark, 4, dest=lambda i: "other" if i == 3 else "d")
    df = TL.build_host_sessions(s, TimelineConfig(min_sessions=2)).orderBy("n")
    assert [r.is_new_destination for r in df.collect()] == [None, None, 0.0, 1.0]


def test_partners_and_profile(spark):
    tl = TL.build_timelines(summaries(spark, 5))
    p = tl.host_partners.first()
    assert (p.total_sessions, p.mean_session_iat, p.session_regularity, p.relationship_duration) == (5, 200.0, 0.0, 1300.0)
    r = tl.host_profile.first()
    assert (r.num_sessions, r.unique_destinations, r.active_duration, sum(r.hourly), r.has_baseline) == (5, 1, 1300.0, 5.0, False)
    top = TL.host_profiles(tl).first().top_partners
    assert [(t["dest"], t["sessions"]) for t in top] == [("d", 5)]


def test_host_features(spark):
    tl = TL.build_timelines(summaries(spark, 12, step=600.0, dest=lambda i: f"d{i % 3}"))
    r = TL.host_features(tl).first()
    assert r.dest_diversity_rolling == 3.0 and r.comm_cadence_cv == pytest.approx(0.0, abs=1e-9)
    assert r.session_freq_avg == pytest.approx(12 / (6700 / 3600)) and r.new_dest_rate == pytest.approx(3 / (6700 / 3600))
    assert r.byte_volume_baseline_mean == pytest.approx(1500.0) and all(math.isfinite(v) for v in r[1:])


def test_history_cap_keeps_the_newest(spark):
    df = TL.number_sessions(summaries(spark, 8))
    r = TL.capped_history(df, cap=3).first()
    assert (r.num_sessions, r.first_seen, r.last_seen) == (3, 1e9 + 5 * 300, 1e9 + 7 * 300 + 100)


def test_summary_and_lookup(spark):
    s = summaries(spark, 12).unionByName(summaries(spark, 3, host="g"))
    tl = TL.build_timelines(s)
    r = TL.timeline_summary(tl).first()
    assert (r.hosts, r.total_sessions, r.sessions_per_host_median, r.sessions_per_host_max, r.hosts_with_baseline) == (2, 15, 7.5, 12, 1)
    assert tl.host("g").host_sessions.count() == 3


def test_round_trip(spark, tmp_path):
    tl = TL.build_timelines(summaries(spark, 12))
    back = DS.write_timelines(tl, str(tmp_path / "tl"))
    assert back.host_sessions.count() == 12
    assert TL.host_features(back).first() == TL.host_features(tl).first()


def test_flows_to_timelines(spark):
    flow = spark.range(50).select(F.col("id").alias("flow_id"), (F.col("id") * 10).cast("double").alias("ts"), F.lit("10.0.0.1").alias("src_ip"),
                                  F.lit("8.8.8.8").alias("dst_ip"), F.lit("tcp").alias("proto"), F.lit(0).alias("label"), F.lit(10.0).alias("orig_bytes"))
    tl = ingest.flows_to_timelines(flow)
    assert tl.host_sessions.count() == 1 and tl.host_sessions.first().byte_volume == 500.0
    with pytest.raises(ValueError):
        ingest.flows_to_timelines(flow.drop("proto"))
