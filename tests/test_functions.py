import ipaddress
import math

import pytest
from pyspark.sql import functions as F

from hostwatch.functions import labels as L, scalars as S
from hostwatch.operators import flows as FL


def values(spark, data, schema, expr):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_numbers(spark):
    data = [("12",), ("-",), (None,), ("0x1F",), (" 7 ",), ("",), ("nan",), ("0xzz",)]
    assert values(spark, data, "c string", S.to_number("c")) == [12.0, 0.0, 0.0, 0.0, 7.0, 0.0, 0.0, 0.0]
    assert values(spark, data, "c string", S.to_number_mixed("c", 1.0)) == [12.0, 1.0, 1.0, 31.0, 7.0, 1.0, 1.0, 1.0]


def test_finite(spark):
    data = [(1.5,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)]
    assert values(spark, data, "c double", S.finite("c")) == [1.5, 0.0, 0.0, 0.0, 0.0]


ADDRESSES = """10.0.0.1 127.0.0.1 169.254.1.1 172.16.0.1 172.31.255.255 192.0.0.8 192.0.0.9 192.168.1.1 198.18.0.1 203.0.113.5 240.0.0.1
8.8.8.8 100.64.0.1 172.32.0.1 256.1.1.1 01.2.3.4 ::1 :: ::2 fe80::1 fe80::1%eth0 fc00::1 fe00::1 ::ffff:8.8.8.8 ::ffff:10.0.0.1 ::ffff:808:808
::ffff:a00:1 2001:db8::1 2001:1::1 2001:1::3 2001:3::1 2001:4:112::1 2001:20::1 2001:40::1 2001:200::1 2002::1 100::1 100:0:0:1::1 64:ff9b:1::1
64:ff9b::1 1::2::3 :1::2 12345:: bad""".split()


def test_private_addresses_match_the_standard_library(spark):
    def expected(text):
        try:
            return int(ipaddress.ip_address(text).is_private)
        except ValueError:
            return 0

    df = FL.flag_private(spark.createDataFrame([(a,) for a in ADDRESSES], "ip string"), p="ip")
    assert {r.ip: r.p for r in df.collect()} == {a: expected(a) for a in ADDRESSES}


def test_direction(spark):
    df = spark.createDataFrame([("10.0.0.1", "8.8.8.8"), ("10.0.0.1", "10.0.0.2"), ("8.8.8.8", "10.0.0.1"), ("10.0.0.1", "junk")],
                               "src_ip string, dst_ip string")
    assert [r.is_outbound for r in FL.with_direction(df).collect()] == [1.0, 0.0, 0.0, 1.0]


def test_hour_is_utc_whatever_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert values(spark, [(0.0,), (3600.0 * 25,), (-1.0,), (1e18,)], "t double", S.hour_utc("t")) == [0, 1, 23, 0]
        df = spark.sql("SELECT timestamp_ntz'2024-01-01 05:00:00.5' AS t")
        assert df.select(S.epoch_seconds("t", df.schema["t"].dataType)).first()[0] == 1704085200.5
        assert values(spark, [("2024/01/01 05:00:00.7",)], "t string", FL.parse_time("t")) == [1704085200.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parse_time(spark):
    data = [("1700000000.25",), ("2011/08/10 09:46:53.047277",), ("2011-08-10 09:46:53",), ("bad",)]
    assert values(spark, data, "t string", FL.parse_time("t")) == [1700000000.25, 1312969613.0, 1312969613.0, None]


def test_focal_loss(spark):
    logits, targets = [0.3, -0.7, 1.1, -2.2], [1, 0, 1, 0]

    def reference(z, y, alpha, gamma):
        p = 1 / (1 + math.exp(-z))
        bce = -math.log(p if y else 1 - p)
        return (alpha if y else 1 - alpha) * (1 - (p if y else 1 - p)) ** gamma * bce

    for alpha, gamma in ((0.5, 1.0), (0.25, 3.0), (0.5, 0.0)):
        got = values(spark, list(zip(logits, targets)), "z double, y int", S.focal_loss("z", "y", alpha, gamma))
        assert got == pytest.approx([reference(z, y, alpha, gamma) for z, y in zip(logits, targets)])
    huge = values(spark, [(800.0, 0), (-800.0, 1)], "z double, y int", S.focal_loss("z", "y"))
    assert huge == pytest.approx([400.0, 400.0])
    with pytest.raises(ValueError):
        S.focal_loss("z", "y", alpha=1.5)
    with pytest.raises(ValueError):
        S.focal_loss("z", "y", gamma=-1)


def test_labels(spark):
    data = [("flow=From-Botnet-V42",), (" Background ",), ("bot-ddos",), (None,), ("TA0011",)]
    assert values(spark, data, "t string", L.label_from_text("t")) == [1, 0, 1, 0, 1]
    assert values(spark, data, "t string", L.label_from_text("t", "v1")) == [1, 0, 1, 0, 0]
    assert values(spark, data, "t string", L.label_from_text("t", exclude_non_c2=True)) == [1, 0, 0, 0, 1]


@pytest.mark.parametrize("path, family", [
    ("data/cobalt_strike/x.npz", "cobalt_strike"), ("data/Cobalt-Strike.npz", "cobalt_strike"), ("brute-ratel", "brute_ratel"),
    ("meterpreter_run", "metasploit"), ("SLIVER_c2", "sliver"), ("a/T1071/x", "mitre_t1071"), ("ctu13_scenario", "ctu13_mixed"),
    ("uwf_c2", "uwf_mixed"), ("mcfp", "mcfp_mixed"), ("random", "unknown"), ("uwf_sliver", "sliver")])
def test_family_from_path(spark, path, family):
    assert values(spark, [(path,)], "p string", L.family_from_path("p")) == [family]


def test_family_keywords_and_paths(spark):
    data = [("x/cobalt/conn.log",), ("x/T9999/conn.log",), ("x/y",)]
    assert values(spark, data, "p string", L.family_from_path("p", "keyword")) == ["cobalt_strike", "mitre_t9999", "unknown_c2"]
    paths = [("TA0011/T1071/conn.log",), ("benign/conn.log",), ("misc/conn.log",)]
    assert values(spark, paths, "p string", L.path_class("p")) == ["c2", "benign", "unknown"]
    full = [("file:///data/root/a/b/conn.log",), ("file:/data/root/conn.log",)]
    assert values(spark, full, "p string", L.capture_id("p", "/data/root")) == ["a/b", "root"]


def test_split_key(spark):
    data = [("sliver", "ctu13"), ("", "ctu13"), (None, "uwf")]
    assert values(spark, data, "c2_family string, source string", L.split_key()) == ["sliver", "benign_ctu13", "benign_uwf"]


def test_totals(spark):
    df = spark.createDataFrame([("10", "100", "5"), ("200", "100", "4")], "orig_bytes string, tot_bytes string, tot_pkts string")
    got = [tuple(r) for r in FL.infer_from_totals(df).select("resp_bytes", "orig_pkts", "resp_pkts").collect()]
    assert got == [(90.0, 3.0, 2.0), (0.0, 2.0, 2.0)]


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="dst_ip"):
        FL.standardize_flows(spark.createDataFrame([("1", "a", "tcp")], "ts string, src_ip string, proto string"))
