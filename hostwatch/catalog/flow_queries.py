"""Flow-level queries: cleaning, features, labels, windows over flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostwatch.catalog import frames as fr, query, sql
from hostwatch.catalog.frames import tidy
from hostwatch.catalog.sql import rounded
from hostwatch.config import C2_LABELS_V2, C2_PATH_WORDS, BENIGN_PATH_WORDS, FAMILY_KEYWORDS, FEATURES, NON_C2_ATTACKS
from hostwatch.functions import labels as L, scalars as S
from hostwatch.operators import flows as FL, transforms as TR
from hostwatch.sources import tables as T

CELLS = """cells AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '-'
    WHEN event_id % 13 = 0 THEN '0x' || lower(printf('%X', CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER)))
    ELSE CAST(value AS VARCHAR) END AS cell, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)"""


@query("p02_null_marker", f"WITH {CELLS} SELECT event_id, CASE WHEN cell = '-' THEN NULL ELSE cell END AS cell FROM cells")
def p02(spark, sf):
    cell = F.col("cell")
    return T.text_from_events(spark, sf).select("event_id", F.when(cell != "-", cell).alias("cell"))


@query("p03_numeric_coercion", f"WITH {CELLS} SELECT event_id, coalesce(CASE WHEN cell LIKE '0x%' THEN NULL ELSE "
                               "try_cast(cell AS DOUBLE) END, 0) AS number, coalesce(CASE WHEN cell LIKE '0x%' THEN NULL ELSE "
                               "try_cast(cell AS DOUBLE) END, 1) AS packets FROM cells")
def p03(spark, sf):
    return T.text_from_events(spark, sf).select("event_id", S.to_number("cell").alias("number"), S.to_number("cell", 1.0).alias("packets"))


@query("p04_mixed_encoding", f"WITH {CELLS} SELECT event_id, CASE WHEN cell LIKE '0x%' THEN CAST(k AS DOUBLE) ELSE "
                             "coalesce(try_cast(cell AS DOUBLE), 0) END AS number FROM cells")
def p04(spark, sf):
    return T.text_from_events(spark, sf).select("event_id", S.to_number_mixed("cell").alias("number"))


@query("p05_nonnegative", f"WITH {sql.RAW} SELECT flow_id, greatest(orig_bytes - 50, 0) AS orig_bytes, "
                          "greatest(resp_pkts - 2, 0) AS resp_pkts, greatest(orig_pkts - 3, 1) AS orig_pkts FROM raw "
                          "WHERE greatest(orig_pkts - 3, 1) + greatest(resp_pkts - 2, 0) > 0")
def p05(spark, sf):
    shifted = fr.raw(spark, sf).withColumns({"orig_bytes": F.col("orig_bytes") - 50, "resp_pkts": F.col("resp_pkts") - 2,
                                             "orig_pkts": F.col("orig_pkts") - 3})
    return FL.clean_flows(shifted, pkt_floor=1.0).select("flow_id", "orig_bytes", "resp_pkts", "orig_pkts")


@query("p06_drop_empty_flows", f"WITH {sql.RAW} SELECT flow_id, orig_pkts - 1 AS orig_pkts, resp_pkts FROM raw "
                               "WHERE orig_pkts - 1 + resp_pkts > 0")
def p06(spark, sf):
    less = fr.raw(spark, sf).withColumn("orig_pkts", F.col("orig_pkts") - 1)
    return FL.clean_flows(less).select("flow_id", "orig_pkts", "resp_pkts")


@query("p08_parse_time", "SELECT event_id, CAST(floor(epoch_us(ts) / 1e6) AS DOUBLE) AS ts FROM events")
def p08(spark, sf):
    e = T.table(spark, sf, "events")
    return e.select("event_id", FL.parse_time(F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS")).alias("ts"))


@query("p09_infer_bytes", "SELECT event_id, greatest(100 - value, 0) AS resp_bytes FROM events")
def p09(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", F.col("value").alias("orig_bytes"), F.lit(100).alias("tot_bytes"))
    return FL.infer_from_totals(e).select("event_id", "resp_bytes")


@query("p10_split_packets", "SELECT l_orderkey, l_linenumber, l_quantity, ceil(l_quantity / 2) AS orig_pkts, "
                            "floor(l_quantity / 2) AS resp_pkts FROM lineitem")
def p10(spark, sf):
    line = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_quantity").alias("tot_pkts"))
    return FL.infer_from_totals(line).select("l_orderkey", "l_linenumber", "l_quantity", "orig_pkts", "resp_pkts")


@query("p11_bytes_per_pkt", f"WITH {sql.RAW}, {sql.RATIOS} SELECT flow_id, round(bytes_per_pkt, 6) AS bytes_per_pkt FROM ratios")
def p11(spark, sf):
    return tidy(FL.derive_ratios(fr.raw(spark, sf)).select("flow_id", "bytes_per_pkt"))


@query("p12_packet_ratio", f"WITH {sql.RAW}, {sql.RATIOS} SELECT flow_id, round(least(packet_ratio, 1e9), 6) AS packet_ratio FROM ratios")
def p12(spark, sf):
    ratio = F.least(F.col("packet_ratio"), F.lit(1e9))
    return tidy(FL.derive_ratios(fr.raw(spark, sf)).select("flow_id", ratio.alias("packet_ratio")))


@query("p13_byte_ratio", f"WITH {sql.RAW}, {sql.RATIOS} SELECT flow_id, round(least(byte_ratio, 1e9), 6) AS byte_ratio FROM ratios")
def p13(spark, sf):
    ratio = F.least(F.col("byte_ratio"), F.lit(1e9))
    return tidy(FL.derive_ratios(fr.raw(spark, sf)).select("flow_id", ratio.alias("byte_ratio")))


# Addresses over the whole number range, spread from the order keys.
ADDRESSES = """ips AS (SELECT o_orderkey, CAST((o_orderkey * 7919) % 256 AS VARCHAR) || '.' || CAST((o_orderkey * 31) % 256 AS VARCHAR)
    || '.' || CAST((o_orderkey * 17) % 256 AS VARCHAR) || '.' || CAST(o_orderkey % 256 AS VARCHAR) AS ip FROM orders)"""


@query("p14_private_ip", f"WITH {ADDRESSES} SELECT o_orderkey, ip, {sql.private('ip')} AS is_private FROM ips")
def p14(spark, sf):
    k = F.col("o_orderkey")
    ip = F.concat_ws(".", *[x.cast("string") for x in ((k * 7919) % 256, (k * 31) % 256, (k * 17) % 256, k % 256)])
    return FL.flag_private(T.table(spark, sf, "orders").select("o_orderkey", ip.alias("ip")), is_private="ip")


@query("p15_outbound", f"WITH {sql.RAW} SELECT flow_id, CAST(CASE WHEN {sql.private('src_ip')} = 1 AND {sql.private('dst_ip')} = 0 "
                       "THEN 1 ELSE 0 END AS DOUBLE) AS is_outbound FROM raw")
def p15(spark, sf):
    return FL.with_direction(fr.raw(spark, sf)).select("flow_id", "is_outbound")


@query("p16_clip_features", f"WITH {sql.FLOWS} SELECT flow_id, round(least(bytes_per_pkt, 65535), 6) AS bytes_per_pkt, "
                            "round(least(packet_ratio, 1000), 6) AS packet_ratio, round(least(byte_ratio, 1000), 6) AS byte_ratio, "
                            "round(least(duration, 3600), 6) AS duration, least(greatest(src_port, 0), 65535) AS src_port, "
                            "round(least(greatest(iat, 0), 3600), 6) AS iat FROM flows")
def p16(spark, sf):
    m = FL.feature_matrix(fr.flows(spark, sf), keep=("flow_id",))
    return tidy(m.select("flow_id", "bytes_per_pkt", "packet_ratio", "byte_ratio", "duration", "src_port", "iat"))


@query("p17_finite", "SELECT event_id, CASE WHEN value > 100 THEN CAST(0 AS DOUBLE) ELSE value END AS number FROM events")
def p17(spark, sf):
    broken = F.when(F.col("value") > 200, F.lit(float("inf"))).when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value"))
    return T.table(spark, sf, "events").select("event_id", S.finite(broken).alias("number"))


@query("p18_feature_matrix", f"WITH {sql.FLOWS} SELECT flow_id, ts, src_ip, dst_ip, proto, " + ", ".join(
    f"round(least({f}, 1e6), 6) AS {f}" for f in FEATURES) + " FROM flows")
def p18(spark, sf):
    m = FL.feature_matrix(fr.flows(spark, sf), clip=False, keep=("flow_id",) + FL.ENDPOINTS)
    return m.select("flow_id", *FL.ENDPOINTS, *[F.round(F.least(F.col(f), F.lit(1e6)), 6).alias(f) for f in FEATURES])


@query("p24_normalise_endpoints", "SELECT page_id, lower(trim(split_part(url, ':', 1))) AS proto, url AS src_ip FROM pages "
                                  "WHERE url IS NOT NULL")
def p24(spark, sf):
    p = T.table(spark, sf, "pages").select("page_id", F.lit(0.0).alias("ts"), F.concat(F.lit(" "), F.col("url")).alias("SrcAddr"),
                                           F.col("url").alias("DstAddr"), F.upper(F.split_part("url", F.lit(":"), F.lit(1))).alias("Proto"))
    return FL.standardize_flows(p).select("page_id", "proto", "src_ip")


# --- labels ----------------------------------------------------------------------------------------

def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


WORDS = ("Cobalt_Strike", "sliver-c2", "normal", "benign", "Neris", "T1071", "t1573.002", "bot-ddos", "uwf", "ctu13", "mcfp", "beacon",
         "brute-ratel", "rbot", "recon", "web attack", "clean", "HAVOC", "meterpreter", "other")
PATHS = "paths AS (SELECT page_id, url || '/' || CASE page_id % 20 " + " ".join(
    f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END || '/conn.log' AS path FROM pages)"


def paths(spark, sf):
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("page_id") % 20 + 1).cast("int"))
    return T.table(spark, sf, "pages").select("page_id", F.concat("url", F.lit("/"), word, F.lit("/conn.log")).alias("path"))


@query("p19_label_from_text", f"WITH {PATHS} SELECT page_id, CAST({_any('lower(trim(path))', C2_LABELS_V2)} AS INTEGER) AS label, "
                              f"CAST({_any('lower(trim(path))', C2_LABELS_V2)} AND NOT {_any('lower(trim(path))', NON_C2_ATTACKS)} "
                              "AS INTEGER) AS strict_label FROM paths")
def p19(spark, sf):
    return paths(spark, sf).select("page_id", L.label_from_text("path").alias("label"),
                                   L.label_from_text("path", exclude_non_c2=True).alias("strict_label"))


@query("p20_label_from_path", f"WITH {PATHS} SELECT page_id, CASE WHEN {_any('lower(path)', C2_PATH_WORDS)} THEN 'c2' "
                              f"WHEN {_any('lower(path)', BENIGN_PATH_WORDS)} THEN 'benign' ELSE 'unknown' END AS path_class, "
                              f"CAST({_any('lower(path)', C2_PATH_WORDS)} AS INTEGER) AS label FROM paths")
def p20(spark, sf):
    return paths(spark, sf).select("page_id", L.path_class("path").alias("path_class"), L.label_from_path("path").alias("label"))


@query("p21_family_patterns", f"""WITH {PATHS} SELECT page_id, CASE
  WHEN regexp_matches(path, 'cobalt[_-]?strike', 'i') THEN 'cobalt_strike' WHEN regexp_matches(path, 'brute[_-]?ratel', 'i') THEN 'brute_ratel'
  WHEN regexp_matches(path, 'meterpreter', 'i') THEN 'metasploit' WHEN regexp_matches(path, 'sliver', 'i') THEN 'sliver'
  WHEN regexp_matches(path, 'havoc', 'i') THEN 'havoc' WHEN regexp_matches(path, 'neris', 'i') THEN 'neris'
  WHEN regexp_matches(path, 'rbot', 'i') THEN 'rbot'
  WHEN regexp_matches(path, 't1[0-9][0-9][0-9]', 'i') THEN 'mitre_' || regexp_extract(lower(path), '(t1[0-9][0-9][0-9])', 1)
  WHEN regexp_matches(path, 'ctu13', 'i') THEN 'ctu13_mixed' WHEN regexp_matches(path, 'uwf', 'i') THEN 'uwf_mixed'
  WHEN regexp_matches(path, 'mcfp', 'i') THEN 'mcfp_mixed' ELSE 'unknown' END AS family FROM paths""")
def p21(spark, sf):
    return paths(spark, sf).select("page_id", L.family_from_path("path").alias("family"))


@query("p22_family_keywords", f"WITH {PATHS} SELECT page_id, CASE " + " ".join(
    f"WHEN contains(lower(path), '{w}') THEN '{f}'" for w, f in FAMILY_KEYWORDS) + " WHEN regexp_matches(lower(path), "
    "'t[0-9][0-9][0-9][0-9]') THEN 'mitre_' || regexp_extract(lower(path), '(t[0-9][0-9][0-9][0-9])', 1) ELSE 'unknown_c2' END AS family FROM paths")
def p22(spark, sf):
    return paths(spark, sf).select("page_id", L.family_from_path("path", style="keyword").alias("family"))


@query("p23_capture_id", f"WITH {PATHS} SELECT page_id, regexp_replace(regexp_replace(path, '^[a-z]+://', ''), '/[^/]*$', '') AS capture_id FROM paths")
def p23(spark, sf):
    return paths(spark, sf).select("page_id", L.capture_id("path", "/").alias("capture_id"))


# --- row transforms ---------------------------------------------------------------------------------

@query("p28_signed_log", f"WITH {sql.RAW}, {sql.RATIOS} SELECT flow_id, " + ", ".join(
    f"round(sign({f}) * ln(1 + abs({f})), 6) AS {f}" for f in ("orig_bytes", "resp_bytes", "bytes_per_pkt", "duration")) +
    ", orig_pkts FROM ratios")
def p28(spark, sf):
    d = TR.transform_columns(fr.ratios(spark, sf))
    return tidy(d.select("flow_id", "orig_bytes", "resp_bytes", "bytes_per_pkt", "duration", "orig_pkts"))


@query("p29_ablation", f"WITH {sql.RAW}, {sql.RATIOS} SELECT flow_id, CAST(0 AS DOUBLE) AS src_port, CAST(0 AS DOUBLE) AS dst_port, "
                       "CAST(0 AS DOUBLE) AS is_outbound, orig_bytes FROM ratios")
def p29(spark, sf):
    cfg = TR.TransformConfig(log_scale=(), ablate=TR.parse_features("src_port, dst_port,is_outbound"))
    return TR.transform_columns(fr.ratios(spark, sf), cfg).select("flow_id", "src_port", "dst_port", "is_outbound", "orig_bytes")


@query("p31_hour_utc", "SELECT event_id, CAST(date_part('hour', ts) AS INTEGER) AS hour FROM events")
def p31(spark, sf):
    e = T.table(spark, sf, "events")
    return e.select("event_id", S.hour_utc(S.epoch_seconds("ts", e.schema["ts"].dataType)).alias("hour"))


@query("p34_focal_loss", f"""WITH {sql.SCORES}, z AS (SELECT label, CAST(score * 10 - 3 AS DOUBLE) AS z FROM scored),
  p AS (SELECT *, 1 / (1 + exp(-z)) AS p, greatest(z, 0) - z * label + ln(1 + exp(-abs(z))) AS bce FROM z)
  SELECT label, round(z, 6) AS logit, round(CASE WHEN label = 1 THEN 0.25 * pow(1 - p, 2) * bce ELSE 0.75 * pow(p, 2) * bce END, 6) AS loss,
    count(*) AS n FROM p GROUP BY ALL""")
def p34(spark, sf):
    z = F.col("score") * 10 - 3
    d = T.scored_from_lineitem(spark, sf).select("label", F.round(z, 6).alias("logit"), F.round(S.focal_loss(z, "label", 0.25, 2.0), 6).alias("loss"))
    return d.groupBy("label", "logit", "loss").agg(F.count(F.lit(1)).alias("n"))


@query("p35_threshold_decision", f"WITH {sql.SCORES} SELECT label, score, CAST(score >= 0.3 AS INTEGER) AS predicted, count(*) AS n "
                                 "FROM scored GROUP BY ALL")
def p35(spark, sf):
    d = T.scored_from_lineitem(spark, sf).select("label", "score", S.predict_at("score", 0.3).alias("predicted"))
    return d.groupBy("label", "score", "predicted").agg(F.count(F.lit(1)).alias("n"))


# --- windows over flows -----------------------------------------------------------------------------

@query("w01_iat", f"WITH {sql.FLOWS} SELECT flow_id, round(iat, 6) AS iat FROM flows")
def w01(spark, sf):
    return tidy(FL.with_inter_arrival(fr.raw(spark, sf)).select("flow_id", "iat"))


@query("w02_iat_delta", f"WITH {sql.FLOWS} SELECT flow_id, round(iat_delta, 6) AS iat_delta FROM flows")
def w02(spark, sf):
    return tidy(FL.with_inter_arrival(fr.raw(spark, sf)).select("flow_id", "iat_delta"))


@query("w03_byte_delta", f"WITH {sql.FLOWS} SELECT flow_id, round(byte_delta, 6) AS byte_delta FROM flows")
def w03(spark, sf):
    return tidy(FL.with_inter_arrival(fr.raw(spark, sf)).select("flow_id", "byte_delta"))


LINES = """lines AS (SELECT md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)))
    AS flow_id, epoch_us(l_shipdate) / 1e6 AS ts, l_suppkey, o_custkey % 16 AS dst, l_extendedprice AS orig_bytes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("w01_iat_with_ties", f"""WITH {LINES} SELECT l_suppkey AS src, dst, flow_id, ts, round(greatest(coalesce(ts - lag(ts) OVER g, 0), 0), 6) AS iat,
  round(coalesce(orig_bytes - lag(orig_bytes) OVER g, 0), 4) AS byte_delta
  FROM lines WINDOW g AS (PARTITION BY l_suppkey, dst ORDER BY ts, flow_id, orig_bytes)""")
def w01_ties(spark, sf):
    d = FL.with_inter_arrival(T.flows_from_lineitem(spark, sf), order=("ts", "flow_id", "orig_bytes"))
    octets = F.split("src_ip", r"\.")
    src = octets[2].cast("bigint") * 256 + octets[3].cast("bigint")
    return d.select(src.alias("src"), F.split("dst_ip", r"\.")[3].cast("bigint").alias("dst"), "flow_id", "ts", F.round("iat", 6).alias("iat"),
                    F.round("byte_delta", 4).alias("byte_delta"))
