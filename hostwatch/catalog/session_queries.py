"""Session-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostwatch.catalog import frames as fr, query, sql
from hostwatch.catalog.frames import tidy
from hostwatch.catalog.sql import rounded
from hostwatch.config import FEATURES, SESSION_KEY
from hostwatch.functions import scalars as S
from hostwatch.operators import behaviour as B, sessions as SS, transforms as TR
from hostwatch.sources import tables as T

SUMMARY_DOUBLES = ("start_ts end_ts duration total_orig_bytes total_resp_bytes total_orig_pkts total_resp_pkts mean_iat std_iat cv_iat "
                   "mean_bytes_per_pkt")


@query("w04_sessionize", f"WITH {sql.TAGGED} SELECT flow_id, session_id, session_no FROM tagged")
def w04(spark, sf):
    d = SS.sessionize(fr.raw(spark, sf), T.EVENT_TIMEOUT, numbered=True)
    return d.select("flow_id", "session_id", "session_no")


@query("w05_recent_flows", f"WITH {sql.kept()} SELECT flow_id, session_id FROM kept")
def w05(spark, sf):
    d = SS.recent_flows(SS.sessionize(fr.raw(spark, sf), T.EVENT_TIMEOUT), SESSION_KEY)
    return d.select("flow_id", "session_id")


@query("w06_flow_sequence", f"WITH {sql.kept()} SELECT session_id, any_value(n_flows) AS n_flows, "
                            "string_agg(CAST(CAST(orig_bytes * 100 AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS sent FROM kept GROUP BY session_id")
def w06(spark, sf):
    d = fr.sessions(spark, sf)
    sent = F.transform("flows", lambda x: F.round(x["orig_bytes"] * 100).cast("bigint").cast("string"))
    return d.select("session_id", F.col("n_flows").cast("bigint").alias("n_flows"), F.array_join(sent, ",").alias("sent"))


@query("w07_feature_vectors", f"WITH {sql.kept()} SELECT session_id, pos, " + ", ".join(
    f"round(least({f}, 1e6), 6) AS {f}" for f in FEATURES) + " FROM kept")
def w07(spark, sf):
    d = fr.sessions(spark, sf).select("session_id", F.posexplode("flows").alias("p", "x"))
    return d.select("session_id", (F.col("p") + 1).cast("bigint").alias("pos"),
                    *[F.round(F.least(F.col(f"x.{f}"), F.lit(1e6)), 6).alias(f) for f in FEATURES])


@query("w08_session_deltas", f"""WITH {sql.kept()} SELECT session_id, pos,
  round(coalesce(iat - lag(iat) OVER (PARTITION BY session_id ORDER BY pos), 0), 6) AS iat_delta,
  round(coalesce(orig_bytes - lag(orig_bytes) OVER (PARTITION BY session_id ORDER BY pos), 0), 6) AS byte_delta FROM kept""")
def w08(spark, sf):
    d = SS.with_session_deltas(fr.sessions(spark, sf)).select("session_id", F.posexplode("flows").alias("p", "x"))
    return tidy(d.select("session_id", (F.col("p") + 1).cast("bigint").alias("pos"), "x.iat_delta", "x.byte_delta"))


@query("w06_turn_sequence", "SELECT conv_id, count(*) AS turns, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY turn) AS lengths "
                            "FROM conversations GROUP BY conv_id")
def w06_turns(spark, sf):
    c = T.table(spark, sf, "conversations")
    entry = F.struct("turn", F.length("text").cast("string").alias("n"))
    d = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sort_array(F.collect_list(entry)).alias("s"))
    return d.select("conv_id", "turns", F.array_join(F.transform("s", lambda e: e["n"]), ",").alias("lengths"))


@query("p25_min_flows", f"WITH {sql.SUMMARIES} SELECT session_id, num_flows FROM summaries WHERE num_flows >= 3")
def p25(spark, sf):
    return SS.min_flows(fr.summaries(spark, sf), 3, "num_flows").select("session_id", "num_flows")


@query("p26_mask_repair", f"WITH {sql.kept()} SELECT session_id, least(any_value(all_flows), 20) AS real_rows, 20 AS slots FROM kept GROUP BY session_id")
def p26(spark, sf):
    padded = SS.to_padded(fr.sessions(spark, sf).select("session_id", "flows"))
    wrong = padded.withColumn("mask", F.transform("mask", lambda m: ~m))
    d = SS.repair_mask(wrong)
    return d.select("session_id", F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("real_rows"), F.size("mask").alias("slots"))


@query("p27_padding", f"WITH {sql.kept()} SELECT session_id, 20 AS slots, any_value(n_flows) AS real_rows, round(sum(orig_bytes), 6) AS sent, "
                      "round(20 - any_value(n_flows), 6) AS zero_rows FROM kept GROUP BY session_id")
def p27(spark, sf):
    d = SS.to_padded(fr.sessions(spark, sf))
    zero = F.filter("flows", lambda x: x["orig_pkts"] == 0)
    return tidy(d.select("session_id", F.size("flows").alias("slots"), F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("real_rows"),
                         F.aggregate("flows", F.lit(0.0), lambda a, x: a + x["orig_bytes"]).alias("sent"),
                         F.size(zero).cast("bigint").alias("zero_rows")))


@query("p28_signed_log_sessions", f"""WITH {sql.kept()} SELECT session_id, round(sum(sign(iat) * ln(1 + abs(iat))), 6) AS log_iat,
  round(sum(sign(orig_bytes) * ln(1 + abs(orig_bytes))), 6) AS log_bytes, round(sum(orig_pkts), 6) AS packets FROM kept GROUP BY session_id""")
def p28(spark, sf):
    d = TR.real_flows(TR.apply_transforms(fr.sessions(spark, sf)), "session_id")
    return tidy(d.groupBy("session_id").agg(F.sum("iat").alias("log_iat"), F.sum("orig_bytes").alias("log_bytes"), F.sum("orig_pkts").alias("packets")))


@query("p33_session_byte_ratio", f"""WITH {sql.SUMMARIES} SELECT session_id, round(CASE WHEN total_resp_bytes < 1e-9 THEN greatest(total_orig_bytes, 0)
  ELSE total_orig_bytes / total_resp_bytes END, 9) AS byte_ratio_agg FROM summaries""")
def p33(spark, sf):
    return tidy(fr.summaries(spark, sf).select("session_id", S.session_byte_ratio().alias("byte_ratio_agg")), 9)


@query("a01_majority_label", f"WITH {sql.TAGGED} SELECT session_id, CASE WHEN avg(label) > 0.5 THEN 1 ELSE 0 END AS label FROM tagged GROUP BY session_id")
def a01(spark, sf):
    return fr.summaries(spark, sf).select("session_id", "label")


@query("a02_session_summary", f"WITH {sql.SUMMARIES} SELECT session_id, host_id, dest_id, protocol, num_flows, label, {rounded(SUMMARY_DOUBLES)}, "
                              "round(least(mean_packet_ratio, 1e6), 4) AS mean_packet_ratio, round(least(mean_byte_ratio, 1e6), 4) AS mean_byte_ratio FROM summaries")
def a02(spark, sf):
    d = SS.summarize_sessions(T.flows_from_events(spark, sf), timeout=T.EVENT_TIMEOUT)
    return d.select("session_id", "host_id", "dest_id", "protocol", "num_flows", "label",
                    *[F.round(c, 6).alias(c) for c in SUMMARY_DOUBLES.split()],
                    *[F.round(F.least(F.col(c), F.lit(1e6)), 4).alias(c) for c in ("mean_packet_ratio", "mean_byte_ratio")])


@query("a03_sequence_summary", f"""WITH {sql.kept()}, s AS (SELECT session_id, min(start_ts) AS start_ts, count(*) AS num_flows, sum(duration) AS duration,
    sum(orig_bytes) AS total_orig_bytes, sum(resp_pkts) AS total_resp_pkts, avg(iat) AS mean_iat, stddev_pop(iat) AS std_iat,
    'dest_port_' || CAST(CAST(floor(median(dst_port)) AS BIGINT) AS VARCHAR) AS dest_id, 'tcp' AS protocol FROM kept GROUP BY session_id)
  SELECT session_id, num_flows, dest_id, protocol, round(start_ts, 6) AS start_ts, round(start_ts + duration, 6) AS end_ts,
    {rounded('duration total_orig_bytes total_resp_pkts mean_iat std_iat')},
    round(CASE WHEN mean_iat > 1e-9 THEN std_iat / mean_iat ELSE 0 END, 6) AS cv_iat FROM s""")
def a03(spark, sf):
    d = SS.summarize_sequences(fr.sessions(spark, sf))
    return tidy(d.select("session_id", "num_flows", "dest_id", "protocol", "start_ts", "end_ts", "duration", "total_orig_bytes", "total_resp_pkts",
                         "mean_iat", "std_iat", "cv_iat"))


def _digits(name: str) -> int:
    """Enough digits that no mean of at most 20 short decimals ends on a half."""
    return 5 if name.startswith("iat") or name.endswith("_std") else 7 if name.startswith("bytes") else 9


POOLED = [f for f in FEATURES if f not in ("packet_ratio", "byte_ratio")]


@query("a04_pool_sessions", f"WITH {sql.kept()} SELECT session_id, " + ", ".join(
    f"round({fn}({f}), {_digits(f + '_' + stat)}) AS {f}_{stat}" for stat, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")) for f in POOLED)
    + " FROM kept GROUP BY session_id")
def a04(spark, sf):
    d = SS.pool_sessions(fr.sessions(spark, sf))
    return d.select("session_id", *[F.round(n, _digits(n)).alias(n) for n in SS.pooled_names() if not n.startswith(("packet_ratio", "byte_ratio"))])


def _fine(name: str) -> int:
    """As ``_digits``, but so that no ratio, a short fraction less a billionth, ends on a half."""
    return {"packet_ratio_std": 8, "byte_ratio_std": 8, "packet_ratio_mean": 7}.get(name) or _digits(name)


@query("a04_pool_limited", f"WITH {sql.limited()} SELECT session_id, " + ", ".join(
    f"round({fn}({f}), {_fine(f + '_' + stat)}) AS {f}_{stat}" for stat, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")) for f in FEATURES)
    + " FROM limited GROUP BY session_id")
def a04_limited(spark, sf):
    """All 48 columns, over the feature matrix within its limits."""
    d = SS.pool_sessions(fr.limited(spark, sf))
    return d.select("session_id", *[F.round(n, _fine(n)).alias(n) for n in SS.pooled_names()])


@query("a05_class_counts", f"""WITH {sql.SUMMARIES} SELECT dest_id, count(*) AS total, CAST(sum(label) AS BIGINT) AS c2, CAST(count(*) - sum(label) AS BIGINT) AS benign,
  round(100 * CAST(sum(label) AS DOUBLE) / count(*), 6) AS c2_pct, count(DISTINCT host_id) AS unique_hosts FROM summaries GROUP BY dest_id""")
def a05(spark, sf):
    return tidy(SS.class_counts(fr.summaries(spark, sf), by=("dest_id",), host_col="host_id"))


@query("a06_host_key", f"""WITH {sql.kept()}, k AS (SELECT session_id, median(dst_port) AS dp, median(src_port) AS sp, median(least(byte_ratio, 1e6)) AS br,
    median(least(packet_ratio, 1e6)) AS pr, avg(is_outbound) AS o FROM kept GROUP BY session_id)
  SELECT session_id, 'unknown:events:dp' || CAST(CAST(trunc(dp) AS BIGINT) AS VARCHAR) || ':sp' || CAST(CAST(trunc(sp) AS BIGINT) AS VARCHAR)
    || ':br' || CAST(CAST(trunc(br * 100) AS BIGINT) AS VARCHAR) || ':pr' || CAST(CAST(trunc(pr * 100) AS BIGINT) AS VARCHAR)
    || ':o' || CAST(CAST(round_even(o, 0) AS BIGINT) AS VARCHAR) AS host_id FROM k""")
def a06(spark, sf):
    d = TR.map_flows(fr.stored(spark, sf), lambda f, x: F.least(x, F.lit(1e6)) if f in ("byte_ratio", "packet_ratio") else x)
    return SS.with_host_key(d).select("session_id", "host_id")


@query("a17_fit_normalizer", f"WITH {sql.kept()} SELECT count(*) AS n_flows, " + ", ".join(
    f"round(avg(least({f}, 1e6)), 4) AS {f}_mean, round(CASE WHEN stddev_pop(least({f}, 1e6)) < 1e-6 THEN 1 ELSE stddev_pop(least({f}, 1e6)) END, 4) AS {f}_std"
    for f in FEATURES) + " FROM kept")
def a17(spark, sf):
    d = TR.map_flows(fr.sessions(spark, sf), lambda f, x: F.least(x, F.lit(1e6)))
    return tidy(TR.fit_normalizer(d), 4)


@query("a06_host_key_limited", f"""WITH {sql.limited()} SELECT session_id, 'unknown:events:dp' || CAST(CAST(trunc(median(dst_port)) AS BIGINT) AS VARCHAR)
    || ':sp' || CAST(CAST(trunc(median(src_port)) AS BIGINT) AS VARCHAR) || ':br' || CAST(CAST(trunc(median(byte_ratio) * 100) AS BIGINT) AS VARCHAR)
    || ':pr' || CAST(CAST(trunc(median(packet_ratio) * 100) AS BIGINT) AS VARCHAR) || ':o' || CAST(CAST(round_even(avg(is_outbound), 0) AS BIGINT) AS VARCHAR) AS host_id
  FROM limited GROUP BY session_id""")
def a06_limited(spark, sf):
    d = fr.limited(spark, sf).withColumns({"source": F.lit("unknown"), "capture_id": F.lit("events")})
    return SS.with_host_key(d).select("session_id", "host_id")


@query("a17_fit_limited", f"WITH {sql.limited()} SELECT count(*) AS n_flows, " + ", ".join(
    f"round(avg({f}), 4) AS {f}_mean, round(CASE WHEN stddev_pop({f}) < 1e-6 THEN 1 ELSE stddev_pop({f}) END, 4) AS {f}_std" for f in FEATURES) + " FROM limited")
def a17_limited(spark, sf):
    return tidy(TR.fit_normalizer(fr.limited(spark, sf)), 4)


@query("p30_normalise", f"""WITH {sql.kept()}, st AS (SELECT *, ln(1 + iat) AS li, ln(1 + orig_bytes) AS lb FROM kept),
  fit AS (SELECT avg(li) AS im, stddev_pop(li) AS isd, avg(lb) AS bm, stddev_pop(lb) AS bsd, avg(orig_pkts) AS pm, stddev_pop(orig_pkts) AS psd FROM st)
  SELECT session_id, pos, round((li - im) / isd, 6) AS iat, round((lb - bm) / bsd, 6) AS orig_bytes, round((orig_pkts - pm) / psd, 6) AS orig_pkts FROM st, fit""")
def p30(spark, sf):
    d = TR.apply_transforms(fr.sessions(spark, sf))
    d = TR.apply_normalizer(d, TR.fit_normalizer(d)).select("session_id", F.posexplode("flows").alias("p", "x"))
    return tidy(d.select("session_id", (F.col("p") + 1).cast("bigint").alias("pos"), "x.iat", "x.orig_bytes", "x.orig_pkts"))


@query("c05_flows_to_sessions", f"""WITH {sql.kept()} SELECT session_id, src_ip, dst_ip, proto, any_value(all_flows) AS all_flows, any_value(n_flows) AS n_flows,
  round(min(start_ts), 6) AS start_ts, round(max(ts), 6) AS end_ts, round(sum(iat), 6) AS kept_iat FROM kept WHERE all_flows >= 3 GROUP BY ALL""")
def c05(spark, sf):
    d = fr.sessions(spark, sf, min_flows=3)
    iat = F.aggregate("flows", F.lit(0.0), lambda a, x: a + x["iat"]).alias("kept_iat")
    return tidy(d.select("session_id", "src_ip", "dst_ip", "proto", "all_flows", F.col("n_flows").cast("bigint").alias("n_flows"), "start_ts", "end_ts", iat))


# --- behaviour features --------------------------------------------------------------------------------

def _with_id(df):
    return df.withColumn("session_id", SS.session_id())


@query("f01_timing_shape", f"""WITH {sql.TAGGED}, m AS (SELECT session_id, avg(iat) AS mu, stddev_pop(iat) AS sd, quantile_cont(iat, 0.5) AS med FROM tagged GROUP BY session_id),
  c AS (SELECT t.session_id, avg((iat - mu) ** 3) AS m3, avg((iat - mu) ** 4) AS m4 FROM tagged t JOIN m USING (session_id) GROUP BY t.session_id)
  SELECT session_id, round(CASE WHEN mu > 1e-9 THEN sd / mu ELSE 0 END, 5) AS iat_cv, round(CASE WHEN med > 1e-9 THEN sd / med ELSE 0 END, 5) AS iat_jitter,
    round(CASE WHEN sd < 1e-9 THEN 0 ELSE m3 / sd ** 3 END, 5) AS iat_skew, round(CASE WHEN sd < 1e-9 THEN 0 ELSE m4 / sd ** 4 - 3 END, 5) AS iat_kurtosis
  FROM m JOIN c USING (session_id)""")
def f01(spark, sf):
    d = _with_id(B.timing_shape(fr.tagged(spark, sf)))
    return tidy(d.select("session_id", "iat_cv", "iat_jitter", "iat_skew", "iat_kurtosis"), 5)


@query("f02_burstiness", f"""WITH {sql.TAGGED}, b AS (SELECT session_id, CAST(floor((ts - start_ts) / 60) AS BIGINT) AS slot, count(*) AS c FROM tagged GROUP BY ALL),
  s AS (SELECT session_id, max(slot) + 1 AS slots, sum(c) AS n, sum(c * c) AS q FROM b GROUP BY session_id)
  SELECT session_id, round((q / slots - (n / slots) ** 2) / (n / slots), 6) AS burstiness_index FROM s""")
def f02(spark, sf):
    return tidy(_with_id(B.burstiness(fr.tagged(spark, sf))).select("session_id", "burstiness_index"))


@query("f04_session_entropies", f"""WITH {sql.TAGGED}, t AS (SELECT session_id, floor(log2(1 + iat)) AS b, count(*) AS c FROM tagged GROUP BY ALL),
  z AS (SELECT session_id, floor(log2(1 + bytes_per_pkt)) AS b, count(*) AS c FROM tagged GROUP BY ALL),
  te AS (SELECT session_id, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS timing_entropy FROM t GROUP BY session_id),
  ze AS (SELECT session_id, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS size_entropy FROM z GROUP BY session_id)
  SELECT session_id, round(timing_entropy, 6) AS timing_entropy, round(size_entropy, 6) AS size_entropy FROM te JOIN ze USING (session_id)""")
def f04(spark, sf):
    t = fr.tagged(spark, sf)
    d = B.timing_entropy(t).join(B.size_entropy(t), list(SESSION_KEY))
    return tidy(_with_id(d).select("session_id", "timing_entropy", "size_entropy"))
