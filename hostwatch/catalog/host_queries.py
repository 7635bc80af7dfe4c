"""Host-level queries: timelines, partners, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostwatch.catalog import frames as fr, query, sql
from hostwatch.catalog.frames import tidy
from hostwatch.catalog.sql import METRICS, SCORED, rounded
from hostwatch.functions import scalars as S
from hostwatch.operators import behaviour as B, decay as D, timeline as TL
from hostwatch.operators.lineage import cut
from hostwatch.operators.ordered import KeyedRows
from hostwatch.sources import tables as T


@query("w09_session_gap", f"WITH {sql.HOSTS} SELECT session_id, round(inter_session_gap, 6) AS inter_session_gap FROM ordered")
def w09(spark, sf):
    return tidy(fr.numbered(spark, sf).select("session_id", "inter_session_gap"))


DECAYED_COLUMNS = [f"{m}_{p}" for m in METRICS for p in ("mean", "std") if m != "mean_packet_ratio"]


@query("w10_decayed_stats", f"WITH {sql.DECAYED} SELECT host_id, n, {', '.join(f'{m}_count' for m in METRICS)}, {rounded(' '.join(DECAYED_COLUMNS), 4)} FROM stats")
def w10(spark, sf):
    d = fr.host_sessions(spark, sf)
    return d.select("host_id", "n", *[f"{m}_count" for m in METRICS], *[F.round(c, 4).alias(c) for c in DECAYED_COLUMNS])


@query("w10_decayed_prices", """WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderkey, o_totalprice AS x FROM orders),
  m AS (SELECT a.o_custkey, a.n, a.o_orderkey, sum(pow(CAST(0.9 AS DOUBLE), a.n - b.n) * b.x) / sum(pow(CAST(0.9 AS DOUBLE), a.n - b.n)) AS mu
    FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.n <= a.n GROUP BY ALL),
  v AS (SELECT m.o_custkey, m.n, sqrt(sum(pow(CAST(0.9 AS DOUBLE), m.n - b.n) * (b.x - mu) ** 2) / sum(pow(CAST(0.9 AS DOUBLE), m.n - b.n))) AS sd
    FROM m JOIN o b ON m.o_custkey = b.o_custkey AND b.n <= m.n GROUP BY ALL)
  SELECT m.o_orderkey, m.n, round(mu, 4) AS x_mean, round(sd, 3) AS x_std FROM m JOIN v ON m.o_custkey = v.o_custkey AND m.n = v.n""")
def w10_prices(spark, sf):
    o = T.table(spark, sf, "orders")
    day = S.epoch_seconds("o_orderdate", o.schema["o_orderdate"].dataType)
    rows = KeyedRows.plan(o.select("o_custkey", "o_orderkey", day.alias("ts"), F.col("o_totalprice").alias("x")), ["o_custkey"], ["ts", "o_orderkey"])
    d = D.decayed_stats(rows.number("n").done(), ["o_custkey"], "n", {"x": 0}, decay=0.9)
    return d.select("o_orderkey", "n", F.round("x_mean", 4).alias("x_mean"), F.round("x_std", 3).alias("x_std"))


@query("w11_zscore", f"WITH {sql.DEVIATIONS} SELECT session_id, n, {rounded(' '.join(f'{m}_zscore' for m in SCORED), 5)} FROM scored WHERE n > 10")
def w11(spark, sf):
    d = fr.host_sessions(spark, sf).filter("n > 10")
    return tidy(d.select("session_id", "n", *[f"{m}_zscore" for m in SCORED]), 5)


@query("w12_baseline_gate", f"WITH {sql.HOSTS} SELECT session_id, n > 10 AS has_baseline, n FROM ordered")
def w12(spark, sf):
    return fr.host_sessions(spark, sf).select("session_id", F.col("byte_volume_zscore").isNotNull().alias("has_baseline"), "n")


@query("w13_first_contact", f"WITH {sql.DEVIATIONS} SELECT session_id, is_new_destination, partner_n FROM scored")
def w13(spark, sf):
    return fr.host_sessions(spark, sf).select("session_id", "is_new_destination", "partner_n")


@query("w14_idle_hour", f"WITH {sql.DEVIATIONS} SELECT session_id, is_idle_hour, CAST(hour AS INTEGER) AS hour FROM scored")
def w14(spark, sf):
    return fr.host_sessions(spark, sf).select("session_id", "is_idle_hour", "hour")


@query("w15_partner_gap", f"WITH {sql.HOSTS} SELECT session_id, round(partner_gap, 6) AS partner_gap FROM ordered")
def w15(spark, sf):
    return tidy(fr.numbered(spark, sf).select("session_id", "partner_gap"))


@query("w16_history_cap", f"""WITH {sql.HOSTS}, c AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY n DESC) AS r FROM ordered)
  SELECT host_id, count(*) AS num_sessions, round(arg_min(start_ts, n), 6) AS first_seen, round(arg_max(end_ts, n), 6) AS last_seen,
    round(greatest(arg_max(end_ts, n) - arg_min(start_ts, n), 0), 6) AS active_duration FROM c WHERE r <= 12 GROUP BY host_id""")
def w16(spark, sf):
    return tidy(TL.capped_history(fr.numbered(spark, sf), cap=12))


@query("w17_ingest_order", f"""WITH {sql.SUMMARIES} SELECT session_id, row_number() OVER h AS n, round(start_ts - lag(end_ts) OVER h, 6) AS inter_session_gap
  FROM summaries WINDOW h AS (PARTITION BY host_id ORDER BY dest_id, protocol, start_ts, session_id)""")
def w17(spark, sf):
    return tidy(fr.numbered(spark, sf, "ingest").select("session_id", "n", "inter_session_gap"))


@query("a07_partner_history", f"WITH {sql.PARTNERS} SELECT host_id, dest_id, first_n, total_sessions, "
                              f"{rounded('first_seen last_seen total_bytes_sent total_bytes_recv relationship_duration')} FROM partners")
def a07(spark, sf):
    d = fr.timelines(spark, sf).host_partners
    return tidy(d.select("host_id", "dest_id", "first_n", "total_sessions", "first_seen", "last_seen", "total_bytes_sent", "total_bytes_recv",
                         "relationship_duration"))


@query("a08_partner_cadence", f"WITH {sql.PARTNERS} SELECT host_id, dest_id, {rounded('mean_session_iat session_regularity', 5)} FROM partners")
def a08(spark, sf):
    return tidy(fr.timelines(spark, sf).host_partners.select("host_id", "dest_id", "mean_session_iat", "session_regularity"), 5)


@query("a09_hour_histogram", f"WITH {sql.SUMMARIES} SELECT host_id, CAST(floor(start_ts / 3600) AS BIGINT) % 24 AS hour, count(*) AS sessions FROM summaries GROUP BY ALL")
def a09(spark, sf):
    d = TL.hourly_activity(fr.summaries(spark, sf)).select("host_id", F.posexplode("hourly").alias("h", "c"))
    return d.filter("c > 0").select("host_id", F.col("h").cast("bigint").alias("hour"), F.col("c").cast("bigint").alias("sessions"))


PROFILE = f"WITH {sql.HOSTS}, {sql.HISTORY}"


@query("a10_activity_entropy", f"{PROFILE} SELECT host_id, round(activity_entropy, 6) AS activity_entropy FROM profile")
def a10(spark, sf):
    d = TL.hourly_activity(fr.summaries(spark, sf))
    return tidy(d.select("host_id", TL.entropy(F.col("hourly")).alias("activity_entropy")))


@query("a11_destination_count", f"{PROFILE} SELECT host_id, unique_destinations FROM profile")
def a11(spark, sf):
    return fr.timelines(spark, sf).host_profile.select("host_id", "unique_destinations")


@query("a12_new_destination_rate", f"{PROFILE} SELECT host_id, round(new_dest_rate, 9) AS new_dest_rate FROM profile")
def a12(spark, sf):
    return tidy(fr.timelines(spark, sf).host_profile.select("host_id", "new_dest_rate"), 9)


@query("a13_first_last_seen", f"{PROFILE} SELECT host_id, num_sessions, {rounded('first_seen last_seen active_duration')}, num_sessions >= 10 AS has_baseline FROM profile")
def a13(spark, sf):
    return tidy(fr.timelines(spark, sf).host_profile.select("host_id", "num_sessions", "first_seen", "last_seen", "active_duration", "has_baseline"))


BASE = ("byte_volume", "mean_iat", "duration")


@query("a14_host_features", f"""WITH {sql.DECAYED}, {sql.HISTORY}, latest AS (SELECT s.* FROM stats s JOIN (SELECT host_id, max(n) AS n FROM stats GROUP BY host_id) m
    ON s.host_id = m.host_id AND s.n = m.n)
  SELECT p.host_id, round(CASE WHEN inter_session_gap_count > 1 AND inter_session_gap_mean > 1e-9 THEN inter_session_gap_std / inter_session_gap_mean ELSE 0 END, 5) AS comm_cadence_cv,
    round(CASE WHEN active_duration > 0 THEN num_sessions / (active_duration / 3600) ELSE 0 END, 8) AS session_freq_avg, round(activity_entropy, 6) AS active_hour_entropy,
    CAST(unique_destinations AS DOUBLE) AS dest_diversity_rolling, round(new_dest_rate, 8) AS new_dest_rate,
    {", ".join(f"round(CASE WHEN {m}_count > 1 THEN {m}_mean ELSE 0 END, 4) AS {m}_baseline_mean, round(CASE WHEN {m}_count > 1 THEN {m}_std ELSE 0 END, 4) AS {m}_baseline_std" for m in BASE)}
  FROM profile p JOIN latest l ON p.host_id = l.host_id""")
def a14(spark, sf):
    d = TL.host_features(fr.timelines(spark, sf))
    digits = {"comm_cadence_cv": 5, "session_freq_avg": 8, "active_hour_entropy": 6, "new_dest_rate": 8, "dest_diversity_rolling": 6}
    return d.select("host_id", *[F.round(c, digits.get(c, 4)).alias(c) for c in d.columns if c != "host_id"])


@query("a15_host_profile", f"""WITH {sql.PARTNERS}, {sql.HISTORY}, ranked AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY total_sessions DESC, first_n, dest_id) AS rank FROM partners)
  SELECT p.host_id, any_value(num_sessions) AS num_sessions, any_value(unique_destinations) AS unique_destinations, round(any_value(p.active_duration), 6) AS active_duration,
    round(any_value(activity_entropy), 6) AS activity_entropy, string_agg(dest_id || '=' || CAST(total_sessions AS VARCHAR), ',' ORDER BY rank) AS top_partners
  FROM profile p JOIN ranked r ON p.host_id = r.host_id WHERE rank <= 10 GROUP BY p.host_id""")
def a15(spark, sf):
    d = TL.host_profiles(fr.timelines(spark, sf))
    tops = F.array_join(F.transform("top_partners", lambda p: F.concat(p["dest"], F.lit("="), p["sessions"].cast("string"))), ",")
    return tidy(d.select("host_id", "num_sessions", "unique_destinations", "active_duration", "activity_entropy", tops.alias("top_partners")))


@query("a16_timeline_summary", f"""{PROFILE} SELECT count(*) AS hosts, CAST(sum(num_sessions) AS BIGINT) AS total_sessions, round(avg(num_sessions), 6) AS sessions_per_host_mean,
  CAST(median(num_sessions) AS DOUBLE) AS sessions_per_host_median, max(num_sessions) AS sessions_per_host_max, count(*) FILTER (num_sessions >= 10) AS hosts_with_baseline,
  CAST(sum(unique_destinations) AS BIGINT) AS total_unique_destinations, round(avg(unique_destinations), 6) AS unique_destinations_mean FROM profile""")
def a16(spark, sf):
    return tidy(TL.timeline_summary(fr.timelines(spark, sf)))


@query("c06_host_timelines", f"WITH {sql.DEVIATIONS} SELECT session_id, host_id, dest_id, n, partner_n, label, {rounded('start_ts end_ts duration inter_session_gap partner_gap byte_volume')}, "
                             f"{rounded('byte_volume_zscore inter_session_gap_zscore', 5)}, is_new_destination, is_idle_hour FROM scored")
def c06(spark, sf):
    d = fr.host_sessions(spark, sf)
    return d.select("session_id", "host_id", "dest_id", "n", "partner_n", "label",
                    *[F.round(c, 6).alias(c) for c in ("start_ts", "end_ts", "duration", "inter_session_gap", "partner_gap", "byte_volume")],
                    *[F.round(c, 5).alias(c) for c in ("byte_volume_zscore", "inter_session_gap_zscore")], "is_new_destination", "is_idle_hour")


@query("j02_host_lookup", f"WITH {sql.DEVIATIONS} SELECT session_id, n, round(byte_volume_zscore, 5) AS byte_volume_zscore FROM scored WHERE host_id = '10.0.0.7'")
def j02(spark, sf):
    one = fr.summaries(spark, sf).filter(F.col("host_id") == "10.0.0.7")  # a filter can't pass the timelines' checkpoints
    d = TL.build_timelines(one).host("10.0.0.7").host_sessions
    return tidy(d.select("session_id", "n", "byte_volume_zscore"), 5)


@query("j09_top_partners", f"""WITH {sql.PARTNERS}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY host_id ORDER BY total_sessions DESC, first_n, dest_id) AS INTEGER) AS rank FROM partners)
  SELECT host_id, dest_id, total_sessions, rank FROM ranked WHERE rank <= 10""")
def j09(spark, sf):
    return TL.top_partners(fr.timelines(spark, sf)).select("host_id", "dest_id", "total_sessions", "rank")


@query("t03_alerts", f"WITH {sql.DEVIATIONS} SELECT session_id, n FROM scored WHERE greatest({', '.join(f'coalesce(abs({m}_zscore), 0)' for m in SCORED)}) >= 3")
def t03(spark, sf):
    return TL.alerts(fr.host_sessions(spark, sf)).select("session_id", "n")


# --- behaviour at host level ---------------------------------------------------------------------------

@query("f03_regularity", f"""WITH {sql.PARTNERS}, {sql.HISTORY} SELECT p.host_id, dest_id, round(session_regularity, 5) AS session_regularity,
  round(1 - activity_entropy / log2(24), 6) AS activity_regularity FROM partners q JOIN profile p ON q.host_id = p.host_id""")
def f03(spark, sf):
    tl = fr.timelines(spark, sf)
    hosts = tl.host_profile.select("host_id", B.activity_regularity(tl.host_profile).alias("activity_regularity"))
    d = tl.host_partners.join(hosts, "host_id")
    return d.select("host_id", "dest_id", F.round("session_regularity", 5).alias("session_regularity"), F.round("activity_regularity", 6).alias("activity_regularity"))


@query("f05_host_entropies", f"""WITH {sql.SUMMARIES}, b AS (SELECT host_id, floor(log2(1 + total_orig_bytes + total_resp_bytes)) AS v, floor(log2(1 + num_flows)) AS f, count(*) AS c
    FROM summaries GROUP BY ALL), d AS (SELECT host_id, dest_id, count(*) AS c FROM summaries GROUP BY ALL),
  be AS (SELECT host_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS behavioral_entropy FROM b GROUP BY host_id),
  de AS (SELECT host_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS destination_entropy FROM d GROUP BY host_id)
  SELECT host_id, round(behavioral_entropy, 6) AS behavioral_entropy, round(destination_entropy, 6) AS destination_entropy FROM be JOIN de USING (host_id)""")
def f05(spark, sf):
    s = cut(fr.summaries(spark, sf))
    return tidy(B.behavioral_entropy(s).join(B.destination_entropy(s), "host_id"))


PAIR_FIRST = "first_value(start_ts) OVER (PARTITION BY host_id, dest_id ORDER BY start_ts, end_ts, session_id)"


@query("f06_persistence", f"WITH {sql.HOSTS} SELECT session_id, round(partner_gap, 6) AS reconnect_time, round(greatest(end_ts - {PAIR_FIRST}, 0), 6) AS relationship_duration, "
                          f"round(start_ts - {PAIR_FIRST}, 6) AS communication_longevity FROM ordered")
def f06(spark, sf):
    d = B.persistence_features(fr.summaries(spark, sf))
    return tidy(d.select("session_id", "reconnect_time", "relationship_duration", "communication_longevity"))


MEANS = ("total_orig_bytes / num_flows", "total_resp_bytes / num_flows", "total_orig_pkts / num_flows", "total_resp_pkts / num_flows",
         "mean_bytes_per_pkt", "mean_packet_ratio", "mean_byte_ratio", "mean_iat")


@query("f07_session_consistency", f"""WITH {sql.HOSTS}, v AS (SELECT session_id, host_id, dest_id, partner_n, {", ".join(f"{e} AS v{i}" for i, e in enumerate(MEANS))} FROM ordered)
  SELECT a.session_id, round(({" + ".join(f"a.v{i} * b.v{i}" for i in range(8))}) / (sqrt({" + ".join(f"a.v{i} * a.v{i}" for i in range(8))})
    * sqrt({" + ".join(f"b.v{i} * b.v{i}" for i in range(8))})), 6) AS session_consistency
  FROM v a JOIN v b ON a.host_id = b.host_id AND a.dest_id = b.dest_id AND a.partner_n = b.partner_n + 1""")
def f07(spark, sf):
    d = B.persistence_features(fr.summaries(spark, sf)).filter("reconnect_time IS NOT NULL")
    return tidy(d.select("session_id", "session_consistency"))


@query("f08_idle_activity", f"WITH {sql.HOSTS} SELECT host_id, round(avg(CAST(hour < 6 AS INTEGER)), 9) AS idle_period_activity FROM ordered GROUP BY host_id")
def f08(spark, sf):
    return tidy(B.idle_activity(fr.summaries(spark, sf)), 9)


@query("f09_latest_deviation", f"""WITH {sql.DEVIATIONS} SELECT host_id, {", ".join(f"round(arg_max_null({m}_zscore, n), 5) AS last_{m}_zscore" for m in ("byte_volume", "mean_iat", "num_flows"))}
  FROM scored GROUP BY host_id""")
def f09(spark, sf):
    return tidy(fr.timelines(spark, sf).host_profile.select("host_id", "last_byte_volume_zscore", "last_mean_iat_zscore", "last_num_flows_zscore"), 5)


SIGNALS = {"host_anomaly": "byte_volume_zscore", "behavioral": "mean_iat_zscore", "persistence": "num_flows_zscore", "ml_score": "duration_zscore",
           "tls_dns": "cv_iat_zscore", "beaconing": "inter_session_gap_zscore"}
WEIGHTS = {"host_anomaly": 0.30, "behavioral": 0.25, "persistence": 0.15, "ml_score": 0.15, "tls_dns": 0.10, "beaconing": 0.05}


@query("f11_risk_score", f"""WITH {sql.DEVIATIONS}, g AS (SELECT session_id, {", ".join(f"least(abs(coalesce({z}, 0)) / 3, 1) AS {n}" for n, z in SIGNALS.items())} FROM scored),
  r AS (SELECT session_id, {" + ".join(f"{n} * CAST({w} AS DOUBLE)" for n, w in WEIGHTS.items())} AS risk, {" + ".join(f"CAST({n} >= 0.5 AS INTEGER)" for n in WEIGHTS)} AS aligned FROM g)
  SELECT session_id, round(risk, 5) AS risk_score, aligned AS aligned_signals,
    CASE WHEN risk >= 0.7 AND aligned >= 3 THEN 'high' WHEN risk >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level FROM r""")
def f11(spark, sf):
    d = fr.host_sessions(spark, sf).select("session_id", *[B.anomaly_signal(F.col(z)).alias(n) for n, z in SIGNALS.items()])
    return tidy(B.risk_score(d).select("session_id", "risk_score", "aligned_signals", "risk_level"), 5)
