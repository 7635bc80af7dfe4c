"""Shared SQL fragments of the DuckDB counterparts."""

from __future__ import annotations

from hostwatch.config import FEATURES

TIMEOUT = 172800

# Octets of an address as a number, and the private IPv4 ranges by arithmetic on it.
IP_NUMBER = """(CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({c}, '.', 2) AS BIGINT) * 65536
  + CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + CAST(split_part({c}, '.', 4) AS BIGINT))"""


def private(c: str) -> str:
    n = IP_NUMBER.format(c=c)
    ranges = [(0, 8), (10 << 24, 8), (127 << 24, 8), ((169 << 24) + (254 << 16), 16), ((172 << 24) + (16 << 16), 12),
              (192 << 24, 24), ((192 << 24) + (2 << 8), 24), ((192 << 24) + (168 << 16), 16), ((198 << 24) + (18 << 16), 15),
              ((198 << 24) + (51 << 16) + (100 << 8), 24), ((203 << 24) + (113 << 8), 24), (240 << 24, 4)]
    tests = " OR ".join(f"{n} BETWEEN {lo} AND {lo + 2 ** (32 - b) - 1}" for lo, b in ranges)
    return f"CASE WHEN ({tests}) AND {c} NOT IN ('192.0.0.9', '192.0.0.10') THEN 1 ELSE 0 END"


RAW = """raw AS (
  SELECT event_id AS flow_id, epoch_us(ts) / 1e6 AS ts,
    '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS src_ip,
    CASE WHEN event_type IN ('click', 'view') THEN '8.8.8.8' WHEN event_type = 'purchase' THEN '192.168.7.9'
         WHEN event_type = 'signup' THEN '100.64.0.1' ELSE '172.32.0.1' END AS dst_ip,
    'tcp' AS proto, value AS orig_bytes, CAST(k AS DOUBLE) AS resp_bytes, CAST(1 + k % 7 AS DOUBLE) AS orig_pkts,
    CAST(k % 5 AS DOUBLE) AS resp_pkts, value / 100 AS duration, CAST(1024 + k AS DOUBLE) AS src_port,
    CASE WHEN k % 2 = 0 THEN CAST(443 AS DOUBLE) ELSE CAST(80 AS DOUBLE) END AS dst_port, CAST(k >= 85 AS INTEGER) AS label
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events))"""

RATIOS = """ratios AS (
  SELECT *, (orig_bytes + resp_bytes) / (orig_pkts + resp_pkts + 1e-9) AS bytes_per_pkt,
    orig_pkts / (resp_pkts + 1e-9) AS packet_ratio, orig_bytes / (resp_bytes + 1e-9) AS byte_ratio,
    CASE WHEN dst_ip = '192.168.7.9' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS is_outbound
  FROM raw)"""

FLOWS = f"""{RAW}, {RATIOS}, gaps AS (
  SELECT *, greatest(coalesce(ts - lag(ts) OVER g, 0), 0) AS iat, coalesce(orig_bytes - lag(orig_bytes) OVER g, 0) AS byte_delta
  FROM ratios WINDOW g AS (PARTITION BY src_ip, dst_ip, proto ORDER BY ts, flow_id)),
flows AS (
  SELECT *, coalesce(iat - lag(iat) OVER (PARTITION BY src_ip, dst_ip, proto ORDER BY ts, flow_id), 0) AS iat_delta FROM gaps)"""

TAGGED = f"""{FLOWS}, cuts AS (
  SELECT *, CASE WHEN lag(ts) OVER g IS NULL OR ts - lag(ts) OVER g > {TIMEOUT} THEN 1 ELSE 0 END AS cut
  FROM flows WINDOW g AS (PARTITION BY src_ip, dst_ip, proto ORDER BY ts, flow_id)),
numbered AS (
  SELECT *, CAST(sum(cut) OVER (PARTITION BY src_ip, dst_ip, proto ORDER BY ts, flow_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
    AS session_no FROM cuts),
tagged AS (
  SELECT *, first_value(ts) OVER s AS start_ts, first_value(flow_id) OVER s AS start_flow_id,
    md5(concat_ws('|', src_ip, dst_ip, proto, CAST(CAST(first_value(ts) OVER s AS DECIMAL(38, 6)) AS VARCHAR),
      CAST(first_value(flow_id) OVER s AS VARCHAR))) AS session_id,
    row_number() OVER (PARTITION BY src_ip, dst_ip, proto, session_no ORDER BY ts DESC, flow_id DESC) AS back,
    count(*) OVER (PARTITION BY src_ip, dst_ip, proto, session_no) AS all_flows
  FROM numbered WINDOW s AS (PARTITION BY src_ip, dst_ip, proto, session_no ORDER BY ts, flow_id))"""

SUMMARIES = f"""{TAGGED}, sums AS (
  SELECT session_id, src_ip AS host_id, dst_ip AS dest_id, proto AS protocol, min(start_ts) AS start_ts, max(ts) AS end_ts,
    count(*) AS num_flows, CASE WHEN 2 * sum(label) > count(label) THEN 1 ELSE 0 END AS label,
    sum(orig_bytes) AS total_orig_bytes, sum(resp_bytes) AS total_resp_bytes, sum(orig_pkts) AS total_orig_pkts,
    sum(resp_pkts) AS total_resp_pkts, avg(iat) AS mean_iat, stddev_pop(iat) AS std_iat,
    avg(bytes_per_pkt) AS mean_bytes_per_pkt, avg(packet_ratio) AS mean_packet_ratio, avg(byte_ratio) AS mean_byte_ratio
  FROM tagged GROUP BY ALL),
summaries AS (
  SELECT *, greatest(end_ts - start_ts, 0) AS duration,
    CASE WHEN mean_iat > 1e-9 THEN std_iat / mean_iat ELSE 0 END AS cv_iat FROM sums)"""


def kept(columns: str = "*", where: str = "") -> str:
    """The last 20 flows of every session, oldest first as ``pos``."""
    return f"""{TAGGED}, kept AS (
  SELECT {columns}, least(all_flows, 20) - back + 1 AS pos, least(all_flows, 20) AS n_flows
  FROM tagged WHERE back <= 20 {where})"""


def limited() -> str:
    """``kept`` with every feature within its limits, as ``limited``."""
    from hostwatch.operators.flows import LIMITS

    def within(f: str) -> str:
        low, high = LIMITS.get(f, (None, None))
        value = f if low is None else f"greatest({f}, CAST({low} AS DOUBLE))"
        return f"{value if high is None else f'least({value}, CAST({high!r} AS DOUBLE))'} AS {f}"

    return f"{kept()}, limited AS (SELECT session_id, start_ts, n_flows, pos, {', '.join(map(within, FEATURES))} FROM kept)"


HOSTS = f"""{SUMMARIES}, ordered AS (
  SELECT *, row_number() OVER h AS n, start_ts - lag(end_ts) OVER h AS inter_session_gap,
    row_number() OVER p AS partner_n, start_ts - lag(end_ts) OVER p AS partner_gap,
    total_orig_bytes + total_resp_bytes AS byte_volume, CAST(floor(start_ts / 3600) AS BIGINT) % 24 AS hour
  FROM summaries WINDOW h AS (PARTITION BY host_id ORDER BY start_ts, end_ts, session_id),
    p AS (PARTITION BY host_id, dest_id ORDER BY start_ts, end_ts, session_id))"""

METRICS = ("byte_volume", "duration", "num_flows", "mean_iat", "cv_iat", "mean_packet_ratio", "inter_session_gap")
SCORED = ("byte_volume", "duration", "num_flows", "mean_iat", "cv_iat", "inter_session_gap")


def _decayed(metrics: tuple[str, ...]) -> str:
    """Weighted mean and deviation of every row's history, straight from the definition."""
    means = ", ".join(f"sum(w * b.{m}) FILTER (b.{m} IS NOT NULL) / sum(w) FILTER (b.{m} IS NOT NULL) AS {m}_mean, "
                      f"count(b.{m}) AS {m}_count" for m in metrics)
    devs = ", ".join(f"sqrt(coalesce(sum(w * (b.{m} - a.{m}_mean) ** 2) FILTER (b.{m} IS NOT NULL) "
                     f"/ sum(w) FILTER (b.{m} IS NOT NULL), 0)) AS {m}_std" for m in metrics)
    plain = ", ".join(f"any_value(coalesce(a.{m}_mean, 0)) AS {m}_mean, any_value(a.{m}_count) AS {m}_count" for m in metrics)
    return f"""pairs AS (SELECT a.host_id, a.n, b.*, pow(CAST(0.95 AS DOUBLE), a.n - b.m) AS w
  FROM (SELECT host_id, n FROM ordered) a JOIN (SELECT host_id AS h, n AS m, {", ".join(metrics)} FROM ordered) b
  ON a.host_id = b.h AND b.m <= a.n),
means AS (SELECT host_id, n, {means} FROM pairs b GROUP BY host_id, n),
stats AS (SELECT a.host_id, a.n, {plain}, {devs} FROM means a JOIN pairs b ON a.host_id = b.host_id AND a.n = b.n
  GROUP BY a.host_id, a.n)"""


DECAYED = f"{HOSTS}, {_decayed(METRICS)}"

DEVIATIONS = f"""{DECAYED}, scored AS (SELECT o.*, {", ".join(
    f"CASE WHEN o.n <= 10 OR o.{m} IS NULL THEN NULL WHEN s.{m}_count < 2 OR s.{m}_std < 1e-9 THEN CAST(0 AS DOUBLE) "
    f"ELSE (o.{m} - s.{m}_mean) / s.{m}_std END AS {m}_zscore" for m in SCORED)},
    CASE WHEN o.n > 10 THEN CAST(o.partner_n = 1 AS INTEGER) * CAST(1 AS DOUBLE) END AS is_new_destination,
    CASE WHEN o.n > 10 THEN CAST(o.hour IN (0, 1, 2, 3, 4, 5) AS INTEGER) * CAST(1 AS DOUBLE) END AS is_idle_hour
  FROM ordered o LEFT JOIN stats s ON o.host_id = s.host_id AND o.n = s.n + 1)"""

PARTNERS = f"""{HOSTS}, pairsum AS (
  SELECT host_id, dest_id, min(n) AS first_n, arg_min(start_ts, n) AS first_seen, arg_max(end_ts, n) AS last_seen,
    count(*) AS total_sessions, sum(total_orig_bytes) AS total_bytes_sent, sum(total_resp_bytes) AS total_bytes_recv,
    coalesce(avg(partner_gap), 0) AS mean_session_iat, stddev_pop(partner_gap) AS gap_std
  FROM ordered GROUP BY host_id, dest_id),
partners AS (SELECT *, greatest(last_seen - first_seen, 0) AS relationship_duration,
    CASE WHEN total_sessions > 2 AND mean_session_iat >= 1e-9 THEN gap_std / mean_session_iat ELSE 0 END AS session_regularity
  FROM pairsum)"""

HISTORY = """capped AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY host_id) AS total FROM ordered) WHERE n > total - 1000),
history AS (SELECT host_id, count(*) AS num_sessions, arg_min(start_ts, n) AS first_seen, arg_max(end_ts, n) AS last_seen,
    greatest(arg_max(end_ts, n) - arg_min(start_ts, n), 0) AS active_duration, count(DISTINCT dest_id) AS unique_destinations
  FROM capped GROUP BY host_id),
bins AS (SELECT host_id, hour, count(*) AS c FROM ordered GROUP BY host_id, hour),
rhythm AS (SELECT host_id, -sum(c / t * log2(c / t)) AS activity_entropy
  FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY host_id) AS DOUBLE) AS t FROM bins) GROUP BY host_id),
profile AS (SELECT h.*, r.activity_entropy, CASE WHEN active_duration < 1 THEN 0
    ELSE unique_destinations / greatest(1, active_duration / 3600) END AS new_dest_rate
  FROM history h JOIN rhythm r USING (host_id))"""

FEATURE_LIST = ", ".join(FEATURES)

SAMPLES = """samples AS (SELECT d.doc_id AS sample_id, coalesce(l.toxic, 0) AS label,
    CASE WHEN coalesce(l.toxic, 0) = 1 THEN d.lang ELSE '' END AS c2_family, d.source, CAST(d.doc_id * 3600 AS DOUBLE) AS start_ts,
    d.source AS host_id, md5('42:' || CAST(d.doc_id AS VARCHAR)) AS h
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SCORES = """scored AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    round(l_discount * 5 + l_tax * 2, 2) AS score, l_linestatus FROM lineitem)"""
FINE = """scored AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    l_extendedprice / CAST(200000 AS DOUBLE) AS score, l_linestatus FROM lineitem)"""
POINTS = """counts AS (SELECT score, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM scored GROUP BY score),
points AS (SELECT *, sum(n_pos) OVER d AS tp, sum(n_neg) OVER d AS fp, sum(n_pos) OVER () AS p, sum(n_neg) OVER () AS n
  FROM counts WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def rounded(names: str, digits: int = 6, prefix: str = "") -> str:
    """``round(a, 6) AS a, ...`` for a space-separated list of columns."""
    return ", ".join(f"round({prefix}{n}, {digits}) AS {n}" for n in names.split())
