"""Behavioural, entropy and persistence features of sessions and hosts, and the fused risk score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hostwatch.config import SESSION_KEY, SKEW, FusionConfig, SkewConfig, TimelineConfig
from hostwatch.functions import scalars as S
from hostwatch.operators.ordered import KeyedRows
from hostwatch.operators.rank import exact_quantiles
from hostwatch.operators.timeline import HOST, ORDERS


def _log_bin(c: str) -> Column:
    return F.floor(F.log2(1 + F.greatest(F.col(c), F.lit(0.0))))


def _grouped_entropy(df: DataFrame, keys: Sequence[str], name: str, *bins: Column) -> DataFrame:
    """Entropy (bits) of the distribution over bins within each key; counted per bin first."""
    parts = [b.alias(f"_b{i}") for i, b in enumerate(bins)]
    counts = df.groupBy(*keys, *parts).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c")
    value = F.log2(total) - F.sum(F.col("_c") * F.log2("_c")) / total
    return counts.groupBy(*keys).agg(F.greatest(value, F.lit(0.0)).alias(name))


def timing_shape(tagged: DataFrame, keys: Sequence[str] = SESSION_KEY) -> DataFrame:
    """Spread and shape of the inter-arrival times of a session.

    The median is exact and interpolated for sessions of any length: equal values are counted and ranked by a distributed scan.
    """
    medians = exact_quantiles(tagged.select(*keys, "iat"), "iat", {"_median": 0.5}, by=keys)
    out = tagged.groupBy(*keys).agg(
        F.avg("iat").alias("_mean"), F.stddev_pop("iat").alias("_std"),
        F.skewness("iat").alias("_skew"), F.kurtosis("iat").alias("_kurt")).join(medians, list(keys), "left")
    flat = F.col("_std") < S.EPS
    return out.select(*keys, S.ratio_or_zero(F.col("_std"), F.col("_mean"), S.EPS).alias("iat_cv"),
                      S.ratio_or_zero(F.col("_std"), F.col("_median"), S.EPS).alias("iat_jitter"),
                      F.when(flat, 0.0).otherwise(F.col("_skew")).alias("iat_skew"),
                      F.when(flat, 0.0).otherwise(F.col("_kurt")).alias("iat_kurtosis"))


def burstiness(tagged: DataFrame, keys: Sequence[str] = SESSION_KEY, bucket: float = 60.0) -> DataFrame:
    """Fano factor: variance over mean of the flow counts per bucket of the session, empty buckets included."""
    slot = F.floor((F.col("ts") - F.col("start_ts")) / F.lit(bucket)).alias("_slot")
    counts = tagged.groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("_c"))
    slots, total = F.max("_slot") + 1, F.sum("_c")
    mean = total / slots
    return counts.groupBy(*keys).agg(((F.sum(F.col("_c") * F.col("_c")) / slots - mean * mean) / mean).alias("burstiness_index"))


def size_entropy(tagged: DataFrame, keys: Sequence[str] = SESSION_KEY) -> DataFrame:
    return _grouped_entropy(tagged, keys, "size_entropy", _log_bin("bytes_per_pkt"))


def timing_entropy(tagged: DataFrame, keys: Sequence[str] = SESSION_KEY) -> DataFrame:
    return _grouped_entropy(tagged, keys, "timing_entropy", _log_bin("iat"))


def behavioral_entropy(sessions: DataFrame, keys: Sequence[str] = HOST) -> DataFrame:
    """Entropy of a host's session profiles (volume and length, in powers of two)."""
    volume = F.floor(F.log2(1 + F.col("total_orig_bytes") + F.col("total_resp_bytes")))
    return _grouped_entropy(sessions, keys, "behavioral_entropy", volume, F.floor(F.log2(1 + F.col("num_flows"))))


def destination_entropy(sessions: DataFrame, keys: Sequence[str] = HOST) -> DataFrame:
    return _grouped_entropy(sessions, keys, "destination_entropy", F.col("dest_id"))


def activity_regularity(profile: DataFrame) -> Column:
    return F.lit(1.0) - F.col("activity_entropy") / F.log2(F.lit(24.0))


def idle_activity(sessions: DataFrame, cfg: TimelineConfig = TimelineConfig(), keys: Sequence[str] = HOST) -> DataFrame:
    """Share of a host's sessions that start in idle hours."""
    idle = S.hour_utc("start_ts").isin(*cfg.idle_hours).cast("double")
    return sessions.groupBy(*keys).agg(F.avg(idle).alias("idle_period_activity"))


PROFILE = ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")


def persistence_features(sessions: DataFrame, keys: Sequence[str] = HOST, order: str = "time",
                         skew: SkewConfig | None = SKEW) -> DataFrame:
    """Per session: time since the partner was last left, age of the relationship, likeness to the session before.

    Likeness is the cosine between the mean feature vectors of consecutive sessions with one partner.
    """
    vector = F.array(*[F.col(f"total_{p}") / F.col("num_flows") for p in PROFILE],
                     *[F.col(c) for c in ("mean_bytes_per_pkt", "mean_packet_ratio", "mean_byte_ratio", "mean_iat")])
    rows = KeyedRows.plan(sessions.withColumn("_v", vector), tuple(keys) + ("dest_id",), ORDERS[order], skew=skew)
    rows = rows.scan(lag={"_end": "end_ts", "_w": "_v"}, cut=F.col("_end").isNull(), at_cut={"_first": F.col("start_ts")})

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)

    size = F.sqrt(dot("_v", "_v")) * F.sqrt(dot("_w", "_w"))
    return rows.done().select(
        *keys, "session_id", (F.col("start_ts") - F.col("_end")).alias("reconnect_time"),
        F.greatest(F.col("end_ts") - F.col("_first"), F.lit(0.0)).alias("relationship_duration"),
        (F.col("start_ts") - F.col("_first")).alias("communication_longevity"),
        F.when(size > S.EPS, dot("_v", "_w") / size).alias("session_consistency"))


# Score of a protocol version.
TLS_VERSIONS = {"SSLv2": 0.0, "SSLv3": 0.1, "TLSv10": 0.3, "TLSv11": 0.5, "TLSv12": 0.8, "TLSv13": 1.0}


def tls_features(flows: DataFrame, ssl: DataFrame) -> DataFrame:
    """TLS features of flows by connection id: rarity of the fingerprint, version, chain, server name, self-signed.

    ``ssl`` columns that a log does not have count as absent.
    """
    def text(name: str) -> Column:
        return F.col(f"`{name}`") if name in ssl.columns else F.lit(None).cast("string")

    chain = text("cert_chain_fuids")
    facts = ssl.groupBy("uid").agg(
        F.min(text("ja3")).alias("_ja3"), F.min(text("version")).alias("_version"), F.min(text("server_name")).alias("_sni"),
        F.max(F.when(chain.isNotNull(), F.size(F.split(chain, ","))).otherwise(0)).alias("_chain"),
        F.max(F.coalesce(text("validation_status").contains("self signed"), F.lit(False)).cast("int")).alias("_self"))
    seen = ssl.filter(text("ja3").isNotNull()).groupBy(text("ja3").alias("_ja3")).agg(F.count(F.lit(1)).alias("_n"))
    total = ssl.filter(text("ja3").isNotNull()).count()
    facts = facts.join(seen, "_ja3", "left").withColumn("_has", F.lit(1))
    out = flows.join(facts, "uid", "left")
    score = F.coalesce(*[F.when(F.col("_version") == v, F.lit(x)) for v, x in TLS_VERSIONS.items()], F.lit(0.0))
    return out.withColumns({
        "has_tls": F.coalesce(F.col("_has"), F.lit(0)),
        "ja3_hash_rarity": F.coalesce(-F.log(F.col("_n") / F.lit(float(max(total, 1)))), F.lit(0.0)),
        "tls_version_score": score, "cert_chain_length": F.coalesce(F.col("_chain"), F.lit(0)),
        "sni_present": F.coalesce((F.coalesce(F.col("_sni"), F.lit("")) != "").cast("int"), F.lit(0)),
        "self_signed_cert": F.coalesce(F.col("_self"), F.lit(0))}).drop("_ja3", "_version", "_sni", "_chain", "_self", "_n", "_has")


def risk_score(signals: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """Weighted sum of signals in [0, 1]; 'high' also needs several signals that agree."""
    values = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in cfg.weights if n in signals.columns}
    score = sum((v * w for n, v in values.items() for w in [cfg.weights[n]]), F.lit(0.0))
    aligned = sum(((v >= cfg.aligned_at).cast("int") for v in values.values()), F.lit(0))
    out = signals.withColumns({"risk_score": score, "aligned_signals": aligned})
    high = (F.col("risk_score") >= cfg.high) & (F.col("aligned_signals") >= cfg.min_signals_for_high)
    return out.withColumn("risk_level", F.when(high, "high").when(F.col("risk_score") >= cfg.medium, "medium").otherwise("low"))


def anomaly_signal(z: Column, threshold: float = TimelineConfig().z_threshold) -> Column:
    """A z-score as a signal in [0, 1] that saturates at the alert threshold."""
    return F.least(F.abs(F.coalesce(z, F.lit(0.0))) / threshold, F.lit(1.0))
