"""Host timelines: per-session deviations, partner histories and host profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostwatch.config import SKEW, SkewConfig, TimelineConfig
from hostwatch.functions import scalars as S
from hostwatch.operators.decay import decayed_stats, zscore_vs_past
from hostwatch.operators.lineage import cut
from hostwatch.operators.ordered import KeyedRows

HOST = ("host_id",)
ORDERS = {
    "time": ("start_ts", "end_ts", "session_id"),
    "ingest": ("dest_id", "protocol", "start_ts", "session_id"),
}
# metric -> number of leading sessions of a host that have no value for it
METRICS = {"byte_volume": 0, "duration": 0, "num_flows": 0, "mean_iat": 0, "cv_iat": 0, "mean_packet_ratio": 0,
           "inter_session_gap": 1}
SCORED = ("byte_volume", "duration", "num_flows", "mean_iat", "cv_iat", "inter_session_gap")
SPLIT_HOST = ("split", "host_id")


@dataclass(frozen=True)
class Timelines:
    """Three tables: one row per session, per (host, destination) and per host."""

    host_sessions: DataFrame
    host_partners: DataFrame
    host_profile: DataFrame
    config: TimelineConfig = TimelineConfig()
    keys: tuple[str, ...] = HOST

    def host(self, host_id: str) -> "Timelines":
        """The timeline of one host."""
        one = F.col("host_id") == host_id
        return replace(self, host_sessions=self.host_sessions.filter(one),
                       host_partners=self.host_partners.filter(one), host_profile=self.host_profile.filter(one))


def number_rows(summaries: DataFrame, order: str = "time", keys: Sequence[str] = HOST,
                skew: SkewConfig | None = SKEW) -> KeyedRows:
    """``number_sessions`` together with how its keys are laid out."""
    by = ORDERS[order]
    rows = KeyedRows.plan(summaries, keys, by, skew=skew).scan(number="n", lag={"_end": "end_ts"})
    rows = rows.with_columns({"inter_session_gap": F.col("start_ts") - F.col("_end")}).drop("_end")
    # A pair can only be hot when its host is.
    pairs = KeyedRows.plan(rows.done(), tuple(keys) + ("dest_id",), by, skew=skew if rows.sliced else None)
    pairs = pairs.scan(number="partner_n", lag={"_end": "end_ts"})
    df = pairs.done().withColumn("partner_gap", F.col("start_ts") - F.col("_end")).drop("_end")
    return replace(rows, df=df)


def number_sessions(summaries: DataFrame, order: str = "time", keys: Sequence[str] = HOST,
                    skew: SkewConfig | None = SKEW) -> DataFrame:
    """Add position and gaps: ``n``, ``inter_session_gap`` per host and ``partner_n``, ``partner_gap`` per destination.

    ``order`` is chronological (``time``) or by destination group (``ingest``).
    """
    return number_rows(summaries, order, keys, skew).df


def build_host_sessions(summaries: DataFrame, cfg: TimelineConfig = TimelineConfig(), order: str = "time",
                        keys: Sequence[str] = HOST, skew: SkewConfig | None = SKEW) -> DataFrame:
    """Sessions in host order with baselines and deviations from the host's own past."""
    numbered = number_rows(summaries, order, keys, skew)
    rows = numbered.df.withColumns({
        "byte_volume": F.col("total_orig_bytes") + F.col("total_resp_bytes"),
        "duration": F.col("duration").cast("double"),
        "num_flows": F.col("num_flows").cast("double"),
        "hour": S.hour_utc("start_ts")})
    rows = decayed_stats(rows, keys, "n", METRICS, cfg.decay, longest=numbered.largest)
    known = F.col("n") - 1 >= cfg.min_sessions
    scored = {f"{m}_zscore": F.when(known & F.col(m).isNotNull(), zscore_vs_past(rows, m)) for m in SCORED}
    return rows.withColumns({
        **scored,
        "is_new_destination": F.when(known, (F.col("partner_n") == 1).cast("double")),
        "is_idle_hour": F.when(known, F.col("hour").isin(*cfg.idle_hours).cast("double")),
    }).drop(*[f"{m}_prev_{p}" for m in METRICS for p in ("count", "mean", "std")])


def partners_of(host_sessions: DataFrame, keys: Sequence[str] = HOST) -> DataFrame:
    """History of every (host, destination) pair."""
    out = host_sessions.groupBy(*keys, "dest_id").agg(
        F.min("n").alias("first_n"), F.min_by("start_ts", "n").alias("first_seen"),
        F.max_by("end_ts", "n").alias("last_seen"), F.count(F.lit(1)).alias("total_sessions"),
        F.sum("total_orig_bytes").alias("total_bytes_sent"), F.sum("total_resp_bytes").alias("total_bytes_recv"),
        F.coalesce(F.avg("partner_gap"), F.lit(0.0)).alias("mean_session_iat"),
        F.stddev_pop("partner_gap").alias("_std"))
    regular = (F.col("total_sessions") > 2) & (F.col("mean_session_iat") >= S.EPS)
    return out.withColumns({
        "relationship_duration": F.greatest(F.col("last_seen") - F.col("first_seen"), F.lit(0.0)),
        "session_regularity": F.when(regular, F.col("_std") / F.col("mean_session_iat")).otherwise(0.0)}).drop("_std")


def entropy(counts: Column) -> Column:
    """Shannon entropy (bits) of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x / total * F.log2(x / total))


def capped_history(host_sessions: DataFrame, keys: Sequence[str] = HOST, cap: int = 1000) -> DataFrame:
    """Counts and times over the last ``cap`` sessions of each host (a filtered top-k window)."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("n"))
    kept = (host_sessions.select(*keys, "n", "start_ts", "end_ts")
            .withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= cap))
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_sessions"), F.min_by("start_ts", "n").alias("first_seen"),
        F.max_by("end_ts", "n").alias("last_seen")).withColumn(
        "active_duration", F.greatest(F.col("last_seen") - F.col("first_seen"), F.lit(0.0)))


def hourly_activity(host_sessions: DataFrame, keys: Sequence[str] = HOST, extra: Sequence[Column] = ()) -> DataFrame:
    """24-bin histogram of session start hours per host."""
    hour = S.hour_utc("start_ts")
    bins = host_sessions.groupBy(*keys).agg(*[F.sum((hour == h).cast("double")).alias(f"_h{h}") for h in range(24)], *extra)
    return bins.withColumn("hourly", F.array(*[F.col(f"_h{h}") for h in range(24)])).drop(*[f"_h{h}" for h in range(24)])


def destination_rate(destinations: Column, active: Column, window: float = 3600.0) -> Column:
    """New destinations per window of active time."""
    return F.when((destinations < 1) | (active < 1), F.lit(0.0)).otherwise(
        destinations / F.greatest(F.lit(1.0), active / F.lit(float(window))))


def profile_of(host_sessions: DataFrame, partners: DataFrame, cfg: TimelineConfig = TimelineConfig(),
               keys: Sequence[str] = HOST) -> DataFrame:
    """One row per host: history, activity rhythm, destinations and the latest baselines."""
    keys = list(keys)
    state = F.struct(*[f"{m}_{p}" for m in METRICS for p in ("count", "mean", "std")],
                     *[F.col(f"{m}_zscore").alias(f"last_{m}_zscore") for m in SCORED])
    rhythm = hourly_activity(host_sessions, keys, extra=(F.max_by(state, "n").alias("_state"),))
    spread = partners.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_destinations"))
    out = (capped_history(host_sessions, keys, cfg.max_history).join(rhythm, keys).join(spread, keys)
           .select("*", "_state.*").drop("_state"))
    return out.withColumns({
        "activity_entropy": entropy(F.col("hourly")),
        "has_baseline": F.col("num_sessions") >= cfg.min_sessions,
        "new_dest_rate": destination_rate(F.col("unique_destinations"), F.col("active_duration"))})


def timelines_from(host_sessions: DataFrame, cfg: TimelineConfig = TimelineConfig(), keys: Sequence[str] = HOST) -> Timelines:
    """Derive the partner and profile tables of a host-session table."""
    partners = partners_of(host_sessions, keys)
    return Timelines(host_sessions, partners, profile_of(host_sessions, partners, cfg, keys), cfg, tuple(keys))


def build_timelines(summaries: DataFrame, cfg: TimelineConfig = TimelineConfig(), order: str = "time",
                    keys: Sequence[str] = HOST, skew: SkewConfig | None = SKEW) -> Timelines:
    """Summaries to timelines.  The (already reduced) summaries and the host sessions are cut off from the
    work before them, because several parts of the timeline read them."""
    return timelines_from(cut(build_host_sessions(cut(summaries), cfg, order, keys, skew)), cfg, keys)


def host_features(tl: Timelines) -> DataFrame:
    """The host-level feature vector."""
    p = tl.host_profile

    def base(metric: str, part: str) -> Column:
        return F.when(F.col(f"{metric}_count") > 1, F.col(f"{metric}_{part}")).otherwise(0.0)

    gap_mean, gap_std = base("inter_session_gap", "mean"), base("inter_session_gap", "std")
    features = {
        "comm_cadence_cv": S.ratio_or_zero(gap_std, gap_mean, S.EPS),
        "session_freq_avg": S.ratio_or_zero(F.col("num_sessions"), F.col("active_duration") / 3600.0),
        "active_hour_entropy": F.col("activity_entropy"),
        "dest_diversity_rolling": F.col("unique_destinations").cast("double"),
        "new_dest_rate": F.col("new_dest_rate"),
    }
    for metric in ("byte_volume", "mean_iat", "duration"):
        features[f"{metric}_baseline_mean"] = base(metric, "mean")
        features[f"{metric}_baseline_std"] = base(metric, "std")
    return p.select(*tl.keys, *[c.alias(n) for n, c in features.items()])


def top_partners(tl: Timelines, k: int = 10) -> DataFrame:
    """The ``k`` partners of each host with most sessions; ties by first contact."""
    best = Window.partitionBy(*tl.keys).orderBy(F.desc("total_sessions"), "first_n", "dest_id")
    return tl.host_partners.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def host_profiles(tl: Timelines, k: int = 10) -> DataFrame:
    """Profile with the top partners as an array."""
    entry = F.struct("rank", F.col("dest_id").alias("dest"), F.col("total_sessions").alias("sessions"),
                     F.col("relationship_duration").alias("duration"), F.col("session_regularity").alias("regularity"))
    tops = top_partners(tl, k).groupBy(*tl.keys).agg(F.sort_array(F.collect_list(entry)).alias("top_partners"))
    return tl.host_profile.select(*tl.keys, "num_sessions", "unique_destinations", "active_duration", "first_seen",
                                  "last_seen", "activity_entropy").join(tops, list(tl.keys))


def timeline_summary(tl: Timelines, by: Sequence[str] = ()) -> DataFrame:
    """Totals over all hosts.  Session counts are capped, so the exact median has a bounded state."""
    n = F.col("num_sessions")
    return tl.host_profile.groupBy(*by).agg(
        F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum(n), F.lit(0)).alias("total_sessions"),
        F.avg(n).alias("sessions_per_host_mean"), F.percentile(n, F.lit(0.5)).alias("sessions_per_host_median"),
        F.max(n).alias("sessions_per_host_max"), F.sum(F.col("has_baseline").cast("bigint")).alias("hosts_with_baseline"),
        F.sum("unique_destinations").alias("total_unique_destinations"),
        F.avg("unique_destinations").alias("unique_destinations_mean"))


def alerts(host_sessions: DataFrame, threshold: float = TimelineConfig().z_threshold) -> DataFrame:
    """Sessions with at least one deviation of ``threshold`` or more."""
    strongest = F.greatest(*[F.coalesce(F.abs(F.col(f"{m}_zscore")), F.lit(0.0)) for m in SCORED])
    return host_sessions.filter(strongest >= threshold)
