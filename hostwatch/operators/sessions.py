"""Cutting flows into sessions; session sequences, summaries and pooled vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostwatch.config import (FEATURES, FLOW_KEY, FLOW_ORDER, INACTIVITY_TIMEOUT, POOL_STATS, SESSION_LEN, SKEW,
                              SkewConfig)
from hostwatch.functions import scalars as S
from hostwatch.operators.flows import drop_unusable, require_columns
from hostwatch.operators.ordered import KeyedRows

FLOW_TYPE = "struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">"


def session_starts(rows: KeyedRows, timeout: float = INACTIVITY_TIMEOUT, number: str | None = None) -> KeyedRows:
    """Tag every flow with the time and id of the first flow of its session.

    A gap strictly longer than ``timeout`` starts a session.  ``number`` adds the position of the session in its key; it counts
    the cuts themselves, as repeated rows share time and id with the first one of a session.
    """
    cut = F.col("_prev").isNull() | (F.col("ts") - F.col("_prev") > F.lit(float(timeout)))
    rows = rows.scan(lag={"_prev": "ts"}, cut=cut, at_cut={"_start": F.struct(F.col("ts").alias("t"), F.col("flow_id").alias("f"))}, cut_number=number)
    return rows.with_columns({"start_ts": F.col("_start.t"), "start_flow_id": F.col("_start.f")}).drop("_prev", "_start")


def session_id(keys: Sequence[str] = FLOW_KEY) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys],
                             F.col("start_ts").cast("decimal(38,6)").cast("string"),
                             F.col("start_flow_id").cast("string")))


def sessionize(df: DataFrame, timeout: float = INACTIVITY_TIMEOUT, keys: Sequence[str] = FLOW_KEY,
               extra_keys: Sequence[str] = (), numbered: bool = False, skew: SkewConfig | None = SKEW) -> DataFrame:
    """Flows with ``start_ts``, ``start_flow_id`` and ``session_id`` of the session they belong to.

    ``extra_keys`` (for example ``capture_id``) keep sessions from spanning their values.
    ``numbered`` adds ``session_no``, the position of the session in its key.
    """
    require_columns(df, ("ts", "flow_id") + tuple(keys), "flow table")
    group = tuple(extra_keys) + tuple(keys)
    rows = session_starts(KeyedRows.plan(drop_unusable(df), group, FLOW_ORDER, skew=skew), timeout, "session_no" if numbered else None)
    return rows.done().withColumn("session_id", session_id(group))


def min_flows(df: DataFrame, n: int, count: str = "n_flows") -> DataFrame:
    return df.filter(F.col(count) >= n)


def majority_label(label: Column) -> Column:
    """Most frequent 0/1 label of a group; a tie counts as benign."""
    return (2 * F.sum(label) > F.count(label)).cast("int")


def as_flow(df: DataFrame) -> Column:
    """Ordered feature record of a flow; a missing column takes its default."""
    def value(name: str) -> Column:
        default = 1.0 if name == "orig_pkts" else 0.0
        return S.to_number_mixed(name, default) if name in df.columns else F.lit(default)

    typed = dict(df.dtypes)
    return F.struct(*[(F.col(n) if typed.get(n) == "double" else value(n)).alias(n) for n in FEATURES])


def recent_flows(flows: DataFrame, group: Sequence[str], session_len: int = SESSION_LEN) -> DataFrame:
    """The last ``session_len`` flows of every session.

    Spark trims each input task to that many rows per session before the shuffle, so even a session
    that holds a large part of the data moves only a handful of rows per task.
    """
    last = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in FLOW_ORDER])
    return flows.withColumn("_back", F.row_number().over(last)).filter(F.col("_back") <= session_len).drop("_back")


def build_sessions(flows: DataFrame, label_col: str | None = "label", timeout: float = INACTIVITY_TIMEOUT,
                   min_flows: int = 1, session_len: int = SESSION_LEN, extra_keys: Sequence[str] = (),
                   carry: Sequence[str] = (), skew: SkewConfig | None = SKEW) -> DataFrame:
    """One row per session: key, start, all-flow count, label and the last flows in order.

    ``min_flows`` counts all flows of the session; ``n_flows`` of the result counts the kept ones.
    """
    if label_col:
        require_columns(flows, (label_col,), "flow table")
    key = tuple(extra_keys) + FLOW_KEY
    group = list(key) + ["start_ts", "start_flow_id"]
    rows = session_starts(KeyedRows.plan(drop_unusable(flows), key, FLOW_ORDER, skew=skew), timeout)
    tagged = rows.done()
    label = F.col(label_col) if label_col else F.lit(0)
    entry = F.struct("ts", "flow_id", as_flow(tagged).alias("x"))
    totals = [F.count(F.lit(1)).alias("all_flows"), majority_label(label).alias("label"),
              F.max("ts").alias("end_ts"), *[F.min(c).alias(c) for c in carry]]
    if rows.sliced:
        # A session may be as large as its key: trim before the shuffle, count in a combinable aggregate.
        sequences = (recent_flows(tagged, group, session_len).groupBy(*group)
                     .agg(F.sort_array(F.collect_list(entry)).alias("_s")))
        joined = tagged.groupBy(*group).agg(*totals).join(sequences, group)
    else:
        # One exchange: flows are already together by key, only the last ones are collected.
        last = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in FLOW_ORDER])
        joined = tagged.withColumn("_back", F.row_number().over(last)).groupBy(*group).agg(
            *totals, F.sort_array(F.collect_list(F.when(F.col("_back") <= session_len, entry))).alias("_s"))
    return (joined.filter(F.col("all_flows") >= min_flows)
            .withColumns({"flows": F.transform("_s", lambda e: e["x"]), "n_flows": F.size("_s")})
            .withColumn("session_id", session_id(key)).drop("_s"))


def summarize_sessions(flows: DataFrame, label_col: str | None = "label", timeout: float = INACTIVITY_TIMEOUT,
                       min_flows: int = 1, extra_keys: Sequence[str] = (), carry: Sequence[str] = (),
                       skew: SkewConfig | None = SKEW) -> DataFrame:
    """One row per session with volumes, inter-arrival statistics and mean ratios over all its flows."""
    tagged = sessionize(flows, timeout, extra_keys=extra_keys, skew=skew)
    return summarize_tagged(tagged, label_col, min_flows, extra_keys, carry)


def summarize_tagged(tagged: DataFrame, label_col: str | None = "label", min_flows: int = 1,
                     extra_keys: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Summaries of flows that already carry their session start."""
    def field(name: str) -> Column:
        return S.to_number(name) if name in tagged.columns and dict(tagged.dtypes)[name] != "double" else (
            F.coalesce(F.col(name), F.lit(0.0)) if name in tagged.columns else F.lit(0.0))

    group = list(extra_keys) + list(FLOW_KEY) + ["start_ts", "start_flow_id"]
    label = F.col(label_col) if label_col and label_col in tagged.columns else F.lit(0)
    out = tagged.groupBy(*group).agg(
        F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("num_flows"), majority_label(label).alias("label"),
        F.sum(field("orig_bytes")).alias("total_orig_bytes"), F.sum(field("resp_bytes")).alias("total_resp_bytes"),
        F.sum(field("orig_pkts")).alias("total_orig_pkts"), F.sum(field("resp_pkts")).alias("total_resp_pkts"),
        F.avg(field("iat")).alias("mean_iat"), F.stddev_pop(field("iat")).alias("std_iat"),
        F.avg(field("bytes_per_pkt")).alias("mean_bytes_per_pkt"),
        F.avg(field("packet_ratio")).alias("mean_packet_ratio"),
        F.avg(field("byte_ratio")).alias("mean_byte_ratio"),
        *[F.min(c).alias(c) for c in carry])
    return (out.filter(F.col("num_flows") >= min_flows)
            .withColumns({
                "session_id": session_id(list(extra_keys) + list(FLOW_KEY)),
                "host_id": F.col("src_ip"), "dest_id": F.col("dst_ip"), "protocol": F.col("proto"),
                "duration": F.greatest(F.col("end_ts") - F.col("start_ts"), F.lit(0.0)),
                "cv_iat": S.ratio_or_zero(F.col("std_iat"), F.col("mean_iat"), S.EPS)})
            .drop(*FLOW_KEY, "start_flow_id"))


# --- stored sequences (at most SESSION_LEN flows per row): no shuffle needed ------------------------

def _values(feature: str, flows: Column | None = None) -> Column:
    flows = F.col("flows") if flows is None else flows
    return F.transform(flows, lambda x: x[feature])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _mean(values: Column) -> Column:
    return _total(values) / F.size(values)


def _std(values: Column) -> Column:
    mean = _mean(values)
    return F.sqrt(F.aggregate(F.zip_with(values, F.array_repeat(mean, F.size(values)), lambda x, m: (x - m) * (x - m)),
                              F.lit(0.0), lambda a, d: a + d) / F.size(values))


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    low = F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(ordered, F.floor((n + 2) / 2).cast("int"))
    return (low + high) / 2


def pool_sessions(sessions: DataFrame) -> DataFrame:
    """Mean, population deviation, minimum and maximum of every feature over the kept flows."""
    columns: dict[str, Column] = {}
    pick = {"mean": _mean, "std": _std, "min": F.array_min, "max": F.array_max}
    for stat in POOL_STATS:
        for feature in FEATURES:
            columns[f"{feature}_{stat}"] = pick[stat](_values(feature))
    return sessions.withColumns(columns)


def pooled_names() -> list[str]:
    return [f"{feature}_{stat}" for stat in POOL_STATS for feature in FEATURES]


def class_counts(df: DataFrame, by: Sequence[str] = (), host_col: str | None = None) -> DataFrame:
    """Rows, positives, benign rows and percentage of positives, per group."""
    parts = [F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("label").cast("bigint")), F.lit(0)).alias("c2")]
    if host_col:
        parts.append(F.count_distinct(host_col).alias("unique_hosts"))
    out = df.groupBy(*by).agg(*parts)
    return out.withColumns({"benign": F.col("total") - F.col("c2"),
                            "c2_pct": F.when(F.col("total") > 0, 100.0 * F.col("c2") / F.col("total")).otherwise(0.0)})


def with_host_key(sessions: DataFrame) -> DataFrame:
    """Host fingerprint of a stored session from its flows, scoped by source and capture."""
    def part(tag: str, value: Column) -> Column:
        return F.concat(F.lit(f":{tag}"), value.cast("bigint").cast("string"))

    # The doubles are truncated, as an integer conversion does.
    key = F.concat(
        F.col("source"), F.lit(":"), F.col("capture_id"),
        part("dp", _median(_values("dst_port"))), part("sp", _median(_values("src_port"))),
        part("br", _median(_values("byte_ratio")) * 100), part("pr", _median(_values("packet_ratio")) * 100),
        part("o", F.bround(_mean(_values("is_outbound")))))
    none = F.concat_ws("_", F.lit("unknown"), F.col("capture_id"), F.col("source"))
    return sessions.withColumn("host_id", F.when(F.size("flows") > 0, key).otherwise(none))


def summarize_sequences(sessions: DataFrame) -> DataFrame:
    """Summary of stored sessions from their kept flows, where the raw flows are gone."""
    zero = zero_flow()
    flows = F.when(F.size("flows") > 0, F.col("flows")).otherwise(F.array(zero))
    start = F.col("start_ts") if "start_ts" in sessions.columns else F.lit(0.0)
    duration = _total(_values("duration", flows))
    mean_iat, std_iat = _mean(_values("iat", flows)), _std(_values("iat", flows))
    columns = {
        "num_flows": F.size("flows").cast("bigint"), "duration": duration,
        "start_ts": start, "end_ts": start + duration,
        "total_orig_bytes": _total(_values("orig_bytes", flows)), "total_resp_bytes": _total(_values("resp_bytes", flows)),
        "total_orig_pkts": _total(_values("orig_pkts", flows)), "total_resp_pkts": _total(_values("resp_pkts", flows)),
        "mean_iat": mean_iat, "std_iat": std_iat, "cv_iat": S.ratio_or_zero(std_iat, mean_iat, S.EPS),
        "mean_bytes_per_pkt": _mean(_values("bytes_per_pkt", flows)),
        "mean_packet_ratio": _mean(_values("packet_ratio", flows)),
        "mean_byte_ratio": _mean(_values("byte_ratio", flows)),
        "dest_id": F.concat(F.lit("dest_port_"), _median(_values("dst_port", flows)).cast("bigint").cast("string")),
        "protocol": F.lit("tcp"),
    }
    passed = [c for c in ("session_id", "host_id", "label", "source", "capture_id", "split") if c in sessions.columns]
    return sessions.select(*passed, *[v.alias(k) for k, v in columns.items()])


def zero_flow() -> Column:
    return F.struct(*[F.lit(0.0).alias(f) for f in FEATURES])


def to_padded(sessions: DataFrame, length: int = SESSION_LEN) -> DataFrame:
    """Fixed-length export form: zero rows behind the real ones, ``mask`` true for real rows."""
    slots = F.sequence(F.lit(1), F.lit(length))
    out = sessions.withColumn("n_flows", F.size("flows")).withColumn("mask", F.transform(slots, lambda i: i <= F.col("n_flows")))
    return out.withColumn("flows", F.slice(F.concat("flows", F.array_repeat(zero_flow(), length)), 1, length))


def repair_mask(df: DataFrame) -> DataFrame:
    """Imported fixed-length arrays: make ``mask`` true for real rows, whichever way it was stored."""
    real = F.transform("flows", lambda x: F.array_contains(F.array(*[x[f] != 0 for f in FEATURES]), True))
    if "mask" not in df.columns:
        return df.withColumn("mask", real)
    agree = F.aggregate(F.zip_with("mask", real, lambda a, b: (a == b).cast("bigint")), F.lit(0).cast("bigint"),
                        lambda s, v: s + v)
    fit = df.agg(F.sum(agree).alias("same"), F.sum(F.size("mask")).alias("all")).first()
    inverted = fit["all"] is not None and 2 * fit["same"] < fit["all"]
    return df.withColumn("mask", F.transform("mask", lambda m: ~m)) if inverted else df


def with_session_deltas(sessions: DataFrame) -> DataFrame:
    """Add the change of gap and of sent bytes to the flow before it to every kept flow."""
    def step(x: Column, i: Column, feature: str) -> Column:
        before = F.get(F.col("flows"), i - 1)[feature]
        return F.when(i > 0, x[feature] - before).otherwise(F.lit(0.0))

    return sessions.withColumn("flows", F.transform("flows", lambda x, i: F.struct(
        *[x[f].alias(f) for f in FEATURES],
        step(x, i, "iat").alias("iat_delta"), step(x, i, "orig_bytes").alias("byte_delta"))))
