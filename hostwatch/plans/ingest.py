"""From log files to flows, sessions and timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwatch.config import FLOW_KEY, FLOW_ORDER, INACTIVITY_TIMEOUT, SKEW, SkewConfig, TimelineConfig
from hostwatch.functions.labels import base_name, label_from_text
from hostwatch.operators import flows as FL, sessions as SS, timeline as TL
from hostwatch.operators.ordered import KeyedRows
from hostwatch.sources import delimited, zeek

META = FL.ENDPOINTS + ("flow_id",)


def _features(flows: DataFrame, clip: bool, keep: Sequence[str] = (), keys: Sequence[str] = FLOW_KEY,
              skew: SkewConfig | None = SKEW) -> DataFrame:
    """Ratios, direction and inter-arrival times of cleaned flows, as an ordered feature table."""
    df = FL.with_direction(FL.derive_ratios(flows))
    df = FL.inter_arrival(KeyedRows.plan(df, keys, FLOW_ORDER, skew=skew)).done()
    extra = [c for c in keep if c in df.columns]
    return FL.feature_matrix(df, clip, META + tuple(extra) + ("iat_delta", "byte_delta"))


def _zeek_flows(rows: DataFrame) -> DataFrame:
    """Canonical columns of Zeek rows; an unreadable time counts as 0, as the log reader defines it."""
    df = rows.withColumn("flow_id", FL.row_identity(rows))
    df = FL.canonical_names(df.withColumn("ts", FL.S.to_number("ts")))
    df = df.withColumn("proto", F.lower("proto"))
    return FL.clean_flows(FL.drop_unusable(df))


def zeek_to_flows(spark: SparkSession, paths: Sequence[str], clip: bool = True, skew: SkewConfig | None = SKEW) -> DataFrame:
    """Zeek logs to flow features."""
    return _features(_zeek_flows(zeek.read_zeek(spark, paths).rows), clip, ("source_file", "uid"), skew=skew)


def binetflow_to_flows(spark: SparkSession, paths: Sequence[str], clip: bool = False, skew: SkewConfig | None = SKEW) -> DataFrame:
    """Argus exports to labelled flow features."""
    raw = delimited.read_binetflow(spark, paths)
    df = FL.standardize_flows(raw.withColumn("flow_id", FL.row_identity(raw)))
    df = df.withColumn("label", label_from_text("label_text", "v1"))
    return _features(FL.clean_flows(df, drop_empty=False), clip, ("label", "source_file"), skew=skew)


def binetflow_to_sessions(spark: SparkSession, paths: Sequence[str], timeout: float = INACTIVITY_TIMEOUT, min_flows: int = 1,
                          skew: SkewConfig | None = SKEW) -> DataFrame:
    return _some(SS.build_sessions(binetflow_to_flows(spark, paths, skew=skew), timeout=timeout, min_flows=min_flows, skew=skew))


def labelled_tree_to_flows(spark: SparkSession, root: str, skew: SkewConfig | None = SKEW) -> tuple[DataFrame, DataFrame]:
    """Labelled directory tree to flows; also the files that could not be read.

    Windows run per file for inter-arrival times, as each file is one capture.
    """
    found = zeek.read_labelled_zeek(spark, root)
    flows = _features(_zeek_flows(found.rows), True, ("label", "capture_id", "source", "source_file", "uid"), ("source_file",) + FLOW_KEY, skew)
    return flows, found.rejected


def labelled_tree_to_sessions(spark: SparkSession, root: str, min_flows: int = 3, timeout: float = INACTIVITY_TIMEOUT,
                              skew: SkewConfig | None = SKEW) -> DataFrame:
    """Sessions of each class over all its files."""
    flows, _ = labelled_tree_to_flows(spark, root, skew)
    flows = flows.withColumn("class", F.col("label"))
    return _some(SS.build_sessions(flows, timeout=timeout, min_flows=min_flows, extra_keys=("class",), carry=("source", "capture_id"), skew=skew)
                 .withColumn("shuffle_key", F.md5("session_id")))


def mixed_to_sessions(spark: SparkSession, c2_inputs: Sequence[str] = (), benign_inputs: Sequence[str] = (), min_flows: int = 5,
                      timeout: float = INACTIVITY_TIMEOUT, skew: SkewConfig | None = SKEW) -> DataFrame:
    """Flow files of any supported format to labelled sessions; every file is its own capture.

    Inputs are files, folders or glob patterns.  The plan has a branch per layout of the files, not per file.
    """
    if not c2_inputs and not benign_inputs:
        raise ValueError("give at least one input file")
    parts: dict[str, list[DataFrame]] = {"zeek": [], "other": []}
    for label, paths in ((1, c2_inputs), (0, benign_inputs)):
        for kind, raw in delimited.read_flow_files(spark, paths):
            if kind == "zeek":
                df = _zeek_flows(raw)
            else:
                df = FL.standardize_flows(raw.withColumn("flow_id", FL.row_identity(raw)))
                df = FL.clean_flows(df, pkt_floor=1.0, drop_empty=False)
            keep = [*META, "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "src_port", "dst_port"]
            df = df.select(*keep, F.lit(label).alias("label"), base_name("source_file").alias("capture_id"))
            parts["zeek" if kind == "zeek" else "other"].append(df)
    flows = None
    for kind, frames in parts.items():
        if not frames:
            continue
        union = frames[0]
        for f in frames[1:]:
            union = union.unionByName(f)
        part = _features(union, kind == "zeek", ("label", "capture_id"), ("capture_id",) + FLOW_KEY, skew)
        flows = part if flows is None else flows.unionByName(part)
    return _some(SS.build_sessions(flows, timeout=timeout, min_flows=min_flows, extra_keys=("capture_id",), skew=skew)
                 .withColumn("shuffle_key", F.md5("session_id")))


def flows_to_timelines(flows: DataFrame, timeout: float = INACTIVITY_TIMEOUT, min_flows: int = 1, cfg: TimelineConfig = TimelineConfig(),
                       order: str = "time", label_col: str | None = "label", skew: SkewConfig | None = SKEW) -> TL.Timelines:
    """Flows with real addresses to host timelines."""
    FL.require_columns(flows, FL.ENDPOINTS, "flow table")
    return TL.build_timelines(SS.summarize_sessions(flows, label_col, timeout, min_flows, skew=skew), cfg, order, skew=skew)


def sessions_to_timelines(sessions: DataFrame, cfg: TimelineConfig = TimelineConfig(), order: str = "time",
                          keys: Sequence[str] = TL.HOST, skew: SkewConfig | None = SKEW) -> TL.Timelines:
    """Stored sessions (addresses gone) to host timelines, by the host key of the session."""
    return TL.build_timelines(SS.summarize_sequences(sessions), cfg, order, keys, skew)


def _some(sessions: DataFrame) -> DataFrame:
    if sessions.isEmpty():
        raise ValueError("no sessions built: check the input and min_flows")
    return sessions
