"""Session datasets, timelines, reports and models on storage."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hostwatch.config import DATASET_SOURCES, FEATURES, SESSION_LEN, TimelineConfig
from hostwatch.functions import labels as L
from hostwatch.operators import timeline as TL
from hostwatch.operators.flows import require_columns
from hostwatch.operators.sessions import with_host_key

ALIASES = {"flows": ("flows", "X", "sessions"), "label": ("label", "y", "labels")}


def write_sessions(df: DataFrame, path: str, partition_by: Sequence[str] = ("split",)) -> None:
    parts = [c for c in partition_by if c in df.columns]
    df.write.mode("overwrite").partitionBy(*parts).parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Stored sessions; the feature layout and session length are checked."""
    df = spark.read.parquet(path)
    for name, group in ALIASES.items():
        present = next((a for a in group if a in df.columns), None)
        if present is None:
            raise ValueError(f"session dataset needs a column of {group}, found {df.columns}")
        df = df.withColumnRenamed(present, name)
    kind = df.schema["flows"].dataType
    names = tuple(kind.elementType.names) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else ()
    if names != FEATURES:
        raise ValueError(f"feature layout differs: expected {FEATURES}, got {names}")
    long = F.raise_error(F.concat(F.lit(f"session longer than {SESSION_LEN} flows: "), F.size("flows").cast("string")))
    return df.withColumn("flows", F.when(F.size("flows") <= SESSION_LEN, F.col("flows")).otherwise(long.cast(kind)))


@dataclass(frozen=True)
class SourceSpec:
    path: str
    source: str
    label_type: str


def parse_source_spec(spec: str) -> SourceSpec:
    """``path:source:type``; the path may itself hold colons."""
    parts = spec.rsplit(":", 2)
    if len(parts) != 3:
        raise ValueError(f"invalid source spec {spec!r}: expected path:source:type")
    path, source, kind = parts[0], parts[1].lower(), parts[2].lower()
    if kind not in ("c2", "benign", "mixed"):
        raise ValueError(f"invalid label type {kind!r}: expected c2, benign or mixed")
    return SourceSpec(path, source if source in DATASET_SOURCES else "unknown", kind)


def with_provenance(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Label override, source, capture, family of positives and host key of one source."""
    if spec.label_type != "mixed":
        df = df.withColumn("label", F.lit(1 if spec.label_type == "c2" else 0))
    family = F.when(F.col("label") == 1, L.family_from_path(F.lit(spec.path))).otherwise("")
    df = df.withColumns({"source": F.lit(spec.source), "capture_id": F.lit(os.path.basename(spec.path.rstrip("/"))), "c2_family": family})
    keyed = with_host_key(df) if "host_id" not in df.columns else df
    own = F.col("session_id") if "session_id" in df.columns else F.md5(F.to_json(F.struct("flows")))
    return keyed.withColumn("sample_id", F.md5(F.concat_ws("|", F.lit(spec.path), own)))


def read_multi_source(spark: SparkSession, specs: Sequence[str]) -> DataFrame:
    """All sources as one table with provenance."""
    parts = [with_provenance(read_sessions(spark, s.path), s) for s in map(parse_source_spec, specs)]
    if not parts:
        raise ValueError("no source given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_timelines(tl: TL.Timelines, path: str) -> TL.Timelines:
    """Write the three tables.  Partners and profiles are derived from the written host sessions."""
    spark = tl.host_sessions.sparkSession
    tl.host_sessions.write.mode("overwrite").parquet(f"{path}/host_sessions")
    stored = TL.timelines_from(spark.read.parquet(f"{path}/host_sessions"), tl.config, tl.keys)
    stored.host_partners.write.mode("overwrite").parquet(f"{path}/host_partners")
    partners = spark.read.parquet(f"{path}/host_partners")
    TL.profile_of(stored.host_sessions, partners, tl.config, tl.keys).write.mode("overwrite").parquet(f"{path}/host_profile")
    return read_timelines(spark, path, tl.config, tl.keys)


def read_timelines(spark: SparkSession, path: str, cfg: TimelineConfig = TimelineConfig(), keys: Sequence[str] = TL.HOST) -> TL.Timelines:
    return TL.Timelines(*[spark.read.parquet(f"{path}/{t}") for t in ("host_sessions", "host_partners", "host_profile")],
                        config=cfg, keys=tuple(keys))


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)


def save_model(model, operating_point: DataFrame, path: str) -> None:
    """Fitted pipeline and its operating point (threshold, budget, normaliser, transforms)."""
    model.write().overwrite().save(f"{path}/model")
    operating_point.write.mode("overwrite").parquet(f"{path}/operating_point")


def load_model(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    point = spark.read.parquet(f"{path}/operating_point")
    require_columns(point, ("threshold",), "operating point")
    return PipelineModel.load(f"{path}/model"), point
