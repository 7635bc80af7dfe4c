"""Dataset builds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwatch.config import TEST_FRACTION, VAL_FRACTION, TimelineConfig
from hostwatch.operators import sampling as SA, splits as SP, timeline as TL
from hostwatch.operators.lineage import cut
from hostwatch.plans.ingest import sessions_to_timelines
from hostwatch.sources import datasets as DS


def build_dataset(spark: SparkSession, c2_path: str, benign_path: str, out: str, c2_ratio: float = 0.15, val: float = VAL_FRACTION,
                  seed: int = 42) -> DataFrame:
    """Mix stored positives and benign sessions to a ratio and split off validation."""
    c2 = DS.with_provenance(DS.read_sessions(spark, c2_path), DS.SourceSpec(c2_path, "unknown", "c2"))
    benign = DS.with_provenance(DS.read_sessions(spark, benign_path), DS.SourceSpec(benign_path, "unknown", "benign"))
    names = [c for c in c2.columns if c in benign.columns]
    mixed = SA.mix(c2.select(names), benign.select(names), c2_ratio, seed)
    DS.write_sessions(SP.stratified_two_way(mixed, val, seed), out)
    return spark.read.parquet(out)


def build_dataset_v2(spark: SparkSession, specs: Sequence[str], out: str, strategy: str = "family_separated", val: float = VAL_FRACTION,
                     test: float = TEST_FRACTION, seed: int = 42, c2_ratio: float | None = None, held_out_families: set[str] | None = None,
                     timelines: bool = True, cfg: TimelineConfig = TimelineConfig()) -> dict[str, str]:
    """Sources with provenance to split sessions, host timelines per split and a summary document."""
    sessions = DS.read_multi_source(spark, specs)
    if c2_ratio is not None:
        sessions = SA.rebalance(sessions, c2_ratio, seed)
    split = SP.split_sessions(sessions, strategy, val, test, seed, held_out_families)
    outputs = {"sessions": f"{out}/sessions", "metadata": f"{out}/split_metadata"}
    DS.write_sessions(split, outputs["sessions"])
    stored = spark.read.parquet(outputs["sessions"])
    summary = SP.split_summary(stored, strategy).withColumn("source_specs", F.array(*[F.lit(s) for s in specs]))
    hosts = SP.host_diversity(stored)
    if timelines:
        outputs["timelines"] = f"{out}/timelines"
        tl = DS.write_timelines(sessions_to_timelines(stored, cfg, keys=TL.SPLIT_HOST), outputs["timelines"])
        hosts = hosts.join(TL.timeline_summary(tl, by=("split",)), "split", "left")
    stats = hosts.agg(F.sort_array(F.collect_list(F.struct(*hosts.columns))).alias("host_stats"))
    DS.write_report(summary.join(stats, F.lit(True)), outputs["metadata"])
    return outputs
