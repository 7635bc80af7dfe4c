"""Feature transforms of stored sessions: log scaling, ablation, normalisation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hostwatch.config import FEATURES, LOG_SCALED
from hostwatch.functions import scalars as S
from hostwatch.operators.sessions import min_flows as at_least
from hostwatch.operators.splits import random_stratified


def parse_features(text: str | None) -> tuple[str, ...]:
    """Comma-separated feature list."""
    return tuple(p.strip() for p in (text or "").split(",") if p.strip())


@dataclass(frozen=True)
class TransformConfig:
    log_scale: tuple[str, ...] = LOG_SCALED
    ablate: tuple[str, ...] = ()

    def __post_init__(self):
        unknown = [f for f in self.log_scale + self.ablate if f not in FEATURES]
        if unknown:
            raise ValueError(f"unknown features: {unknown}")

    def apply(self, feature: str, value: Column) -> Column:
        if feature in self.ablate:
            return F.lit(0.0)
        return S.signed_log(value) if feature in self.log_scale else value


def map_flows(sessions: DataFrame, change: Callable[[str, Column], Column]) -> DataFrame:
    """Rewrite every feature of every kept flow in place."""
    return sessions.withColumn("flows", F.transform("flows", lambda x: F.struct(*[change(f, x[f]).alias(f) for f in FEATURES])))


def apply_transforms(sessions: DataFrame, cfg: TransformConfig = TransformConfig()) -> DataFrame:
    return map_flows(sessions, cfg.apply)


def transform_columns(flows: DataFrame, cfg: TransformConfig = TransformConfig()) -> DataFrame:
    """The same on a table with one flow per row."""
    return flows.withColumns({f: cfg.apply(f, F.col(f)) for f in FEATURES if f in flows.columns})


def real_flows(sessions: DataFrame, *keep: str) -> DataFrame:
    """One row per kept flow."""
    return sessions.select(*keep, F.inline("flows"))


def fit_normalizer(sessions: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One row with mean and population deviation of every feature (deviation 1 where it is below ``eps``)."""
    stats = real_flows(sessions).agg(F.count(F.lit(1)).alias("n_flows"), *[
        e for f in FEATURES for e in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))])
    return stats.withColumns({f"{f}_std": F.when(F.col(f"{f}_std") < eps, 1.0).otherwise(F.col(f"{f}_std"))
                              for f in FEATURES})


def apply_normalizer(sessions: DataFrame, stats: DataFrame) -> DataFrame:
    """Scale with fitted statistics (one row of parameters, read by the driver)."""
    row = stats.first()
    if row is None or row["orig_bytes_mean"] is None:
        raise ValueError("cannot normalise: no flows to fit on")
    return map_flows(sessions, lambda f, x: (x - F.lit(row[f"{f}_mean"])) / F.lit(row[f"{f}_std"]))


def prepare(sessions: DataFrame, cfg: TransformConfig = TransformConfig(), min_flows: int = 5, seed: int = 42,
            sample_id: str = "sample_id", normalize: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Split, transform, and normalise all splits with statistics of the training part."""
    split = random_stratified(at_least(sessions, min_flows), seed=seed, sample_id=sample_id)
    changed = apply_transforms(split, cfg)
    if not normalize:
        return changed, None
    stats = fit_normalizer(changed.filter(F.col("split") == "train"))
    return apply_normalizer(changed, stats), stats
