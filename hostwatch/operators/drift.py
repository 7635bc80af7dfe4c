"""Feature drift between two session datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostwatch.config import FEATURES
from hostwatch.operators.lineage import cut
from hostwatch.operators.rank import column_quantiles
from hostwatch.operators.sessions import min_flows as at_least
from hostwatch.operators.transforms import real_flows

EPS = 1e-9


def _moments(flows: DataFrame, side: str) -> DataFrame:
    """One pass over the wide table, then one row per feature."""
    wide = flows.agg(*[e for f in FEATURES for e in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_mean").alias(f"{side}_mean"),
                              F.col(f"{f}_std").alias(f"{side}_std")) for f in FEATURES])
    return wide.select(F.inline(rows))


SIDES = ("source", "target")


def _exact_quantiles(both: DataFrame) -> DataFrame:
    """Median and 95th percentile of every feature on both sides, from one table of the flows of both."""
    found = column_quantiles(both, FEATURES, {"median": 0.5, "p95": 0.95}, by="side")
    return found.groupBy(F.col("column").alias("feature")).agg(*[F.max(F.when((F.col("side") == s) & (F.col("quantile") == q), F.col("value"))).alias(f"{s}_{q}")
                                                               for s in SIDES for q in ("median", "p95")])


def _approximate_quantiles(flows: DataFrame, side: str) -> DataFrame:
    wide = flows.agg(*[F.percentile_approx(f, [0.5, 0.95], 100_000).alias(f) for f in FEATURES])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f)[0].alias(f"{side}_median"),
                                                   F.col(f)[1].alias(f"{side}_p95")) for f in FEATURES])))


def standardized_shift(source_mean: Column, target_mean: Column, source_std: Column, target_std: Column) -> Column:
    pooled = F.sqrt((source_std * source_std + target_std * target_std) / 2.0) + F.lit(EPS)
    return F.abs(target_mean - source_mean) / pooled


def median_ratio(source: Column, target: Column) -> Column:
    base = source + F.lit(EPS)
    return (target + F.lit(EPS)) / F.when(F.abs(base) > EPS, F.abs(base)).otherwise(F.lit(EPS))


def flow_drift(source: DataFrame, target: DataFrame, exact: bool = True) -> DataFrame:
    """Per feature: moments, median and 95th percentile on both sides, and how far they moved.

    ``exact=False`` takes approximate quantiles in the same single pass as the moments.
    """
    if exact:  # read several times
        both = cut(source.select(F.lit("source").alias("side"), *FEATURES).unionByName(target.select(F.lit("target").alias("side"), *FEATURES)))
        source, target = (both.filter(F.col("side") == s) for s in SIDES)
    out = _moments(source, "source").join(_moments(target, "target"), "feature")
    if exact:
        out = out.join(_exact_quantiles(both), "feature")
    else:
        for flows, side in ((source, "source"), (target, "target")):
            out = out.join(_approximate_quantiles(flows, side), "feature")
    return out.withColumns({
        "standardized_mean_shift": standardized_shift(*[F.col(c) for c in ("source_mean", "target_mean", "source_std", "target_std")]),
        "median_ratio": median_ratio(F.col("source_median"), F.col("target_median"))})


def feature_drift(source: DataFrame, target: DataFrame, min_flows: int = 5, exact: bool = True) -> DataFrame:
    """Drift between two stored session sets, over the kept flows of sessions that are long enough."""
    return flow_drift(real_flows(at_least(source, min_flows)), real_flows(at_least(target, min_flows)), exact)


def top_drift(df: DataFrame, k: int = 12) -> DataFrame:
    return df.orderBy(F.desc("standardized_mean_shift"), "feature").limit(k)
