"""Frames that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwatch.operators import flows as FL, sessions as SS, timeline as TL
from hostwatch.operators.flows import inter_arrival
from hostwatch.operators.ordered import KeyedRows
from hostwatch.config import FLOW_KEY, FLOW_ORDER
from hostwatch.sources import tables as T


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw_flows_from_events(spark, sf)


def ratios(spark: SparkSession, sf: str) -> DataFrame:
    return FL.with_direction(FL.derive_ratios(raw(spark, sf)))


def rows(spark: SparkSession, sf: str) -> KeyedRows:
    """Flows in key order; the key counts are taken once for all windows."""
    return KeyedRows.plan(FL.drop_unusable(ratios(spark, sf)), FLOW_KEY, FLOW_ORDER)


def flows(spark: SparkSession, sf: str) -> DataFrame:
    return inter_arrival(rows(spark, sf)).done()


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return SS.session_starts(inter_arrival(rows(spark, sf)), T.EVENT_TIMEOUT).done()


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return SS.summarize_tagged(tagged(spark, sf))


def sessions(spark: SparkSession, sf: str, min_flows: int = 1) -> DataFrame:
    return SS.build_sessions(T.flows_from_events(spark, sf), timeout=T.EVENT_TIMEOUT, min_flows=min_flows)


def limited(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions over the ordered feature matrix, every feature within its limits."""
    matrix = FL.feature_matrix(T.flows_from_events(spark, sf), keep=(*FL.ENDPOINTS, "flow_id", "label"))
    return SS.build_sessions(matrix, timeout=T.EVENT_TIMEOUT)


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions as a dataset with provenance."""
    return sessions(spark, sf).withColumns({"source": F.lit("unknown"), "capture_id": F.lit("events"), "sample_id": F.col("session_id")})


def numbered(spark: SparkSession, sf: str, order: str = "time") -> DataFrame:
    return TL.number_sessions(summaries(spark, sf), order)


def host_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return TL.build_host_sessions(TL.cut(summaries(spark, sf)))


def timelines(spark: SparkSession, sf: str) -> TL.Timelines:
    return TL.build_timelines(summaries(spark, sf))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round all doubles, so that results do not depend on the order of summation."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
