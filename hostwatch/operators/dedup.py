"""Content overlap between datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hostwatch.config import SKEW, SkewConfig
from hostwatch.operators.lineage import cut
from hostwatch.operators.ordered import SENT_KEYS

SALTS = 64


def content_hash(columns: Sequence[str | Column]) -> Column:
    """Hash of the given columns; arrays and structs are taken as JSON."""
    return F.md5(F.to_json(F.struct(*columns)))


def overlap(candidate: DataFrame, corpus: DataFrame, key: str = "content") -> DataFrame:
    """How many candidate rows also occur in the corpus.  Both sides are reduced to distinct content first."""
    copies = candidate.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = corpus.groupBy(key).agg(F.lit(True).alias("known"))
    hit = F.coalesce(F.col("known"), F.lit(False))
    out = copies.join(known, key, "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("shared"))
    return out.withColumn("rate", F.when(F.col("candidates") > 0, F.col("shared") / F.col("candidates")).otherwise(0.0))


def unseen(candidate: DataFrame, corpus: DataFrame, key: str = "content", skew: SkewConfig = SKEW) -> DataFrame:
    """Candidate rows whose content does not occur in the corpus.

    Content with very many copies is spread over salts; the corpus side, reduced to distinct content, is
    repeated for those only.
    """
    known = corpus.select(key).distinct()
    hot = (candidate.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > skew.hot_rows)
           .select(key, F.lit(True).alias("_hot")))
    marks = cut(hot)
    if marks.isEmpty():
        return candidate.join(known, key, "left_anti")
    if marks.count() <= SENT_KEYS:
        marks = F.broadcast(marks)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in candidate.columns]), F.lit(SALTS))
    left = candidate.join(marks, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0)).cast("int"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = known.join(marks, key, "left").select(key, F.explode(salts).alias("_salt"))
    return left.join(right, [key, "_salt"], "left_anti").drop("_salt", "_hot")
