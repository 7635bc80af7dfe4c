"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next stage's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm import mixing, packing, pii, quality, shingles
from hostwatch.llm.common import shared_path, table
from hostwatch.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within what their language's trusted documents show; null and empty texts pass."""
    return quality.keep_good(docs.select(*pii.DOCUMENTS), table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest ``doc_id`` of each group of near-duplicates: candidates by SimHash links and MinHash bands over five-word
    shingles, of which a similarity of 0.8 or more decides.

    Of rows that share a ``doc_id`` one is kept; rows without one are not told apart and go.
    """
    groups = shingles.near_duplicates(docs)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    rest = [c for c in pii.DOCUMENTS if c != "doc_id"]
    return (docs.join(kept.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
            .select("doc_id", *[F.col(f"row.{c}").alias(c) for c in rest]))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data in its text put as its kind in brackets."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; ids are those of the stage before, one row each."""
    taken = mixing.mix(docs).where("copies > 0").select("doc_id", "copies")
    return docs.join(taken.hint("merge"), "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*pii.DOCUMENTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return packing.pack(docs, tokenizer())


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("personal_data", without_personal_data), ("mix", mixed), ("pack", packed)]

#: Model scores, fingerprints and sequences can't be expressed in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
