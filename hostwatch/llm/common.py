"""What the operators share: tables, fixed places in the shared folder, connected components."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.operators.lineage import cut, shared_folder

__all__ = ["components", "cut", "shared_path", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, seen by the driver and all executors."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cut like a checkpoint, but of known size, so that plans of many
    rounds stay small and small sides are recognised."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): one row (node, component) per node with an edge.

    Each round points every node to its smallest neighbour, follows the pointers to their ends, and keeps the edges between
    the ends; as pointers only go down, the last one standing is the smallest node of its component.  A round at
    least halves what is left of a component.  Pointers of all rounds are then followed from the last one back.
    Edges with a null end are ignored, repeated edges and loops do no harm.
    """
    left = stored(edges.select("a", "b").where("a != b").distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        to = both.select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        to = stored(to)
        while True:  # to the end of the chain: each turn doubles the steps that are taken
            jumped = stored(to.join(to.toDF("to", "next"), "to").select("node", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")))
            to = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        rounds.append(to)
        a, b = to.toDF("a", "x"), to.toDF("b", "y")
        left = stored(left.join(a, "a").join(b, "b").where("x != y")
                      .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return edges.selectExpr("a AS node", "a AS component").where("false")
    found = rounds[-1].toDF("node", "component")
    for to in reversed(rounds[:-1]):
        last = found.toDF("to", "component")
        found = to.join(last, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return found
