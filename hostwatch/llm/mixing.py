"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's target over its source's size.  Documents
of a source stand in order of size; their expected copies are summed up, one random offset of the source is added, and
a document is taken once per integer that its step crosses.  The order by size makes the words taken come near the
target, as every stretch of sizes gives its share.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostwatch.llm.common import cut

#: Weights by the rank of a source's name, repeating; words wanted and words of a source at most, as multiples of sizes.
WEIGHTS = (5, 2, 1)
TOTAL, MOST = 1.5, 2

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _in_order(batches):
    """Number the rows of each source of a sorted partition from 1 (``place``), and name the partition (``part``)."""
    from pyspark import TaskContext

    part, last, count = TaskContext.get().partitionId(), (), 0
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        names, place = batch.column("source").to_pylist(), []
        for name in names:
            count = count + 1 if (name,) == last else 1
            last = (name,)
            place.append(count)
        yield batch.append_column("place", pa.array(place, pa.int64())).append_column("part", pa.array([part] * n, pa.int64()))


def _ranked(names: DataFrame) -> DataFrame:
    """The rank (from 0) of each of the given sources by code point, null last."""
    key = F.col("name").asc_nulls_last()
    numbered = cut(names.select(F.lit("").alias("source"), F.col("source").alias("name")).repartitionByRange(key).sortWithinPartitions(key)
                   .mapInArrow(_in_order, "source string, name string, place long, part long"))
    counts = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("part").alias("in_part"), F.coalesce(F.sum("n").over(  # a row per task
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(before, F.col("part") == F.col("in_part")).select("name", (F.col("place") - 1 + F.col("before")).alias("rank"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """One row per source: ``source, source_size, target``, from rows of ``source, size``.

    The wanted words are shared by weight; a source gets ``most`` times its size at the most, and what is above is shared
    among the others by weight until none is above.  The level (words per weight) only rises while sources fill up, so
    each turn is one aggregate over the table of sources, and the last turn changes nothing.
    """
    per_source = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = cut(per_source.join(_ranked(per_source.select("source")).select("name", weight.alias("weight")),
                                   F.col("source").eqNullSafe(F.col("name"))).drop("name"))
    wanted = total * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    level, cap = 0.0, most * F.col("source_size")
    while True:
        full = cap <= level * F.col("weight")
        filled, open_weight = weighted.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (wanted - (filled or 0)) / open_weight if open_weight else level
        if higher <= level:
            break
        level = higher
    target = F.when(cap <= level * F.col("weight"), cap.cast("double")).otherwise(level * F.col("weight"))
    return weighted.select("source", "source_size", target.cast("double").alias("target"))


def _offset(source: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1): a hash of its name, so that reruns agree."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x01")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: int = 7) -> DataFrame:
    """How often each of ``docs`` (doc_id, text, source; more columns are ignored) is taken.

    Returns ``doc_id, size, source, source_size, target, copies, taken`` with one row per row of ``docs``.  Null texts and
    texts without words have size 0 (they may be taken, at no words).  A null source is a source, the last one.  Rows
    with equal source, size and doc_id (repeated or null ids) are alike, and any of them may be the one taken.
    """
    keys = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last()]
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    placed = cut(sized.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .mapInArrow(_in_order, "doc_id long, source string, size long, place long, part long"))
    per_source = targets(placed, weights, total, most)
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("n"))
    behind = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select("source", "part", F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("before"))  # a row per source and task
    parts = parts.alias("p").join(per_source.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        F.col("p.source").alias("name"), F.col("part").alias("in_part"), "before", "source_size", "target", _offset(F.col("p.source"), seed).alias("u"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = (F.col("before") + F.col("place")).cast("double")
    copies = F.least(F.floor(rate * rank + F.col("u")) - F.floor(rate * (rank - 1) + F.col("u")), F.ceil(rate)).cast("long")
    return (placed.join(parts, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("name")))
            .select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"))
            .withColumn("taken", F.col("copies") * F.col("size")))
