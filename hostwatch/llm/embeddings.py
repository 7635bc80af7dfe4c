"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one representative per group.

Centroids are fitted on a bounded sample.  Every vector belongs to the cell of its nearest centroid.  Two unit vectors of
cosine ``c`` or more lie at most ``sqrt(2 - 2c)`` apart, so if they belong to different cells, at least one of them is within half of that of the
plane between the two centroids; such a vector is a guest in the other cell, and every link meets in some cell.
Cells above ``BLOCK`` vectors are cut into blocks, and each pair of blocks is one piece of work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwatch.llm.common import components, cut

#: Vectors that centroids are fitted on at most, cells at most, and vectors per cell that are aimed at.
SAMPLE, CELLS, PER_CELL = 16_384, 1024, 2048
#: Vectors of a block; a product of two blocks is one task's matrix.
BLOCK = 2048
ROUNDS = 10


def spherical_kmeans(units: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit length; the first ones are rows spread evenly over the sample."""
    centroids = units[np.linspace(0, len(units) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        norms = np.linalg.norm(sums, axis=1)
        centroids[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centroids


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(vector) -> "F.Column":
    """A vector that can link: there is one, its components are finite numbers, and not all are zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _assigned(distinct: DataFrame, centroids: np.ndarray, cosine: float) -> DataFrame:
    """Each vector once for its own cell and once for every cell it is a guest in: ``label, dims, cell, home, id, copies, vector``."""
    reach = np.sqrt(2 - 2 * cosine) / 2 + 1e-9
    gaps = np.linalg.norm(centroids[:, None] - centroids[None], axis=2)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lengths = np.diff(part.column(4).offsets.to_numpy())
                rows, cells, homes = [], [], []
                for dims in np.unique(lengths):
                    of = np.flatnonzero(lengths == dims)
                    if dims != centroids.shape[1]:  # other lengths have one cell
                        rows.append(of), cells.append(np.zeros(len(of), np.int64)), homes.append(np.zeros(len(of), np.int64))
                        continue
                    sims = _units(_matrix(part.column(4).take(pa.array(of)))) @ centroids.T
                    home = sims.argmax(axis=1)
                    margin = sims[np.arange(len(of)), home][:, None] - sims
                    member = margin <= reach * gaps[home]
                    member[np.arange(len(of)), home] = True
                    r, c = np.nonzero(member)
                    rows.append(of[r]), cells.append(c), homes.append(home[r])
                rows = np.concatenate(rows)
                t = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(lengths[rows].astype(np.int64)), pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes)),
                                                  t.column(1), t.column(2), t.column(4)], names=["label", "dims", "cell", "home", "id", "copies", "vector"])

    return distinct.select("label", "id", "copies", F.size("vector").alias("n"), "vector").mapInArrow(
        run, f"label {distinct.schema['label'].dataType.simpleString()}, dims long, cell long, home long, id long, copies long, vector array<double>")


def _compare(cosine: float):
    """Links of one pair of blocks of a cell: per vector how many it has there, and one edge that ties it to its group there.

    A pair of vectors counts in one cell only: in the lower of their homes where both meet there, else in the home where
    they do; ``met`` lists the cells that a vector is in.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        home, side, cell = table.column("home").to_numpy(), table.column("side").to_numpy(), int(table.column("cell")[0].as_py())
        one = bool(table.column("one")[0].as_py())
        lower_homes = np.unique(home[home < cell])
        met = table.column("met").combine_chunks()
        present = np.zeros((len(ids), len(lower_homes) + 1), bool)
        flat, of = met.flatten().to_numpy(), np.repeat(np.arange(len(ids)), met.value_lengths().to_numpy())
        known = np.isin(flat, lower_homes)
        present[of[known], np.searchsorted(lower_homes, flat[known])] = True
        x = _units(_matrix(table.column("vector")))
        left = np.arange(len(ids)) if one else np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        links = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        for at in range(0, len(left), 512):
            rows = left[at:at + 512]
            a, b = np.nonzero(x[rows] @ x[right].T >= cosine)
            a, b = rows[a], right[b]
            keep = ids[a] != ids[b]
            if one:
                keep &= a < b
            a, b = a[keep], b[keep]
            if not a.size:
                continue
            mine = (home[a] == cell) | (home[b] == cell)
            other = np.where(home[a] == cell, home[b], home[a])
            lower = np.searchsorted(lower_homes, np.minimum(other, cell - 1)) if len(lower_homes) else np.zeros(len(a), int)
            mine &= ~((other < cell) & present[a, lower] & present[b, lower])
            a, b = a[mine], b[mine]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            while a.size:
                u, v = label[a], label[b]
                apart = u != v
                a, b, u, v = a[apart], b[apart], u[apart], v[apart]
                np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
                while not np.array_equal(label, higher := label[label]):
                    label = higher
        has = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[has]), "links": pa.array(links[has]), "to": pa.array(ids[label[has]])})
    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id, embedding, label; more columns are ignored).

    Rows link if their labels are equal and the cosine of their vectors, in double precision, is at least ``cosine``.  Null vectors,
    those with null or not finite components, empty and zero vectors link with nothing, nor do rows with a null label, nor
    vectors of different lengths.  Rows with a null ``vec_id`` take no part: no links, null component, not kept.  Equal vectors
    of a label are compared once and counted by their number; one row of each component, its smallest id, is kept.
    Rows that share a ``vec_id`` but not the vector do not link to each other.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select("vec_id", F.expr("transform(embedding, x -> cast(x AS double))").alias("vector"), "label")
               .withColumn("usable", usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
    distinct = cut(rows.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    n = distinct.count()
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if n == 0:
        return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    share = min(1.0, sample / n)
    fitted = distinct.where(F.pmod(F.xxhash64("id", "label"), F.lit(1 << 20)) < int(share * (1 << 20))).select("vector").limit(2 * sample).toArrow()
    fitted = fitted if fitted.num_rows else distinct.select("vector").limit(1).toArrow()
    lengths = fitted.column("vector").combine_chunks().value_lengths().to_numpy()
    dims = int(np.bincount(lengths).argmax())
    units = _units(_matrix(fitted.column("vector").filter(pa.array(lengths == dims))))
    centroids = spherical_kmeans(units, max(1, min(CELLS, n // per_cell, len(units))))
    placed = cut(_assigned(distinct, centroids, cosine))
    cell = ["label", "dims", "cell"]
    blocks = F.ceil(F.count("*") / block).cast("long")
    sizes = placed.groupBy(*cell).agg(blocks.alias("blocks"))
    met = placed.groupBy("label", "id").agg(F.collect_list("cell").alias("met"))
    dealt = (placed.join(sizes, cell).join(met, ["label", "id"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select(*cell, "home", "id", "copies", "vector", "met", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("one")))
    found = cut(dealt.groupBy(*cell, "low", "high").applyInArrow(_compare(cosine), "id long, links long, to long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = (distinct.select("label", F.col("vector"), "id", "copies").join(links, "id", "left").join(group.withColumnRenamed("node", "id"), "id", "left")
             .select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    linked = rows.where("usable").join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
