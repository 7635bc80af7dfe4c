"""Exact top-k search by inner product over a pivot-distance index.

With one more component that makes all vectors equally long, the largest inner product is the smallest distance.  Every
vector is keyed by its nearest pivot and its distance to it; the distances of a pivot are cut into annuli, and an annulus
with many vectors into blocks.  A query first searches the block that its own vector lies in.  The k-th score found there gives a
distance beyond which nothing matters, and by the triangle inequality only annuli that reach into that distance from the
query's own distance to the pivot are searched; inside a block, only scores that reach the bound are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostwatch.llm.common import cut

#: Pivots at most, vectors per pivot that are aimed at, annuli of a pivot, vectors of a block and queries of a slab.
PIVOTS, PER_PIVOT, ANNULI, BLOCK, SLAB = 256, 4096, 64, 1024, 1024
#: Vectors that pivots are chosen from at most.
SAMPLE = 4096


def _matrix(column, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(kind).reshape(len(column), -1)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next one is the row farthest from all before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes all of them as long as the longest."""
    return np.c_[x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: in floating point only while every sum is below 2 to the 53rd."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2 ** 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def best(q_ids, q, bounds, ids, x, k: int):
    """(query row, candidate row, score) of each query's k highest scores at or above its bound, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    found = []
    for at in range(0, len(q), 256):
        scores = _scores(q[at:at + 256], x)
        fine = (scores >= bounds[at:at + 256, None]) & (ids[None] != q_ids[at:at + 256, None])
        row, col = np.nonzero(fine)
        value = scores[row, col]
        by = np.lexsort((col, -value, row))
        row, col, value = row[by], col[by], value[by]
        begin = np.searchsorted(row, row)
        top = np.arange(len(row)) - begin < k
        found.append((row[top] + at, order[col[top]], value[top]))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def _search(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        q_ids, ids = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
        q, c, s = best(q_ids, _matrix(queries.column("q"), np.int64), queries.column("bound").to_numpy(), ids, _matrix(vectors.column("x"), np.int64), k)
        return pa.table({"query_id": pa.array(q_ids[q]), "vec_id": pa.array(ids[c]), "score": pa.array(s)})
    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """The k highest inner products of each query with all other vectors: ``query_id, rank, vec_id, score``.

    ``vectors`` has vec_id and embedding (more columns are ignored); components become ``floor(scale * x)``.  Queries are the rows
    whose ``vec_id`` is divisible by ``every``.  Ties go to smaller ids; with fewer than k candidates all are given.  Null and
    empty vectors, those with null or not finite components and rows with a null id take no part, nor do vectors of another length than
    the most common one (of equally common ones the longest).  A ``vec_id`` counts once: of rows that share it one takes part.
    Scores have to fit into 64 bits.
    """
    fine = F.expr("vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(cast(x AS double)) < double('inf'))")
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.expr(f"transform(embedding, x -> floor({float(scale)!r}D * cast(x AS double)))").alias("x"))
    rows = cut(rows.groupBy("vec_id").agg(F.min("x").alias("x")))
    common = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == common.dims)
    square = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    longest = rows.agg(F.max(square)).first()[0]
    share = min(1.0, SAMPLE / common["count"])
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("x").limit(2 * SAMPLE).toArrow()
    sample = sample if sample.num_rows else rows.select("x").limit(1).toArrow()
    pivots = choose_pivots(_lifted(_matrix(sample.column("x")), longest), max(1, min(PIVOTS, common["count"] // PER_PIVOT)))
    width = max(2 * np.sqrt(longest) / ANNULI, 1e-9)

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                far = _distances(_lifted(_matrix(batch.column(1)), longest), pivots)
                pivot = far.argmin(axis=1)
                key = far[np.arange(len(far)), pivot]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot * (2 * ANNULI) + (key / width).astype(np.int64)), pa.array(key)], names=["vec_id", "x", "cell", "key"])

    index = cut(rows.mapInArrow(keyed, "vec_id long, x array<long>, cell long, key double"))
    # of equal vectors only the k + 1 smallest ids can be among anyone's k best
    first = F.row_number().over(Window.partitionBy("cell", "x").orderBy("vec_id"))
    stored = cut(index.withColumn("copy", first).where(F.col("copy") <= k + 1).drop("copy"))
    cells = stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("cell").toArrow()  # at most PIVOTS * 2 * ANNULI rows
    cell, low, high = (cells.column(c).to_numpy() for c in ("cell", "low", "high"))
    blocks = -(-cells.column("n").to_numpy() // BLOCK)
    block_of = F.expr("pmod(xxhash64(vec_id), blocks)")
    sizes = stored.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    queries = index.where(F.col("vec_id") % every == 0)
    asked = queries.count()
    slabs = max(1, -(-asked // SLAB))
    slab = F.pmod(F.xxhash64("query_id"), F.lit(slabs))
    stored = cut(stored.join(sizes, "cell").select("cell", block_of.alias("block"), "vec_id", "x")
                 .withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long")))))
    near = queries.join(sizes, "cell").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"), F.col("cell").alias("cell"), block_of.alias("block"),
                                              F.lit(-(1 << 63)).cast("long").alias("bound"))
    keys = ["cell", "block", "slab"]
    answer = "query_id long, vec_id long, score long"

    def search(asking: DataFrame) -> DataFrame:
        return asking.withColumn("slab", slab).groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(_search(k), answer)

    found = cut(search(near))
    bound = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    asking = near.drop("bound").join(bound, "query_id", "left").select(
        "query_id", "q", F.struct("cell", "block").alias("own"), F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-(1 << 63)).cast("long")).alias("bound"))

    def reached(batches):
        """Every block of every annulus that a query's bound reaches, nearest annulus first; its own block is done."""
        for batch in batches:
            if not batch.num_rows:
                continue
            q, bounds = _matrix(batch.column(1)), batch.column(3).to_numpy()
            own_cell, own_block = (batch.column(2).field(n).to_numpy() for n in (0, 1))
            far = _distances(np.c_[q, np.zeros(len(q))], pivots)[:, cell // (2 * ANNULI)]
            radius = np.where(bounds == -(1 << 63), np.inf, np.sqrt(np.maximum((q * q).sum(axis=1) + longest - 2 * bounds.astype(np.float64), 0)))
            slack = 1e-6 * (1 + np.sqrt(longest))
            beyond = np.maximum(np.maximum(low[None] - far, far - high[None]), 0)
            for at in range(0, len(q), 64):
                r, c = np.nonzero(beyond[at:at + 64] <= radius[at:at + 64, None] + slack)
                c = c[order := np.lexsort((beyond[at:at + 64][r, c], r))]
                r = np.repeat(r[order] + at, blocks[c])
                block = np.arange(len(r)) - np.repeat(np.cumsum(blocks[c]) - blocks[c], blocks[c])
                c = np.repeat(cell[c], blocks[c])
                open_ = (c != own_cell[r]) | (block != own_block[r])
                t = batch.take(pa.array(r[open_]))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(c[open_]), pa.array(block[open_].astype(np.int64)), t.column(3)],
                                                 names=["query_id", "q", "cell", "block", "bound"])

    rest = search(asking.mapInArrow(reached, "query_id long, q array<long>, cell long, block long, bound long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
