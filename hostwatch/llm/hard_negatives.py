"""Hard negatives from an STR-packed R-tree over all vectors.

Rows are sorted by label and one coordinate over the whole table (range partitions), each run of a label is tiled by a second and
third coordinate into pages, and a page is cut into leaves: sort-tile-recursive packing.  Every leaf, page and region (a range
of partitions; at most 1024) has a minimum bounding box, which bounds the inner product with any query from both sides, coordinate by
coordinate.  A query goes to the regions whose interval meets one of its score windows, the most promising region first; the scores found
there close the windows from below.  Inside a block of pages a queue takes nodes by their upper bound and drops those outside all windows
or strictly below the k-th score so far.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostwatch.llm.common import cut
from hostwatch.llm.topk import _scores



class Sizes(NamedTuple):
    """How the tree is packed; results do not depend on it."""
    #: Rows of a range partition that are aimed at, and of a run that is tiled at once.
    run: int = 16_384
    #: Vectors of a page and of a leaf at most, pages of a block.
    page: int = 2048
    leaf: int = 256
    block: int = 16
    #: Regions at most; their boxes are what the driver and every task hold.
    regions: int = 1024
    #: Queries that meet a block at once.
    slab: int = 8192


#: Rows that the tiling coordinates are chosen from.
SAMPLE = 4096
LEAST, MOST = -(1 << 62), 1 << 62


def usable(vector: Column, label: Column) -> Column:
    """A row that takes part: label and vector are there, and every component is a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine & label.isNotNull(), F.lit(False))


def tiles(x: np.ndarray, coordinates: list[int], size: int) -> list[np.ndarray]:
    """Sort-tile-recursive: row numbers of tiles of at most ``size`` rows, by each coordinate in turn."""
    def tile(rows, left):
        if len(rows) <= size:
            return [rows]
        many = -(-len(rows) // size)
        cuts = many if len(left) < 2 else int(np.ceil(many ** (1 / len(left))))
        if left:
            rows = rows[np.argsort(x[rows, left[0]], kind="stable")]
        step = size * -(-many // cuts)
        return [t for at in range(0, len(rows), step) for t in tile(rows[at:at + step], left[1:])]
    return tile(np.arange(len(x)), coordinates)


def _pages(coordinates: list[int], regions: int, runs: int, sizes: Sizes):
    """Rows sorted by label and length as pages; a run of equal label and length is packed when it is full."""
    def pack(label, dims, ids, rows, x, region):
        order = [c for c in coordinates if c < dims]
        for n in tiles(x, order[1:3], sizes.page):
            n = n[np.concatenate(tiles(x[n], order[3:6], sizes.leaf))]
            yield label, dims, region, len(n), ids[n].tolist(), rows[n].tolist(), x[n].ravel(), x[n].min(axis=0), x[n].max(axis=0)

    def run(batches):
        from pyspark import TaskContext

        region = TaskContext.get().partitionId() * regions // runs
        key, held, count = None, [], 0

        def flush():
            if held:
                ids, rows, x = (np.concatenate(c) for c in zip(*held))
                found = list(pack(*key, ids, rows, x, region))
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), PAGE_SCHEMA.types)], schema=PAGE_SCHEMA)

        for batch in batches:
            at = 0
            labels, dims = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            while at < batch.num_rows:
                new = (labels[at], int(dims[at]))
                if new != key:
                    yield from flush()
                    key, count = new, 0
                other = np.flatnonzero((labels[at:] != new[0]) | (dims[at:] != new[1]))
                end = min(at + int(other[0]) if other.size else batch.num_rows, at + sizes.run - count)
                part = batch.slice(at, end - at)
                held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).flatten().to_numpy().reshape(end - at, new[1])))
                count, at = count + end - at, end
                if count >= sizes.run:
                    yield from flush()
                    count = 0
        yield from flush()
    return run


PAGE_SCHEMA = pa.schema([("label", pa.string()), ("dims", pa.int64()), ("region", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
                         ("x", pa.list_(pa.float64())), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
PAGES = "label string, dims long, region long, n long, ids array<long>, rows array<long>, x array<double>, low array<double>, high array<double>"


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query (row of q) with any point of each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _lists(column) -> list[np.ndarray]:
    """The lists of a column, as arrays."""
    column = column.combine_chunks()
    return np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])


class Tree:
    """The pages of a block, all vectors of one length: boxes of pages, boxes of their leaves, and the vectors."""

    def __init__(self, pages: pa.Table, dims: int, leaf: int):
        n = pages.column("n").to_numpy()
        self.labels = pages.column("label").to_pylist()
        self.ids, self.rows = (np.concatenate(_lists(pages.column(c))) for c in ("ids", "rows"))
        self.x = np.concatenate(_lists(pages.column("x"))).reshape(-1, dims) if dims else np.zeros((n.sum(), 0))
        self.page_low, self.page_high = (np.array(_lists(pages.column(c))).reshape(len(n), dims) for c in ("low", "high"))
        starts = np.cumsum(n) - n
        self.leaves = [(int(s) + at, int(s) + min(at + leaf, int(many))) for s, many in zip(starts, n) for at in range(0, many, leaf)]
        ends = np.cumsum(-(-n // leaf))
        self.of_page = [range(int(e - -(-many // leaf)), int(e)) for e, many in zip(ends, n)]
        self.low = np.array([self.x[a:b].min(axis=0) for a, b in self.leaves]).reshape(len(self.leaves), dims)
        self.high = np.array([self.x[a:b].max(axis=0) for a, b in self.leaves]).reshape(len(self.leaves), dims)

    def search(self, q: np.ndarray, label: str, row: int, windows: np.ndarray, k: int, same: bool):
        """Best-first: ``[(window, place, score)]``, of each window (least, most) the k highest scores, ties to smaller ids."""
        slack = 0.0 if len(q) * np.abs(q).max(initial=0) * max(np.abs(self.x).max(initial=0), 1) < 2.0 ** 53 else 1e-9
        leaf_low, leaf_high = (b[0] for b in intervals(q[None], self.low, self.high))
        page_low, page_high = (b[0] for b in intervals(q[None], self.page_low, self.page_high))
        queue = [(-page_high[p], 0, p) for p, other in enumerate(self.labels) if (other == label) == same]
        heapq.heapify(queue)
        least, most = windows[:, 0].copy(), windows[:, 1]
        found = [[] for _ in windows]  # per window: (-score, id, place), the best k
        while queue:
            up, leaf, n = heapq.heappop(queue)
            up = -up
            down = leaf_low[n] if leaf else page_low[n]
            pad = slack * (abs(up) + abs(down) + 1)
            if not np.any((up + pad >= least) & (down - pad <= most)):
                continue
            if not leaf:
                for m in self.of_page[n]:
                    heapq.heappush(queue, (-leaf_high[m], 1, m))
                continue
            begin, end = self.leaves[n]
            scores = _scores(q[None].astype(np.int64) if slack else q[None], self.x[begin:end].astype(np.int64) if slack else self.x[begin:end])[0]
            others = self.rows[begin:end] != row
            for w in range(len(windows)):
                fit = np.flatnonzero((scores >= least[w]) & (scores <= most[w]) & others)
                if fit.size > k:
                    fit = fit[np.lexsort((self.ids[begin:end][fit], -scores[fit]))[:k]]
                if fit.size:
                    found[w] = sorted(found[w] + [(-int(scores[i]), int(self.ids[begin + i]), int(begin + i)) for i in fit])[:k]
                    if len(found[w]) == k:
                        least[w] = max(least[w], -found[w][-1][0])
        return [(w, place, -score) for w, best in enumerate(found) for score, _, place in best]


def _search_block(k: int, same: bool, leaf: int):
    """One slab of queries against one block: ``anchor, window, vec_id, row, score``."""
    def run(queries: pa.Table, pages: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if queries.num_rows and pages.num_rows:
            tree = Tree(pages, pages.column("dims")[0].as_py(), leaf)
            least, most, x = (_lists(queries.column(c)) for c in ("least", "most", "x"))
            for n, (row, label) in enumerate(zip(queries.column("row").to_pylist(), queries.column("label").to_pylist())):
                for w, place, score in tree.search(x[n], label, row, np.array([least[n], most[n]]).T, k, same):
                    for c, v in zip(out, (row, w, int(tree.ids[place]), int(tree.rows[place]), score)):
                        c.append(v)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("anchor", "window", "vec_id", "row", "score"), out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))})
    return run


FOUND = "anchor long, window int, vec_id long, row long, score long"


class Index:
    """Pages of all rows in the shared folder, and on the driver the boxes of the regions."""

    def __init__(self, rows: DataFrame, count: int, sizes: Sizes):
        self.sizes = sizes
        common = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first().dims
        share = min(1.0, SAMPLE / count)
        sample = rows.where((F.size("x") == common) & (F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select("x").limit(2 * SAMPLE).toArrow()
        spread = np.array(_lists(sample.column(0))).var(axis=0) if sample.num_rows and common else np.zeros(common)
        order = [int(c) for c in np.argsort(-spread, kind="stable")]
        runs = max(1, -(-count // sizes.run))
        first = F.get("x", F.lit(order[0] if order else 0))
        by = ["label", "dims", "first", F.xxhash64("row")]
        dealt = (rows.select("label", F.size("x").cast("long").alias("dims"), "vec_id", "row", "x", first.alias("first")).repartitionByRange(runs, *by)
                 .sortWithinPartitions("label", "dims", "first", "row").select("label", "dims", "vec_id", "row", "x"))
        pages = dealt.mapInArrow(_pages(order, min(runs, sizes.regions), runs, sizes), PAGES)
        self.pages = cut(pages.withColumn("page", F.monotonically_increasing_id()))
        boxes = (self.pages.select("region", "dims", F.posexplode(F.arrays_zip("low", "high")).alias("at", "side"))
                 .groupBy("region", "dims", "at").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high")))
        self.regions = {(r.region, r.dims): {"pages": r.pages, "first": r.first, "last": r.last, "low": [0.0] * r.dims, "high": [0.0] * r.dims}
                        for r in self.pages.groupBy("region", "dims").agg(F.count("*").alias("pages"), F.min("label").alias("first"), F.max("label").alias("last")).collect()}
        for r in boxes.collect():
            self.regions[r.region, r.dims]["low"][r["at"]], self.regions[r.region, r.dims]["high"][r["at"]] = r.low, r.high

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best of each window of each query (row, label, x, least, most): the most promising region first, then what its scores leave open."""
        regions = {}
        for (region, dims), facts in sorted(self.regions.items()):
            regions.setdefault(dims, []).append((region, -(-facts["pages"] // self.sizes.block), facts["first"], facts["last"], facts["low"], facts["high"]))
        number = {(region, dims): -(-facts["pages"] // self.sizes.block) for (region, dims), facts in self.regions.items()}
        blocks = self.pages.sparkSession.createDataFrame([(r, d, n) for (r, d), n in number.items()], "region long, dims long, blocks long")
        pages = self.pages.join(F.broadcast(blocks), ["region", "dims"]).withColumn("block", F.pmod(F.xxhash64("page"), F.col("blocks"))).drop("blocks")

        def routed(first: bool):
            def run(batches):
                for batch in batches:
                    take, to = [], []
                    for n, r in enumerate(batch.select(["label", "x", "least", "most"]).to_pylist()):
                        near = [g for g in regions.get(len(r["x"]), []) if not same or g[2] <= r["label"] <= g[3]]
                        if not near:
                            continue
                        down, up = (b[0] for b in intervals(np.array(r["x"], np.float64)[None], np.array([g[4] for g in near]), np.array([g[5] for g in near])))
                        pad = 1e-9 * (np.abs(up) + np.abs(down) + 1)
                        meets = (((up + pad)[:, None] >= np.array(r["least"])) & ((down - pad)[:, None] <= np.array(r["most"]))).any(axis=1)
                        if first:
                            chosen = [int(np.argmax(np.where(meets, up, -np.inf)))]
                        else:
                            began = batch.column("began")[n].as_py()
                            chosen = [i for i in np.flatnonzero(meets) if near[i][0] != began]
                        to += (some := [(near[i][0], b) for i in chosen for b in range(near[i][1])])
                        take += [n] * len(some)
                    for at in range(0, len(take), 4096):
                        part = batch.take(pa.array(take[at:at + 4096], pa.int64()))
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "label", "x", "least", "most")), pa.array([t[0] for t in to[at:at + 4096]], pa.int64()),
                                                          pa.array([t[1] for t in to[at:at + 4096]], pa.int64())], names=["row", "label", "x", "least", "most", "region", "block"])
            return run

        def meet(asked: DataFrame) -> DataFrame:
            slabs = F.broadcast(asked.groupBy("region", "block").agg(F.ceil(F.count("*") / self.sizes.slab).cast("long").alias("slabs")))  # one row per block that is asked
            dealt = asked.join(slabs, ["region", "block"]).withColumn("slab", F.pmod(F.xxhash64("row"), F.col("slabs"))).withColumn("dims", F.size("x").cast("long")).drop("slabs")
            wanted = pages.join(slabs, ["region", "block"]).withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1))).drop("slabs")
            keys = ["region", "block", "dims", "slab"]
            return dealt.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(_search_block(k, same, self.sizes.leaf), FOUND)

        schema = "row long, label string, x array<double>, least array<long>, most array<long>, region long, block long"
        begun = cut(queries.mapInArrow(routed(True), schema))
        found = cut(meet(begun))
        began = begun.groupBy("row").agg(F.first("region").alias("began"))
        floors = found.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
        floors = floors.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("floors"))  # a few windows each
        raised = F.transform("least", lambda v, w: F.greatest(v, F.coalesce(F.try_element_at("floors", w), v)))
        rest = queries.join(began, "row").join(floors, "row", "left").withColumn("least", F.when(F.col("floors").isNull(), F.col("least")).otherwise(raised))
        asked = cut(rest.select("row", "label", "x", "least", "most", "began").mapInArrow(routed(False), schema))
        best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
        return found.unionByName(meet(asked)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
         sizes: Sizes = Sizes()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of each anchor and positive.

    ``vectors`` has vec_id, embedding and label (more columns are ignored); components become ``floor(scale * x)``.  Anchors are the rows whose
    ``vec_id`` is divisible by ``every``; positives of an anchor are the ``positives`` other rows of its label with the highest inner product;
    negatives of a pair are the ``negatives`` best rows of other labels with ``low * p <= 100 * score <= high * p``, p the positive's score.
    Ties go to smaller ids; with fewer rows all are given; pairs without a negative give no row.  Null labels, null vectors, null or
    not finite components and null ids take no part; vectors are compared with those of the same length only (empty ones with score 0).  Rows that
    share a ``vec_id`` are rows of their own: each can be anchor, positive or negative, also of the other.  An empty table gives no row.
    Scores times 100 have to fit into 64 bits.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    fine = vectors.where(usable(F.col("embedding"), F.col("label")) & F.col("vec_id").isNotNull())
    x = F.transform("embedding", lambda v: F.floor(scale * v.cast("double")).cast("double"))
    rows = cut(fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"))
               .withColumn("row", F.monotonically_increasing_id()))
    count = rows.count()
    if not count:
        return rows.sparkSession.createDataFrame([], schema)
    index = Index(rows, count, sizes)
    longs = "array<long>"
    anchors = cut(rows.where(F.col("vec_id") % every == 0))
    near = index.search(anchors.select("row", "label", "x", F.array(F.lit(LEAST)).cast(longs).alias("least"), F.array(F.lit(MOST)).cast(longs).alias("most")), positives, True)
    near = cut(near.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    window = F.struct("place", "positive_score")
    pairs = near.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(window)).alias("pairs"))  # at most ``positives`` each
    least = F.transform("pairs", lambda p: -_floor_div(-int(low) * p["positive_score"]))
    most = F.transform("pairs", lambda p: _floor_div(int(high) * p["positive_score"]))
    found = index.search(anchors.join(pairs, "row").select("row", "label", "x", least.alias("least"), most.alias("most")), negatives, False)
    found = found.select("anchor", (F.col("window") + 1).alias("place"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (found.join(near, ["anchor", "place"]).join(named, "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def _floor_div(hundredths: Column) -> Column:
    """Whole hundredths rounded down, without floating point."""
    return F.call_function("div", hundredths - F.pmod(hundredths, F.lit(100).cast("long")), F.lit(100).cast("long"))
