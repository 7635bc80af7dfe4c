"""SimHash near-duplicates through a hierarchical index in Gray order.

Two fingerprints of 64 bits that differ in at most ``d`` bits agree on one of ``d + 1`` blocks of bits, so distinct
fingerprints meet in buckets of equal blocks.  A bucket far above ``BUCKET`` fingerprints is divided once more: the bits that its
members do not share yet are cut into ``d + 1`` blocks, and those that differ in at most ``d`` bits agree on one of them too.
What is still above is dealt into parts, and every two parts are searched together.
Inside a bucket, fingerprints sorted by Gray rank form an index: neighbours share bits, and a node keeps the mask and value
of the bits that all its members share and its parent does not.  Differences are added up on the way down, and a whole
group is left as soon as they exceed ``d``.  A bucket gives a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwatch.llm.common import components, cut

BITS = 64
#: Fingerprints of a bucket that are searched as they are; a bucket above FAR times as many is divided by its other bits first.
BUCKET, FAR = 1024, 64
#: Children of a node of the index.
FAN = 8
#: Pairs of a fingerprint and a node that are looked at together.
PAIRS = 1 << 20


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text; without words it is zero."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return h(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(found) - words + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        till = min(n, at + 65_536)
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[at:till].tolist(), ends[at + words - 1:till + words - 1].tolist())], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed number) for every row of ``docs`` (doc_id, text), whole texts."""
    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the order in which neighbours differ by one bit."""
    out = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Index:
    """Nodes over buckets of fingerprints that are sorted by bucket and Gray rank; the top level has one node per bucket."""

    def __init__(self, fps: np.ndarray, bucket_starts: np.ndarray):
        n = len(fps)
        full = np.uint64(2 ** 64 - 1)
        lo, shared, value = np.arange(n), np.full(n, full), fps
        bucket = np.searchsorted(bucket_starts, lo, "right") - 1
        levels = [(lo, shared, value)]
        self.children: list[np.ndarray] = []  # of a node of level k+1: its first child at level k
        while True:
            first = np.r_[True, bucket[1:] != bucket[:-1]]
            if first.all():
                break
            begin = np.flatnonzero(first)
            place = np.arange(len(bucket)) - np.repeat(begin, np.diff(np.r_[begin, len(bucket)]))
            heads = np.flatnonzero(place % FAN == 0)
            sizes = np.diff(np.r_[heads, len(bucket)])
            differ = value ^ np.repeat(value[heads], sizes)
            shared = np.bitwise_and.reduceat(shared & ~differ, heads)
            value, lo, bucket = value[heads] & shared, lo[heads], bucket[heads]
            self.children.append(np.r_[heads, len(place)])
            levels.append((lo, shared, value))
        self.lo = [x[0] for x in levels]
        self.value = [x[2] for x in levels]
        own = [x[1] for x in levels]
        for k in range(len(own) - 1):  # bits that the parent has already are left to it
            c = self.children[k]
            own[k] = own[k] & ~np.repeat(levels[k + 1][1], np.diff(c))
        self.own, self.n = own, n

    def links(self, fps: np.ndarray, first: int, last: int, root: np.ndarray, most: int):
        """Pairs (i, j), i < j and first <= i < last, that differ in at most ``most`` bits.  ``root``: the top node of each."""
        i, node = np.arange(first, last), root[first:last]
        acc = np.zeros(len(i), np.int64)
        for k in range(len(self.own) - 1, -1, -1):
            acc = acc + np.bitwise_count((fps[i] ^ self.value[k][node]) & self.own[k][node])
            ends = np.r_[self.lo[k][1:], self.n][node]
            near = (acc <= most) & (ends > i + 1)
            i, node, acc = i[near], node[near], acc[near]
            if k:
                c = self.children[k - 1]
                begin, count = c[node], c[node + 1] - c[node]
                i, acc = np.repeat(i, count), np.repeat(acc, count)
                node = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        return i[node > i], node[node > i]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of all pairs (a, b); ``label`` leads each member to the smallest of its group."""
    while a.size:
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, higher := label[label]):
            label[:] = higher


def forest(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside buckets; ``keys`` are bucket numbers, sorted."""
    order = np.lexsort((gray_rank(fps), keys))
    keys, fps = keys[order], fps[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    index = Index(fps, starts)
    root = np.searchsorted(starts, np.arange(len(fps)), "right") - 1
    label = np.arange(len(fps))
    size = np.diff(np.r_[starts, len(fps)])[root]
    turn = np.cumsum(size) // PAIRS
    for first, last in zip(cuts := np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]]), np.r_[cuts[1:], len(fps)]):
        _merge(label, *index.links(fps, int(first), int(last), root, most))
    other = np.flatnonzero(label != np.arange(len(fps)))
    return fps[other], fps[label[other]]


def _links_in_buckets(most: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(t: pa.Table):
            if t.num_rows > 1:
                _, keys = np.unique(t.column("bucket").to_numpy(), return_inverse=True)
                a, b = forest(keys, t.column("fp").to_numpy().view(np.uint64), most)
                for at in range(0, len(a), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at:at + 65_536].view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:  # rows come sorted by bucket; the last bucket of what is held may go on
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 65_536:
                t = pa.Table.from_batches(held)
                b = t.column("bucket").to_numpy()
                whole = int(np.searchsorted(b, b[-1]))
                if whole:
                    yield from done(t.slice(0, whole))
                held = t.slice(whole).to_batches()
                rows -= whole
        if held:
            yield from done(pa.Table.from_batches(held))
    return run


def _divided(rows: DataFrame, most: int) -> DataFrame:
    """Deal rows (fp, bucket, known: bits that the bucket's members share) into buckets by each of ``most + 1`` blocks of the other bits."""
    def run(batches):
        blocks = most + 1
        for batch in batches:
            n = batch.num_rows
            fp, bucket, known = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "bucket", "known"))
            place = np.zeros((n, BITS), np.int64)  # of each bit among the unknown ones
            unknown = np.unpackbits((~known).view(np.uint8).reshape(n, 8), axis=1, bitorder="little").astype(bool) if n else np.zeros((0, BITS), bool)
            place = np.cumsum(unknown, axis=1) - 1
            total = unknown.sum(axis=1)[:, None]
            block = np.where(unknown, place * blocks // np.maximum(total, 1), -1)
            for b in range(blocks):
                mask = np.packbits(block == b, axis=1, bitorder="little").view(np.uint64).ravel() if n else np.zeros(0, np.uint64)
                mixed = (bucket * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b + 1)) ^ (fp & mask) * np.uint64(0xD6E8FEB86659FD93)
                mixed ^= mixed >> np.uint64(32)
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                mixed ^= mixed >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mixed.view(np.int64)), pa.array((known | mask).view(np.int64))], names=["fp", "bucket", "known"])

    return rows.select("fp", "bucket", "known").mapInArrow(run, "fp long, bucket long, known long")


def links(distinct: DataFrame, most: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links of at most ``most`` bits.

    An edge leads from a fingerprint to the smallest one of its group inside a bucket.

    Bucket numbers are hashes of the blocks agreed on; should two buckets get one number, they are searched together,
    which costs time and loses nothing: every link is checked on all 64 bits.
    """
    rows = cut(_divided(distinct.select("fp", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("known")), most))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    far = cut(sizes.where(F.col("n") > bucket * FAR).select("bucket"))
    if not far.isEmpty():
        rows = cut(rows.join(far, "bucket", "left_anti").unionByName(_divided(rows.join(far, "bucket", "left_semi"), most)))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / bucket).cast("long")
    large = cut(sizes.where(F.col("n") > bucket).select("bucket", parts.alias("parts")))
    searched = rows.select("bucket", "fp")
    if not large.isEmpty():
        own = F.pmod(F.xxhash64("fp"), F.col("parts"))
        dealt = (rows.join(large, "bucket").withColumn("own", own)
                 .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("own != other")
                 .select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp"))
        searched = rows.join(large, "bucket", "left_anti").select("bucket", "fp").unionByName(dealt)
    return searched.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links_in_buckets(most), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (doc_id, text; more columns are ignored).

    Words are split at ASCII white space, A-Z lower-cased; shingles of ``words`` words count as often as they occur.  Null texts
    and texts without words have fingerprint zero, which links like any other.  Rows with a null ``doc_id`` link others; a
    component without any id has a null ``component_id``.  Exact copies meet as one fingerprint before any search.
    """
    fps = cut(fingerprints(docs, words))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct, most))
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.join(smallest, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
