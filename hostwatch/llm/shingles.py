"""Near-duplicates by word shingles: SimHash links and MinHash bands propose groups, exact Jaccard similarity decides.

Texts whose SimHash fingerprints the index of :mod:`simhash` links are candidates, and those that share the least hashes of one of ``BANDS``
bands, as similar short texts often differ in more than a few bits.  Candidate groups are found first, so that a set of
shingles is only built again for texts that have a candidate and goes to one place, or for a group above ``GROUP`` texts to one place
per other part of the group.  There every two texts that are not joined yet are compared on their whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwatch.llm import simhash
from hostwatch.llm.common import components, cut

WORDS, LEAST = 5, 0.8
#: Bits of two fingerprints that may differ.
MOST = 4
#: Of two texts of similarity 0.8, all bands differ once in 37,000 (0.59 ** 20); 0.9: once in 8e9.
BANDS, ROWS = 20, 4
#: Texts of a group that are compared in one place.
GROUP = 1024
_FACTORS, _MASKS = np.random.default_rng(5).integers(1, 2 ** 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; a shorter text is one shingle, one without words has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(len(found) - words + 1, 1)
    return np.unique(np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n))


def _number(own: np.ndarray) -> int:
    """What texts with equal shingles share."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64))


def bands(own: np.ndarray) -> list[int]:
    """The buckets of a set of shingles, one per band."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, 2 ** 64 - 1, np.uint64)
    for at in range(0, len(own), 4096):
        least = np.minimum(least, ((own[at:at + 4096] ^ _MASKS) * _FACTORS).min(axis=1))
    return [int(np.uint64(xxhash.xxh64_intdigest(least[k * ROWS:(k + 1) * ROWS].tobytes(), k)).view(np.int64)) for k in range(BANDS)]


def _marked(batches):
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(2)]
        fps = np.array([simhash.fingerprint(t.as_py(), WORDS) for t in batch.column(2)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_number(s) for s in sets], pa.int64()), pa.array(fps.view(np.int64)),
                                          pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "content", "number", "fp", "buckets"])


def _sets(batches):
    for batch in batches:
        for t in batch.column(0):
            s = shingles(t.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([_number(s)]), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], names=["number", "own"])


def alike(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that join what all pairs of Jaccard similarity ``least`` or more join."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    label, out = np.arange(m), []
    for i in range(m - 1):
        if (label == label[i]).all():
            continue
        a, b = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = b - a
        shared = np.bincount(owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)], minlength=m)
        near = np.flatnonzero(shared >= least * (sizes + sizes[i] - shared) - 1e-9)
        for j in near[label[near] != label[i]].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _links(batches):
    """Links inside groups; rows (place, number, own) come sorted by place and number."""
    place, numbers, sets = None, [], []

    def done():
        found = alike(sets) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([numbers[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for p, number, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if p != place:
                yield done()
                place, numbers, sets = p, [], []
            if not numbers or numbers[-1] != number:  # texts with equal shingles count once
                numbers.append(number)
                sets.append(own.values.to_numpy(zero_copy_only=False).view(np.uint64))
    yield done()


def linked_fingerprints(marked: DataFrame) -> DataFrame:
    """Edges (a, b) between the numbers of texts (number, fp) whose fingerprints :func:`simhash.links` joins, or are equal."""
    texts = cut(marked.select("number", "fp").distinct())
    found = components(simhash.links(texts.select("fp").distinct(), MOST))
    near = cut(texts.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("number", F.coalesce("component", "fp").alias("group")))
    least = near.groupBy("group").agg(F.min("number").alias("a"))
    return near.join(least, "group").select("a", F.col("number").alias("b")).where("a != b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs`` (doc_id, text): texts whose sets of shingles of WORDS words have a
    Jaccard similarity of LEAST or more are linked, chains of links are one component, named by its smallest ``doc_id``.

    Words are split and lower-cased as in :mod:`simhash`.  Null texts and texts without words are alike.  A component without any id has a
    null ``component_id``.
    """
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = cut(docs.select("doc_id", content.alias("content"), "text").mapInArrow(_marked, "doc_id long, content long, number long, fp long, buckets array<long>"))
    distinct = cut(marked.groupBy("number").agg(F.min("doc_id").alias("first"), F.min("content").alias("content"), F.first("buckets").alias("buckets")))
    rows = distinct.select("number", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("number").alias("a"), F.max("number").alias("b")).where("a != b").select("bucket", "a")
    banded = rows.join(shared, "bucket").select("a", F.col("number").alias("b")).where("a != b")
    groups = cut(components(linked_fingerprints(marked.where(F.size("buckets") > 0)).unionByName(banded)))
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = (groups.join(sizes, "component").withColumn("own", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("parts = 1 OR own != other")
             .select(F.col("node").alias("number"), F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("place")))
    wanted = distinct.join(groups.select(F.col("node").alias("number")), "number", "left_semi").select("content")
    sets = docs.withColumn("content", content).join(wanted, "content", "left_semi").select("text").mapInArrow(_sets, "number long, own array<long>")
    placed = sets.join(dealt, "number").select("place", "number", "own")
    found = components(placed.repartition("place").sortWithinPartitions("place", "number").mapInArrow(_links, "a long, b long"))
    member = distinct.join(found.withColumnRenamed("node", "number"), "number", "left").select("number", "first", F.coalesce("component", "number").alias("component"))
    smallest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.join(smallest, "component").select("number", "component_id")
    return marked.select("doc_id", "number").join(named, "number").select("doc_id", "component_id")
