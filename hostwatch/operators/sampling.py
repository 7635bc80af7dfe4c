"""Repeatable sampling with exact counts.

Rows are ordered by a hash of seed and id; "the first n of a group" is then "hash at most h", where h is
the n-th smallest hash.  Finding h takes a few counting passes over hash prefixes; applying it is a map.
Neither sorts, shuffles nor collects the rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostwatch.functions.scalars import hash_order

DIGITS = 3
SMALL = 10_000
NOTHING, EVERYTHING = "", "~"
HASH_DIGITS = 32
COPY = "_copy"


@dataclass(frozen=True)
class Cut:
    """The rows up to a position of a group's hash order: all lower hashes, and ``keep`` of the ``copies`` rows that share ``hash``."""

    hash: str
    keep: int = 0
    copies: int = 0

    @property
    def splits(self) -> bool:
        return self.keep < self.copies

    def holds(self, h: Column) -> Column:
        """Whether a row is within; rows come from :func:`with_copies` where the cut splits copies."""
        return (h < self.hash) | ((h == self.hash) & (F.col(COPY) <= self.keep)) if self.splits else h <= self.hash


def with_copies(df: DataFrame, group: Column, cuts: Iterable[Cut], sample_id: str = "sample_id", seed: int = 42) -> DataFrame:
    """Number the rows that share a hash which a cut splits (``_copy``, from 1, by content), so that sizes are exact
    with repeated ids too.  Without such a hash this is a map; else only the rows with it are shuffled."""
    split = sorted({c.hash for c in cuts if c.splits})
    if not split:
        return df.withColumn(COPY, F.lit(0))
    h = hash_order(sample_id, seed)
    tied = F.coalesce(h.isin(*split), F.lit(False))
    content = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])
    number = F.row_number().over(Window.partitionBy(h, group).orderBy(content))
    return df.filter(~tied).withColumn(COPY, F.lit(0)).unionByName(df.filter(tied).withColumn(COPY, number))


def nth_hashes(df: DataFrame, group: Column, wanted: Mapping[str, Sequence[int]], sizes: Mapping[str, int],
               sample_id: str = "sample_id", seed: int = 42) -> dict[str, list[str]]:
    """For every group, the hashes at the wanted 1-based positions of its hash order."""
    return {g: [c.hash for c in cuts] for g, cuts in find_cuts(df, group, wanted, sizes, sample_id, seed).items()}


def find_cuts(df: DataFrame, group: Column, wanted: Mapping[str, Sequence[int]], sizes: Mapping[str, int],
              sample_id: str = "sample_id", seed: int = 42) -> dict[str, list[Cut]]:
    """For every group, the cuts at the wanted 1-based positions of its hash order.

    ``sizes`` holds the group sizes.  A position of 0 gives a value below, a position of the group size one
    above every hash.
    """
    keyed = df.select(group.cast("string").alias("g"), hash_order(sample_id, seed).alias("h"))
    state: dict[tuple[str, int], list] = {}
    for g, positions in wanted.items():
        for p in positions:
            if 0 < p < sizes.get(g, 0):
                state[g, p] = ["", p, sizes[g]]

    def narrows(s: list) -> bool:  # a whole hash is one id with its copies
        return s[2] > SMALL and len(s[0]) < HASH_DIGITS

    while any(map(narrows, state.values())):
        open_ = {(g, s[0]) for (g, _), s in state.items() if narrows(s)}
        counts: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for r in _within(keyed, open_).groupBy("g", "p", F.substr("h", F.length("p") + 1, F.lit(DIGITS)).alias("d")) \
                .count().collect():
            counts.setdefault((r["g"], r["p"]), []).append((r["d"], r["count"]))
        for (g, _), s in state.items():
            if not narrows(s):
                continue
            for digits, n in sorted(counts[g, s[0]]):
                if s[1] <= n:
                    s[0], s[2] = s[0] + digits, n
                    break
                s[1] -= n
    found: dict[tuple[str, str], list[str]] = {}
    last = {(g, s[0]) for (g, _), s in state.items() if len(s[0]) < HASH_DIGITS}
    if last:
        for r in _within(keyed, last).groupBy("g", "p").agg(F.sort_array(F.collect_list("h")).alias("hs")).collect():
            found[r["g"], r["p"]] = r["hs"]

    def answer(g: str, p: int) -> Cut:
        if p <= 0:
            return Cut(NOTHING)
        if p >= sizes.get(g, 0):
            return Cut(EVERYTHING)
        prefix, position, size = state[g, p]
        if len(prefix) == HASH_DIGITS:
            return Cut(prefix, position, size)
        hashes = found[g, prefix]
        h = hashes[position - 1]
        return Cut(h, position - hashes.index(h), hashes.count(h))

    return {g: [answer(g, p) for p in positions] for g, positions in wanted.items()}


def _within(keyed: DataFrame, cells: set[tuple[str, str]]) -> DataFrame:
    """Rows of the given (group, hash prefix) cells, tagged with the prefix."""
    prefix = F.coalesce(*[F.when((F.col("g") == g) & F.col("h").startswith(p), F.lit(p)) for g, p in sorted(cells)])
    return keyed.withColumn("p", prefix).filter(F.col("p").isNotNull())


def label_counts(df: DataFrame) -> dict[int, int]:
    """Rows per 0/1 label."""
    r = df.agg(F.count(F.when(F.col("label") == 0, 1)).alias("b"), F.count(F.when(F.col("label") == 1, 1)).alias("c")).first()
    return {0: r["b"], 1: r["c"]}


def keep_benign(df: DataFrame, n: int, available: int, seed: int = 42, sample_id: str = "sample_id") -> DataFrame:
    """All positives and ``n`` of the benign rows."""
    cut = find_cuts(df.filter(F.col("label") == 0), F.lit("b"), {"b": [n]}, {"b": available}, sample_id, seed)["b"][0]
    numbered = with_copies(df, F.col("label"), [cut], sample_id, seed)
    return numbered.filter((F.col("label") == 1) | cut.holds(hash_order(sample_id, seed))).drop(COPY)


def mix(c2: DataFrame, benign: DataFrame, c2_ratio: float = 0.15, seed: int = 42, sample_id: str = "sample_id") -> DataFrame:
    """All command-and-control rows and as many benign ones as the ratio asks for (or there are)."""
    if not 0 < c2_ratio < 1:
        raise ValueError(f"c2_ratio must be between 0 and 1, got {c2_ratio}")
    n1, n0 = label_counts(c2), label_counts(benign)
    if n1[0] or n0[1]:
        raise ValueError("c2 rows must all have label 1 and benign rows label 0")
    want = min(int(n1[1] / c2_ratio) - n1[1], n0[0])
    if want <= 0:
        raise ValueError("not enough benign rows for the requested c2_ratio")
    return c2.unionByName(keep_benign(benign, want, n0[0], seed, sample_id))


def rebalance(df: DataFrame, c2_ratio: float, seed: int = 42, sample_id: str = "sample_id") -> DataFrame:
    """Downsample benign rows to the ratio; where that cannot be reached the input is returned as it is, with a warning."""
    n = label_counts(df)
    want = int(n[1] / c2_ratio) - n[1]
    if want <= 0 or want > n[0]:
        warnings.warn(f"a ratio of {c2_ratio} needs {want} benign rows of {n[0]}; rows stay as they are", UserWarning, stacklevel=2)
        return df
    return keep_benign(df, want, n[0], seed, sample_id)


def undersample(df: DataFrame, ratio: float = 10.0, seed: int = 42, sample_id: str = "sample_id") -> DataFrame:
    """At most ``ratio`` benign rows per positive."""
    n = label_counts(df)
    return keep_benign(df, min(int(n[1] * ratio), n[0]), n[0], seed, sample_id)


def combine(*frames: DataFrame, seed: int = 42, sample_id: str = "sample_id") -> DataFrame:
    """Union of parts with a repeatable ``shuffle_key`` to order by, where order matters."""
    out = frames[0]
    for part in frames[1:]:
        out = out.unionByName(part)
    return out.withColumn("shuffle_key", hash_order(sample_id, seed))


def enrich_benign(base: DataFrame, donor: DataFrame, n: int, seed: int = 42, sample_id: str = "sample_id") -> DataFrame:
    """Add ``n`` benign rows of another source to ``base``."""
    clean = donor.filter(F.col("label") == 0)
    return base.unionByName(keep_benign(clean, n, label_counts(clean)[0], seed, sample_id))
