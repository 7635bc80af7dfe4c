"""Train/validation/test splits and the checks that go with them.

Every strategy first reads sums per label (held-out families and sources are told by the hash of their name, so names
are never collected), decides exact sizes on the driver and then assigns ``split`` in one map over the rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from hostwatch.config import TEST_FRACTION, VAL_FRACTION
from hostwatch.functions.labels import split_key
from hostwatch.functions.scalars import hash_order
from hostwatch.operators.lineage import cut
from hostwatch.operators.rank import global_running_sum
from hostwatch.operators.sampling import COPY, find_cuts, label_counts, with_copies

STRATEGIES = ("random_stratified", "family_separated", "source_separated", "time_separated", "zero_shot")


def allocate(counts: dict[int, int], draws: int) -> dict[int, int]:
    """Share ``draws`` over classes in proportion, by largest remainder (ties: smaller label)."""
    total = sum(counts.values())
    exact = {c: n * draws / total for c, n in counts.items()}
    share = {c: math.floor(x) for c, x in exact.items()}
    left = draws - sum(share.values())
    for c in sorted(counts, key=lambda c: (-(exact[c] - share[c]), c))[:left]:
        share[c] += 1
    return share


def held_out(counts: dict[int, int], fraction: float) -> dict[int, int]:
    """Rows per class of the held-out part of a stratified split."""
    present = {c: n for c, n in counts.items() if n}
    total = sum(present.values())
    size = math.ceil(fraction * total)
    if min(present.values(), default=0) < 2:
        raise ValueError(f"a stratified split needs at least two rows of every class, got {counts}")
    if size < len(present) or total - size < len(present):
        raise ValueError(f"cannot put every class on both sides: {size} of {total} rows")
    train = allocate(present, total - size)
    return {c: present.get(c, 0) - train.get(c, 0) for c in counts}


def _val_sizes(counts: dict[int, int], fraction: float) -> dict[int, int]:
    """Validation rows per class; with one class only the tail of the rows is taken."""
    present = {c: n for c, n in counts.items() if n}
    if len(present) > 1:
        return held_out(counts, fraction)
    return {c: n - int(n * (1 - fraction)) for c, n in counts.items()}


def _assign(df: DataFrame, group: Column, sizes: dict[str, int], plan: dict[str, list[tuple[str, int]]], seed: int,
            sample_id: str, rest: str = "train") -> DataFrame:
    """Give the first rows (by hash) of each group to the named parts in turn, the others to ``rest``."""
    ends = {g: [sum(n for _, n in parts[:i + 1]) for i in range(len(parts))] for g, parts in plan.items()}
    cuts = find_cuts(df, group, ends, sizes, sample_id, seed)
    h = hash_order(sample_id, seed)
    tests = [F.when((group == g) & cuts[g][i].holds(h), F.lit(name))
             for g, parts in plan.items() for i, (name, _) in enumerate(parts)]
    numbered = with_copies(df, group, [c for of in cuts.values() for c in of], sample_id, seed)
    return numbered.withColumn("split", F.coalesce(*tests, F.lit(rest))).drop(COPY)


def _named_counts(df: DataFrame, name: Column) -> DataFrame:
    """Rows per class of every name: ``name, b, c``.  A table, as there may be any number of names."""
    return cut(df.groupBy(name.alias("name")).agg(F.count(F.when(F.col("label") == 0, 1)).alias("b"), F.count(F.when(F.col("label") == 1, 1)).alias("c")))


def _first_names(names: DataFrame, n: int, total: int, seed: int) -> Callable[[Column], Column]:
    """Test for the first ``n`` of ``total`` distinct names by hash; it needs the cut alone, not the names."""
    last = find_cuts(names, F.lit("n"), {"n": [n]}, {"n": total}, "name", seed)["n"][0].hash
    return lambda name: hash_order(name, seed) <= last


def _given_names(names: set[str]) -> Callable[[Column], Column]:
    return lambda name: F.coalesce(name.isin(*sorted(names)), F.lit(False))


def stratified_two_way(df: DataFrame, fraction: float = VAL_FRACTION, seed: int = 42, part: str = "val",
                       sample_id: str = "sample_id") -> DataFrame:
    """Hold out an exact, label-proportional part of the rows."""
    n = label_counts(df)
    out = held_out(n, fraction)
    return _assign(df, F.col("label").cast("string"), {str(c): v for c, v in n.items()},
                   {str(c): [(part, out[c])] for c in n}, seed, sample_id)


def random_stratified(df: DataFrame, val: float = VAL_FRACTION, test: float = TEST_FRACTION, seed: int = 42,
                      sample_id: str = "sample_id") -> DataFrame:
    """Test first, then validation as a share of what is left."""
    n = label_counts(df)
    t = held_out(n, test)
    v = held_out({c: n[c] - t[c] for c in n}, val / (1.0 - test))
    return _assign(df, F.col("label").cast("string"), {str(c): x for c, x in n.items()},
                   {str(c): [("test", t[c]), ("val", v[c])] for c in n}, seed, sample_id)


def _separate_families(df: DataFrame, away: Callable[[Column], Column], families: DataFrame, benign: int, val: float,
                       test: float, seed: int, sample_id: str) -> DataFrame:
    """Whole families to test, a share of benign rows to test, the rest into train and validation."""
    out = away(F.col("name"))
    n = families.agg(*[F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0)) for c in (out, ~out)]).first()
    gone, kept = n[0], n[1]
    benign_test = min(max(1, int(benign * test)), benign)
    v = _val_sizes({0: benign - benign_test, 1: kept}, val)
    group = F.when(F.col("label") == 0, "benign").when(away(split_key("family")), "away").otherwise("kept")
    return _assign(df, group, {"benign": benign, "kept": kept, "away": gone},
                   {"benign": [("test", benign_test), ("val", v[0])], "kept": [("val", v[1])], "away": [("test", gone)]}, seed, sample_id)


def _families(df: DataFrame) -> tuple[DataFrame, int, int]:
    """Families with positive rows, how many they are, and all benign rows."""
    counts = _named_counts(df, split_key("family"))
    families = counts.filter(F.col("c") > 0)
    return families, families.count(), counts.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]


def family_separated(df: DataFrame, val: float = VAL_FRACTION, test: float = TEST_FRACTION, seed: int = 42,
                     held_out_families: set[str] | None = None, min_families: int = 1,
                     sample_id: str = "sample_id") -> DataFrame:
    """No command-and-control family is in both train and test."""
    families, known, benign = _families(df)
    if held_out_families:
        away = _given_names(held_out_families)
    else:
        n = min(max(min_families, int(known * test)), known - min_families)
        away = _first_names(families, max(n, 0), known, seed)
    return _separate_families(df, away, families, benign, val, test, seed, sample_id)


def zero_shot(df: DataFrame, val: float = VAL_FRACTION, test: float = TEST_FRACTION, seed: int = 42,
              zero_shot_families: set[str] | None = None, zero_shot_sources: set[str] | None = None,
              sample_id: str = "sample_id") -> DataFrame:
    """Test on families (and, when given, sources) that training never sees."""
    away = F.col("source").isin(*sorted(zero_shot_sources)) if zero_shot_sources else F.lit(False)
    seen = df.filter(~away) if zero_shot_sources else df
    families, known, benign = _families(seen)
    out = _separate_families(seen, _given_names(zero_shot_families) if zero_shot_families else _first_names(families, max(1, int(known * 0.3)), known, seed),
                             families, benign, val, test, seed, sample_id)
    return out.unionByName(df.filter(away).withColumn("split", F.lit("test"))) if zero_shot_sources else out


def source_separated(df: DataFrame, val: float = VAL_FRACTION, test: float = TEST_FRACTION, seed: int = 42,
                     sample_id: str = "sample_id") -> DataFrame:
    """Whole sources go to test."""
    counts = _named_counts(df, F.col("source"))
    known = counts.count()
    if known < 2:
        warnings.warn("only one source; using the random stratified split", UserWarning, stacklevel=2)
        return random_stratified(df, val, test, seed, sample_id)
    away = _first_names(counts, min(max(1, int(known * test)), known - 1), known, seed)
    out = away(F.col("name"))
    n = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.when(out, F.col("b") + F.col("c")), F.when(~out, F.col("b")), F.when(~out, F.col("c")))]).first()
    gone, kept = n[0], {0: n[1], 1: n[2]}
    v = _val_sizes(kept, val)
    group = F.when(away(F.col("source")), "away").otherwise(F.col("label").cast("string"))
    return _assign(df, group, {"away": gone, "0": kept[0], "1": kept[1]},
                   {"away": [("test", gone)], "0": [("val", v[0])], "1": [("val", v[1])]}, seed, sample_id)


def time_separated(df: DataFrame, val: float = VAL_FRACTION, time_quantile: float = 0.70, seed: int = 42,
                   sample_id: str = "sample_id", time: str = "start_ts") -> DataFrame:
    """Earlier rows train, later rows test; rows with equal times are ordered by hash."""
    counts = df.groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    ranked = global_running_sum(counts, time, {"upto": "n"})
    total = df.count()
    test_from = int(total * time_quantile)
    ends = [int(test_from * (1 - val)), test_from]
    hits = ranked.select(time, "n", (F.col("upto") - F.col("n")).alias("before")).filter(
        " OR ".join(f"({e} > before AND {e} <= before + n)" for e in ends)).collect()
    tests, cuts = [], []
    for end, name in zip(ends, ("train", "val")):
        hit = next((r for r in hits if r["before"] < end <= r["before"] + r["n"]), None)
        if hit is None:
            continue
        same = F.col(time) == F.lit(hit[time])
        last = find_cuts(df.filter(same), F.lit("t"), {"t": [end - hit["before"]]}, {"t": hit["n"]}, sample_id, seed)["t"][0]
        cuts.append(last)
        tests.append(F.when((F.col(time) < F.lit(hit[time])) | (same & last.holds(hash_order(sample_id, seed))), F.lit(name)))
    numbered = with_copies(df, F.col(time), cuts, sample_id, seed)
    return numbered.withColumn("split", F.coalesce(*tests, F.lit("test"))).drop(COPY)


def split_sessions(df: DataFrame, strategy: str = "family_separated", val: float = VAL_FRACTION, test: float = TEST_FRACTION,
                   seed: int = 42, held_out_families: set[str] | None = None, min_families: int = 1,
                   zero_shot_families: set[str] | None = None, zero_shot_sources: set[str] | None = None,
                   time_quantile: float = 0.70, sample_id: str = "sample_id") -> DataFrame:
    """Add ``split`` by the named strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown split strategy: {strategy}")
    if df.isEmpty():
        raise ValueError("cannot split an empty dataset")
    needs = {"family_separated": ("source", "c2_family"), "zero_shot": ("source", "c2_family"),
             "source_separated": ("source",), "time_separated": ("start_ts",)}.get(strategy, ())
    if any(c not in df.columns for c in needs):
        warnings.warn(f"{strategy} needs {needs}; using the random stratified split", UserWarning, stacklevel=2)
        strategy = "random_stratified"
    if strategy == "family_separated":
        return family_separated(df, val, test, seed, held_out_families, min_families, sample_id)
    if strategy == "source_separated":
        return source_separated(df, val, test, seed, sample_id)
    if strategy == "time_separated":
        return time_separated(df, val, time_quantile, seed, sample_id)
    if strategy == "zero_shot":
        return zero_shot(df, val, test, seed, zero_shot_families, zero_shot_sources, sample_id)
    return random_stratified(df, val, test, seed, sample_id)


# --- reports ------------------------------------------------------------------------------------

PAIRS = (("train", "val"), ("train", "test"), ("val", "test"))


def _in_split(name: str) -> Column:
    return F.max((F.col("split") == name).cast("int"))


def _overlaps(df: DataFrame, key: Column, label: str) -> DataFrame:
    seen = df.groupBy(key.alias("k")).agg(*[_in_split(s).alias(s) for s in ("train", "val", "test")])
    return seen.agg(F.lit(label).alias("what"), *[
        F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in PAIRS])


def leakage(df: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """How many ids, families and sources are in two splits at once, one row each."""
    out = _overlaps(df, F.col(sample_id), "id")
    if "c2_family" in df.columns:
        out = out.unionByName(_overlaps(df.filter(F.col("label") == 1), split_key("family"), "family"))
    if "source" in df.columns:
        out = out.unionByName(_overlaps(df, F.col("source"), "source"))
    return out


def split_summary(df: DataFrame, strategy: str = "") -> DataFrame:
    """One row: sizes, families and sources per split, and the families shared by train and test."""
    def size(s: str) -> Column:
        return F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_size")

    def names(s: str, value: Column, kind: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("split") == s, value))).alias(f"{s}_{kind}")

    family = F.when(F.col("label") == 1, split_key("family"))
    out = df.agg(F.lit(strategy).alias("strategy"), F.count(F.lit(1)).alias("total_samples"),
                 *[size(s) for s in ("train", "val", "test")],
                 *[names(s, family, "families") for s in ("train", "val", "test")],
                 *[names(s, F.col("source"), "sources") for s in ("train", "test")])
    overlap = F.array_sort(F.array_intersect("train_families", "test_families"))
    return out.withColumns({"family_overlap_train_test": overlap})


def split_report(df: DataFrame) -> DataFrame:
    """Rows, positives and percentage of positives per split."""
    from hostwatch.operators.sessions import class_counts

    return class_counts(df, by=("split",))


def host_diversity(df: DataFrame) -> DataFrame:
    """Distinct hosts and sessions per split."""
    return df.groupBy("split").agg(F.count_distinct("host_id").alias("unique_hosts"), F.count(F.lit(1)).alias("sessions"))
