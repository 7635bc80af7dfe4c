"""Exponentially decayed mean and deviation of every row's history.

Per key, in order, each observation multiplies the weight of all earlier ones by ``decay``.  Unrolled,
the state after observation n is a weighted mean and variance with weights ``decay**(n-i)``.  The rows
of a key are cut into blocks; inside a block the weighted sums are running windows (values shifted by
the block's first one, which keeps the variance exact), and the state that enters a block is folded from
the states of the blocks before it.  Blocks, not keys, are the unit of work, so a key of any size is
spread over many tasks.

Weights shrink geometrically: blocks further back than ``lookback`` have a relative weight below
1e-80, far under what a double can hold next to the near ones, and are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostwatch.functions.scalars import EPS


def block_length(decay: float) -> int:
    """Rows per block: the weight falls to about a thousandth within one."""
    return max(2, min(100_000, int(math.log(1e-3) / math.log(decay))))


def _merge(old: Column, new: Column, decay: float) -> Column:
    """State after the observations of ``new`` follow those of ``old``."""
    fade = F.pow(F.lit(decay), new["cnt"])
    old_w = old["w"] * fade
    w = old_w + new["w"]
    delta = new["mean"] - old["mean"]
    return F.struct(
        w.alias("w"), (old["mean"] + delta * new["w"] / w).alias("mean"),
        (old["m2"] * fade + new["m2"] + delta * delta * old_w * new["w"] / w).alias("m2"),
        (old["cnt"] + new["cnt"]).alias("cnt"))


def decayed_stats(df: DataFrame, keys: Sequence[str], number: str, metrics: dict[str, int], decay: float = 0.95,
                  block: int | None = None, longest: int | None = None) -> DataFrame:
    """Add the decayed state of each metric after and before every row.

    ``number`` is the 1-based position of the row in its key.  ``metrics`` maps a column to how many
    leading rows of a key have no value in it (0 or 1); other values must not be null.  Per metric m the
    result has ``m_count, m_mean, m_std`` (after the row) and ``m_prev_count, m_prev_mean, m_prev_std``.
    ``longest`` is the number of rows of the longest key, if known: keys of one block need no merging.
    """
    if not 0.0 < decay < 1.0:
        raise ValueError(f"decay must be in (0, 1), got {decay}")
    size = block or block_length(decay)
    keys = list(keys)
    unit = keys + ["_block"]
    single = longest is not None and longest <= size
    rows = df.withColumn("_block", F.floor((F.col(number) - 1) / size))
    if not single:
        rows = rows.repartition(*[F.col(c) for c in unit])
    rows = _shifted(rows, unit, number, metrics, decay, size)
    entering = None if single else _entering_states(rows, keys, metrics, decay, size)

    running = Window.partitionBy(*unit).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({c: F.sum(e).over(running) for m in metrics for c, e in (
        (f"_s1_{m}", F.col(f"_y_{m}") * F.col("_up")), (f"_s2_{m}", F.col(f"_y_{m}") * F.col(f"_y_{m}") * F.col("_up")))})
    # State of the block so far.  Weights have a closed form: every row of a block past the leading ones has a value.
    zero = F.lit(0.0)
    rows = rows.withColumns({f"_n_{m}": _observed(number, skip, size) for m, skip in metrics.items()})
    rows = rows.withColumns({f"_w_{m}": _weight(F.col(f"_n_{m}"), decay) for m in metrics})
    local: dict[str, Column] = {}
    for m in metrics:
        w, s1, s2 = F.col(f"_w_{m}"), F.col(f"_s1_{m}") / F.col("_up"), F.col(f"_s2_{m}") / F.col("_up")
        local[f"_m_{m}"] = F.when(w > 0, s1 / w + F.col(f"_f_{m}"))
        local[f"_q_{m}"] = F.when(w > 0, F.greatest(s2 - s1 * s1 / w, zero)).otherwise(zero)
    rows = rows.withColumns(local).drop("_up", *[f"_{c}_{m}" for m in metrics for c in ("s1", "s2", "f", "y")])

    state: dict[str, Column] = {}
    if single:
        for m in metrics:
            state[f"{m}_mean"] = F.coalesce(F.col(f"_m_{m}"), zero)
            state[f"{m}_std"] = F.when(F.col(f"_w_{m}") > 0, F.sqrt(F.col(f"_q_{m}") / F.col(f"_w_{m}"))).otherwise(zero)
    else:
        # Merge with the state that enters the block (weight 0 where there is none).
        rows = rows.join(entering, unit, "left")
        rows = rows.withColumns({c: e for m in metrics for c, e in (
            (f"_d_{m}", F.pow(F.lit(decay), F.col(f"_n_{m}"))),
            (f"_om_{m}", F.coalesce(F.col(f"_in_{m}.mean"), F.col(f"_m_{m}"), zero)),
            (f"_nm_{m}", F.coalesce(F.col(f"_m_{m}"), F.col(f"_in_{m}.mean"), zero)))})
        for m in metrics:
            old_w = F.coalesce(F.col(f"_in_{m}.w"), zero) * F.col(f"_d_{m}")
            new_w, delta = F.col(f"_w_{m}"), F.col(f"_nm_{m}") - F.col(f"_om_{m}")
            total = F.greatest(old_w + new_w, F.lit(1e-300))
            spread = F.coalesce(F.col(f"_in_{m}.m2"), zero) * F.col(f"_d_{m}") + F.col(f"_q_{m}") + delta * delta * old_w * (new_w / total)
            state[f"{m}_mean"] = F.col(f"_om_{m}") + delta * (new_w / total)
            state[f"{m}_std"] = F.when(new_w + old_w > 0, F.sqrt(spread / total)).otherwise(zero)
    rows = rows.withColumns(state).drop(*[f"_{c}_{m}" for m in metrics for c in ("m", "q", "w", "n", "d", "om", "nm")])

    # The state before a row is the one of the row before it or, at the head of a block, the entering one.
    before = Window.partitionBy(*unit).orderBy(number)
    final: dict[str, Column] = {}
    for m, skip in metrics.items():
        first_mean, first_std = (zero, zero) if single else (
            F.coalesce(F.col(f"_in_{m}.mean"), zero), F.coalesce(F.sqrt(F.col(f"_in_{m}.m2") / F.col(f"_in_{m}.w")), zero))
        final[f"{m}_prev_mean"] = F.coalesce(F.lag(f"{m}_mean").over(before), first_mean)
        final[f"{m}_prev_std"] = F.coalesce(F.lag(f"{m}_std").over(before), first_std)
        final[f"{m}_count"] = F.greatest(F.col(number) - skip, F.lit(0)).cast("bigint")
        final[f"{m}_prev_count"] = F.greatest(F.col(number) - skip - 1, F.lit(0)).cast("bigint")
    return rows.withColumns(final).drop("_block", *[f"_in_{m}" for m in metrics])


def _observed(number: str, skip: int, size: int) -> Column:
    """Values of a metric in the block up to this row."""
    seen = F.pmod(F.col(number) - 1, F.lit(size)) + 1
    return (F.when(F.col("_block") == 0, F.greatest(seen - skip, F.lit(0))).otherwise(seen) if skip else seen).cast("double")


def _weight(observations: Column, decay: float) -> Column:
    return (F.lit(1.0) - F.pow(F.lit(decay), observations)) / F.lit(1.0 - decay)


def _shifted(rows: DataFrame, unit: list[str], number: str, metrics: dict[str, int], decay: float, size: int) -> DataFrame:
    """Per metric: first value of the block ``_f_m`` and the distance from it ``_y_m``; ``_up`` undoes the decay since then."""
    w = Window.partitionBy(*unit).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full, gappy = [m for m, s in metrics.items() if not s], [m for m, s in metrics.items() if s]
    rows = rows.withColumn("_head", F.first(F.struct(*full)).over(w)) if full else rows
    rows = rows.withColumns({f"_f_{m}": F.first(m, ignorenulls=True).over(w) for m in gappy})
    rows = rows.withColumns({f"_f_{m}": F.col(f"_head.{m}") for m in full})
    rows = rows.withColumns({f"_y_{m}": F.coalesce(F.col(m) - F.col(f"_f_{m}"), F.lit(0.0)) for m in metrics})
    return rows.withColumn("_up", F.pow(F.lit(decay), -F.pmod(F.col(number) - 1, F.lit(size)).cast("double"))).drop("_head")


def _entering_states(rows: DataFrame, keys: list[str], metrics: dict[str, int], decay: float, size: int) -> DataFrame:
    """Per (key, block): the state left by the earlier blocks.

    Reduces to one row per full block.  Runs of ``lookback`` blocks are then windowed together, each with a
    copy of the run before it, so no group holds more than two runs.
    """
    lookback = max(1, math.ceil(math.log(1e-80) / math.log(decay) / size))
    names, top = list(metrics), decay ** (size - 1)
    sums = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"), *[e for m in names for e in (
        F.sum(F.col(f"_y_{m}") * F.col("_up")).alias(f"_s1_{m}"), F.max(f"_f_{m}").alias(f"_f_{m}"),
        F.sum(F.col(f"_y_{m}") * F.col(f"_y_{m}") * F.col("_up")).alias(f"_s2_{m}"))])

    def state(m: str) -> Column:
        cnt = F.when(F.col("_block") == 0, F.lit(float(size - metrics[m]))).otherwise(F.lit(float(size)))
        w, s1, s2 = _weight(cnt, decay), F.col(f"_s1_{m}") * top, F.col(f"_s2_{m}") * top
        return F.struct(w.alias("w"), (s1 / w + F.col(f"_f_{m}")).alias("mean"),
                        F.greatest(s2 - s1 * s1 / w, F.lit(0.0)).alias("m2"), cnt.alias("cnt"))

    full = (sums.filter(F.col("_rows") == size)
            .select(*keys, "_block", F.array(*[state(m) for m in names]).alias("_state"))
            .withColumn("_home", F.floor(F.col("_block") / lookback))
            .withColumn("_run", F.explode(F.array(F.col("_home"), F.col("_home") + 1))))
    near = Window.partitionBy(*keys, "_run").orderBy("_block").rowsBetween(1 - lookback, 0)
    folded = (full.withColumn("_states", F.collect_list("_state").over(near))
              .filter(F.col("_run") == F.col("_home"))
              .withColumn("_in", F.aggregate(
                  F.slice("_states", 2, lookback), F.element_at("_states", 1),
                  lambda acc, s: F.zip_with(acc, s, lambda a, b: _merge(a, b, decay)))))
    return folded.select(*keys, (F.col("_block") + 1).alias("_block"),
                         *[F.col("_in")[i].alias(f"_in_{m}") for i, m in enumerate(names)])


def zscore(value: Column, count: Column, mean: Column, std: Column) -> Column:
    """Distance of a value from its history; 0 with fewer than two observations or without spread."""
    return F.when((count < 2) | (std < EPS), F.lit(0.0)).otherwise((value - mean) / std)


def zscore_vs_past(df: DataFrame, metric: str) -> Column:
    """z-score of ``metric`` against the state before the row (needs ``decayed_stats``)."""
    return zscore(F.col(metric), F.col(f"{metric}_prev_count"), F.col(f"{metric}_prev_mean"), F.col(f"{metric}_prev_std"))
