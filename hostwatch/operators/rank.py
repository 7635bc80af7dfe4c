"""Running sums, ranks and exact quantiles over a global order, without a one-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostwatch.operators.lineage import cut

STEP = 32
PART_ROWS = 1_000_000  # rows of a bucket that are aimed at
LEVEL_PARTS = 1024  # buckets of one level; more are reached by cutting each bucket again


def _place(df: DataFrame, order: str) -> Column:
    """A number that never falls as ``order`` rises: only for cutting buckets, sums follow the column itself."""
    kind = dict(df.dtypes)[order]
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(order, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(order).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    return F.col(order).cast("double")


def bucket_of(value: Column, bounds: Column) -> Column:
    """How many ascending bounds lie below the value, by a coarse and a fine search."""
    coarse = F.filter(bounds, lambda b, i: (i % STEP == STEP - 1) & (b < value))
    fine = F.filter(F.slice(bounds, F.size(coarse) * STEP + 1, STEP), lambda b: b < value)
    return F.size(coarse) * STEP + F.size(fine)


def _bucketed(rows: DataFrame, by: list[str], parts: int, name: str) -> DataFrame:
    """Add ``name``, the bucket of ``_place`` among ``parts`` of each group, at approximate quantiles."""
    points = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = rows.groupBy(*by).agg(F.percentile_approx("_place", points, 10 * parts).alias("_bounds"))
    if by:
        same = [F.col(f"_by{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by)]
        bounds = bounds.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], "_bounds")
        joined = rows.join(bounds, reduce(lambda a, b: a & b, same)).drop(*[f"_by{k}" for k in range(len(by))])
        return joined.withColumn(name, bucket_of(F.col("_place"), F.col("_bounds"))).drop("_bounds")
    edges = bounds.first()["_bounds"] or []  # at most LEVEL_PARTS numbers
    return rows.withColumn(name, bucket_of(F.col("_place"), F.array(*map(F.lit, edges)).cast("array<double>")))


def global_running_sum(df: DataFrame, order: str, sums: dict[str, str], by: Sequence[str] = (), descending: bool = False,
                       parts: int | None = None, materialize: bool = True) -> DataFrame:
    """Add ``name`` (sum of a column over all rows up to this one) and ``name_total`` for ``sums={name: column}``.

    Rows should be aggregated so that ``order`` (a number, text, date or time) is distinct within ``by``; there may be any
    number of groups.  The order is cut at approximate quantiles into buckets of about PART_ROWS rows; each bucket is summed by
    itself and gets the total of the buckets before it.  The quantiles only balance the work, the sums are exact.
    """
    by = list(by)
    if materialize:
        df = cut(df)
    if parts is None:
        most = (df.groupBy(*by).count().agg(F.max("count")) if by else df.agg(F.count("*"))).first()[0] or 0
        parts = max(8, -(-most // PART_ROWS))
    rows = df.withColumn("_place", _place(df, order))
    buckets = ["_bucket"]
    rows = _bucketed(rows, by, min(parts, LEVEL_PARTS), "_bucket")
    if parts > LEVEL_PARTS:
        buckets.append("_bucket2")
        rows = _bucketed(rows, [*by, "_bucket"], min(-(-parts // LEVEL_PARTS), LEVEL_PARTS), "_bucket2")
    slot = by + buckets
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(*[F.desc(b) if descending else F.asc(b) for b in buckets]).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*slot).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    offsets = totals.select(  # a row per bucket
        *[F.col(c).alias(f"_s{k}") for k, c in enumerate(slot)],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(group).alias(f"{n}_total") for n in sums])
    same = [F.col(f"_s{k}").eqNullSafe(F.col(c)) for k, c in enumerate(slot)]
    rows = rows.join(offsets, reduce(lambda a, b: a & b, same))
    running = (Window.partitionBy(*slot).orderBy(F.desc(order) if descending else F.asc(order))
               .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns({n: F.sum(c).over(running) + F.col(f"_o_{n}") for n, c in sums.items()}).drop(
        "_place", *buckets, *[f"_o_{n}" for n in sums], *[f"_s{k}" for k in range(len(slot))])


RANK_PARTS = 20_000  # range partitions at most: a row of each is sent to all tasks


def global_rank(df: DataFrame, order: str, descending: bool = False, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Competition rank (1 + rows strictly before) of every row over the whole table; nulls come first, or last if descending.

    Rows are dealt into sorted range partitions (equal values by a hash of the row, so that one value may fill many), numbered
    inside each, and shifted by the rows of the partitions before; a value that goes on over a border keeps the rank it began with.
    Nothing is joined on the value.
    """
    if parts is None:
        parts = min(max(8, -(-df.count() // PART_ROWS)), RANK_PARTS)
    key = F.desc(order) if descending else F.asc(order)
    dealt = cut(df.repartitionByRange(parts, key, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])).sortWithinPartitions(key))
    at = df.columns.index(order)
    kind = df.schema[order].dataType.simpleString()
    borders = dealt.mapInArrow(_border(at), f"_part long, _rows long, first {kind}, last {kind}, _last_at long").orderBy("_part").collect()  # a row per partition
    shifts, before, begun, last = {}, 0, 0, object()
    for b in borders:
        goes_on = before > 0 and (b["first"] == last or b["first"] != b["first"] and last != last)
        shifts[b["_part"]] = before, begun if goes_on else None
        if not (goes_on and b["_last_at"] == 0):
            begun = before + b["_last_at"] + 1
        before, last = before + b["_rows"], b["last"]
    schema = df.schema.add(name, "long") if name not in df.columns else df.schema
    return dealt.mapInArrow(_ranked(at, name, shifts), schema)


def _firsts(column, last):
    """Where a run of equal values begins in a sorted column, and whether its first row goes on with ``last`` (a one-value array, or None)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ahead = pa.concat_arrays([last if last is not None else column.slice(0, 1), column.slice(0, len(column) - 1)])
    if pa.types.is_floating(column.type):  # as Spark compares: not a number is one value, and both zeros are
        same = pc.fill_null(pc.or_(pc.equal(column, ahead), pc.and_(pc.is_nan(column), pc.is_nan(ahead))), False)
    else:
        same = pc.fill_null(pc.equal(column, ahead), False)
    same = pc.or_(same, pc.and_(pc.is_null(column), pc.is_null(ahead))).to_numpy(zero_copy_only=False).copy()
    if last is None:
        same[0] = False
    return np.flatnonzero(~same), bool(same[0])


def _border(at: int):
    """Of each partition: its number, rows, first and last value, and the place where the run of the last value begins."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rows, first, last, last_at = 0, None, None, 0
        for batch in batches:
            if batch.num_rows:
                column = batch.column(at)
                starts, _ = _firsts(column, last)
                first = column.slice(0, 1) if first is None else first
                last_at = rows + int(starts[-1]) if len(starts) else last_at
                rows, last = rows + batch.num_rows, column.slice(batch.num_rows - 1, 1)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([rows]), first, last, pa.array([last_at])],
                                             names=["_part", "_rows", "first", "last", "_last_at"])
    return run


def _ranked(at: int, name: str, shifts: dict):
    """Rows with their rank, from ``shifts``: rows before the partition, and the rank of its first value if that began earlier."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        before, rank = shifts.get(TaskContext.get().partitionId(), (0, None))
        rows, last = 0, None
        for batch in batches:
            if batch.num_rows:
                starts, goes_on = _firsts(batch.column(at), last)
                ranks = np.repeat([rank or 0, *(before + rows + starts + 1)], np.diff([0, *starts, batch.num_rows]))
                if last is None and rank is not None:  # the first value began in an earlier partition
                    ranks[:starts[1] if len(starts) > 1 else batch.num_rows] = rank
                rank, last = int(ranks[-1]), batch.column(at).slice(batch.num_rows - 1, 1)
                rows += batch.num_rows
                columns = {n: c for n, c in zip(batch.schema.names, batch.columns)} | {name: pa.array(ranks.astype(np.int64))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles: ``qs={name: q}`` gives one column each, per group.

    Equal values are counted together first, so heavy ties cost nothing.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = global_running_sum(counts, value, {"_c": "_n"}, by=by)
    return ranked.groupBy(*by).agg(*[
        interpolated(F.col(value), F.col("_c"), F.col("_n"), F.col("_c_total"), q).alias(name) for name, q in qs.items()])


def interpolated(value: Column, up_to: Column, n: Column, total: Column, q: float) -> Column:
    """Aggregate that reads quantile ``q`` off rows (value, how many up to it, how many equal it, how many in all)."""
    position = (total - 1) * F.lit(float(q))
    low, high = F.floor(position), F.ceil(position)

    def at(index: Column) -> Column:
        return F.max(F.when((up_to - n <= index) & (index < up_to), value))

    return at(low) + (at(high) - at(low)) * F.max(position - low)


BRACKET = 1_000_000  # values between the bounds of a quantile that are counted one by one
ACCURACY = 10_000


def column_quantiles(df: DataFrame, values: Sequence[str], qs: dict[str, float], by: str, accuracy: int = ACCURACY, bracket: int = BRACKET) -> DataFrame:
    """Exact linearly interpolated quantiles of many columns: rows ``by, column, quantile, value`` for each of ``qs={quantile: q}``.

    ``by`` has a few values (two sides of a comparison); their bounds are held by the driver.  Every column gets an interval around each
    wanted rank from approximate quantiles; the interval is checked by counting, and narrowed again while more than ``bracket``
    values lie in it.  Only values inside an interval become rows, so no row per column and value is shuffled.  Nulls count for nothing.
    """
    wanted = [(c, n) for c in values for n in qs]
    groups = [r[0] for r in df.groupBy(by).count().select(by).orderBy(by).collect()]
    numbered = F.lit(None).cast("int")
    for i, g in enumerate(groups):
        numbered = F.when(F.col(by).eqNullSafe(F.lit(g)), F.lit(i)).otherwise(numbered)
    df = df.select(by, *values, numbered.alias("_g"))
    bounds = {(g, *w): (None, None) for g in range(len(groups)) for w in wanted}  # None: open
    counts: dict = {}

    # expressions are written as text: a hundred bounds would take seconds to put together call by call
    def number(x: float) -> str:
        return f"CAST('{float(x)!r}' AS DOUBLE)"

    def by_group(pick) -> str:
        parts = [f"WHEN {g} THEN {e}" for g in range(len(groups)) if (e := pick(g)) is not None]
        return f"CASE _g {' '.join(parts)} END" if parts else "NULL"

    def inside(column: str, quantile: str) -> str:
        def test(g: int) -> str:
            low, high = bounds[g, column, quantile]
            ends = [f"`{column}` {sign} {number(x)}" for sign, x in ((">=", low), ("<=", high)) if x is not None]
            return " AND ".join([f"`{column}` IS NOT NULL", *ends])
        return by_group(test)

    def below(column: str, quantile: str) -> str:
        return by_group(lambda g: "false" if bounds[g, column, quantile][0] is None else f"`{column}` < {number(bounds[g, column, quantile][0])}")

    slack, open_ = 2.0 / accuracy, set(bounds)
    while open_:
        # approximate quantiles inside the intervals, on both sides of the wanted rank
        place = {}
        for k in open_:
            n, under, within = counts.get(k, (None, 0, None))
            p = qs[k[2]] if n is None else ((n - 1) * qs[k[2]] + 0.5 - under) / within
            extra = slack if n is None else slack + 1 / within
            place[k] = max(p - extra, 0.0), min(p + extra, 1.0)
        keys = sorted(open_, key=str)
        names = [f"percentile_approx(CASE WHEN _g = {k[0]} AND {inside(*k[1:])} THEN CAST(`{k[1]}` AS DOUBLE) END, array({place[k][0]!r}D, {place[k][1]!r}D), {accuracy}) AS p{i}" for i, k in enumerate(keys)]
        found = df.selectExpr(*names).first()
        before = dict(bounds)
        for i, k in enumerate(keys):
            if found[f"p{i}"]:
                low, high = found[f"p{i}"]
                bounds[k] = low if place[k][0] > 0 else bounds[k][0], high if place[k][1] < 1 else bounds[k][1]
        todo = sorted({k[1:] for k in open_})
        tests = [e for i, w in enumerate(todo) for e in (f"count(`{w[0]}`) AS n{i}", f"count_if({below(*w)}) AS b{i}", f"count_if({inside(*w)}) AS w{i}")]
        checked = {r["_g"]: r for r in df.groupBy("_g").agg(*map(F.expr, tests)).collect()}
        left = set()
        for i, w in enumerate(todo):
            for g in range(len(groups)):
                k = (g, *w)
                if k not in open_:
                    continue
                n, under, within = (checked[g][f"{c}{i}"] for c in "nbw")
                position = (n - 1) * qs[w[1]]
                if n and not (under <= math.floor(position) and math.ceil(position) < under + within):
                    bounds[k] = before[k]  # beside the wanted rank: again with more slack
                    left.add(k)
                    continue
                shrunk = k not in counts or within < counts[k][2]
                counts[k] = n, under, within
                low, high = bounds[k]
                if within > bracket and (low is None or high is None or low < high) and shrunk:
                    left.add(k)
        slack = slack * 8 if any(bounds[k] == before[k] for k in left) else slack
        open_ = left

    # values inside the intervals, counted
    rows = ", ".join(f"CASE WHEN {inside(*w)} THEN named_struct('column', '{w[0]}', 'quantile', '{w[1]}', 'value', CAST(`{w[0]}` AS DOUBLE)) END" for w in wanted)
    tally = df.selectExpr(f"`{by}`", f"inline(array_compact(array({rows})))").groupBy(by, "column", "quantile", "value").agg(F.count(F.lit(1)).alias("_n"))
    counts = {(groups[k[0]], *k[1:]): v for k, v in counts.items()}
    known = df.sparkSession.createDataFrame([(*k, *counts[k][:2]) for k in counts], df.select(by).schema.add("column", "string").add("quantile", "string").add("_all", "long").add("_below", "long"))
    tally = tally.join(F.broadcast(known), [by, "column", "quantile"])  # a row per group, column and quantile
    up_to = Window.partitionBy(by, "column", "quantile").orderBy("value")
    tally = tally.withColumn("_c", F.sum("_n").over(up_to) + F.col("_below"))
    q = reduce(lambda out, n: F.when(F.col("quantile") == n, F.lit(float(qs[n]))).otherwise(out), qs, F.lit(None).cast("double"))
    position = (F.col("_all") - 1) * q
    low, high = F.floor(position), F.ceil(position)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_c") - F.col("_n") <= index) & (index < F.col("_c")), F.col("value")))

    return tally.groupBy(by, "column", "quantile").agg((at(low) + (at(high) - at(low)) * F.max(position - low)).alias("value"))
