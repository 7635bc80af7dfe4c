"""Window work over ordered rows of a key that stays parallel when one key is huge.

A plain window puts all rows of a key into one task.  Here the keys are counted first (a combinable aggregate over the
key columns).  When no key is hot the ordinary window is used: one exchange.  A hot key is cut into slices at sampled places
of its whole order, so that rows of one and the same time are spread as well.  A scan then runs inside each (key, slice), and
every slice leaves one border record: its first and last row, its counts and sums, its last values.  Border records of a key are
folded once and joined back once, whatever the scan gives: previous values, cuts, values at the last cut, running sums, numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostwatch.config import SKEW, SkewConfig
from hostwatch.operators.lineage import cut

SLICE = "_slice"
SENT_KEYS, SENT_BOUNDS = 10_000, 100_000  # a table of hot keys that is sent to all tasks: so many rows and bounds at most
SAMPLED, STEP = 64, 64  # rows per slice that its bounds are chosen from; bounds of a run that is searched at once


@dataclass(frozen=True)
class KeyedRows:
    """Rows with a key and a total order inside the key; ``order`` lists the ordering columns."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    sliced: bool
    largest: int | None = None  # rows of the largest key, where they were counted

    @staticmethod
    def plan(df: DataFrame, keys: Sequence[str], order: Sequence[str], skew: SkewConfig | None = SKEW) -> "KeyedRows":
        keys, order = tuple(keys), tuple(order)
        largest, hot = _hot_keys(df, keys, order, skew) if skew is not None else (None, None)
        if hot is None:
            return KeyedRows(df, keys, order, False, largest)
        marked = df.join(hot, list(keys), "left").withColumn(SLICE, slice_of(F.struct(*order), F.col("_bounds"))).drop("_bounds")
        return KeyedRows(marked, keys, order, True, largest)

    def drop(self, *names: str) -> "KeyedRows":
        return replace(self, df=self.df.drop(*names))

    # -- windows ------------------------------------------------------------

    @property
    def partition(self) -> tuple[str, ...]:
        return self.keys + ((SLICE,) if self.sliced else ())

    @property
    def window(self):
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def with_columns(self, columns: dict[str, Column]) -> "KeyedRows":
        return replace(self, df=self.df.withColumns(columns))

    def scan(self, lag: dict[str, str] | None = None, cut: Column | None = None, at_cut: dict[str, Column] | None = None, cut_as: str | None = None,
             cut_number: str | None = None, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, number: str | None = None) -> "KeyedRows":
        """Several running results of the key's order in one pass.

        ``lag``: ``name: column``, its value in the row before.  ``cut``: a condition that may read those names and the ordering columns; ``cut_as`` adds it as
        0 or 1, ``cut_number`` counts the cuts so far, ``at_cut`` gives expressions as they were at the latest cut.  ``last``: the latest
        non-null value of an expression up to this row.  ``total``: the sum of an expression up to this row.  ``number``: the 1-based position.
        """
        lag, at_cut, last, total = lag or {}, at_cut or {}, last or {}, total or {}
        held = {**{f"_at_{n}": e for n, e in at_cut.items()}, **{f"_la_{n}": e for n, e in last.items()}, **{f"_to_{n}": e for n, e in total.items()}}
        w, running = self.window, self._running
        rows = self.df.withColumns({**{n: F.lag(c).over(w) for n, c in lag.items()}, **held, **({"_first": F.row_number().over(w) == 1} if self.sliced and (lag or cut is not None) else {})})
        if cut is not None:  # whether the first row of a slice is one is known when the border is
            known = F.coalesce(cut, F.lit(False)).cast("bigint")
            rows = rows.withColumn("_cut", F.when(~F.col("_first") | F.col(SLICE).isNull(), known) if self.sliced else known)
        results = {n: F.last(F.when(F.col("_cut") == 1, F.col(f"_at_{n}")), ignorenulls=True).over(running) for n in at_cut}
        results |= {n: F.last(f"_la_{n}", ignorenulls=True).over(running) for n in last}
        results |= {n: F.sum(f"_to_{n}").over(running) for n in total}
        if number:
            results[number] = F.row_number().over(w).cast("bigint")
        if cut_number:
            results[cut_number] = F.sum(F.coalesce("_cut", F.lit(0))).over(running)
        rows = rows.withColumns(results)
        if not self.sliced:
            return replace(self, df=(rows.withColumn(cut_as, F.col("_cut")) if cut_as else rows).drop("_cut", *held))
        borders = self._borders(rows, lag, cut, at_cut, last, total)
        rows = rows.join(borders, list(self.partition), "left")
        first = F.col("_first") & F.col("_carry").isNotNull() if lag else None
        finished = {n: F.when(first, F.col(f"_carry.{n}")).otherwise(F.col(n)) for n in lag}
        finished |= {n: F.coalesce(F.col(n), F.col(f"_carry.{n}")) for n in (*at_cut, *last)}
        finished |= {n: F.when(F.col(f"_carry.{n}").isNull(), F.col(n)).otherwise(F.coalesce(F.col(n), F.lit(0)) + F.col(f"_carry.{n}")) for n in total}
        if number:
            finished[number] = F.col(number) + F.coalesce("_carry._rows", F.lit(0))
        if cut_number:
            finished[cut_number] = F.col(cut_number) + F.coalesce("_carry._cuts", F.lit(0))
        if cut_as:
            finished[cut_as] = F.coalesce("_cut", "_carry._first_cut")
        return replace(self, df=rows.withColumns(finished).drop("_carry", "_first", "_cut", *held))

    def _borders(self, rows: DataFrame, lag, cut, at_cut, last, total) -> DataFrame:
        """One row per (key, slice): what its rows take over from the slices before, and whether its first row is a cut."""
        at = F.struct(*self.order)
        found = [F.count(F.lit(1)).alias("_n"), *[F.sum(f"_to_{n}").alias(f"_to_{n}") for n in total]]
        found += [F.max_by(f"_la_{n}", F.when(F.col(f"_la_{n}").isNotNull(), at)).alias(f"_la_{n}") for n in last]
        if lag:
            found.append(F.max_by(F.struct(*[F.col(c).alias(n) for n, c in lag.items()]), at).alias("_last"))
        if cut is not None:
            found += [F.sum("_cut").alias("_cuts"), F.min_by(F.struct(*self.order, *[f"_at_{n}" for n in at_cut]), at).alias("_head")]
            found += [F.max_by(f"_at_{n}", F.when(F.col("_cut") == 1, at)).alias(f"_at_{n}") for n in at_cut]
        b = rows.filter(F.col(SLICE).isNotNull()).groupBy(*self.partition).agg(*found)
        across = Window.partitionBy(*self.keys).orderBy(SLICE)
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carried = {"_rows": F.coalesce(F.sum("_n").over(before), F.lit(0)), **{n: F.sum(f"_to_{n}").over(before) for n in total},
                   **{n: F.last(f"_la_{n}", ignorenulls=True).over(before) for n in last}}
        if lag:
            b = b.withColumn("_last", F.lag("_last").over(across)).withColumns({n: F.col(f"_last.{n}") for n in lag})
            carried |= {n: F.col(n) for n in lag}
        if cut is not None:
            b = b.withColumns({c: F.col(f"_head.{c}") for c in self.order})
            b = b.withColumn("_first_cut", F.coalesce(cut, F.lit(False)).cast("bigint"))
            head = {n: F.when(F.col("_first_cut") == 1, F.col(f"_head._at_{n}")) for n in at_cut}
            carried |= {n: F.coalesce(e, F.last(F.coalesce(F.col(f"_at_{n}"), e), ignorenulls=True).over(before)) for n, e in head.items()}
            carried |= {"_first_cut": F.col("_first_cut"), "_cuts": F.coalesce(F.sum(F.coalesce("_cuts", F.lit(0)) + F.col("_first_cut")).over(before), F.lit(0)) + F.col("_first_cut")}
        return b.select(*self.partition, F.struct(*[e.alias(n) for n, e in carried.items()]).alias("_carry"))

    def lag(self, **columns: str) -> "KeyedRows":
        """Add ``name=column``: the value of ``column`` in the previous row of the key."""
        return self.scan(lag=columns)

    def running_sum(self, **columns: Column) -> "KeyedRows":
        """Add ``name=expression``: its sum over the rows of the key up to this one."""
        return self.scan(total=columns)

    def last_seen(self, **columns: Column) -> "KeyedRows":
        """Add ``name=expression``: its latest non-null value up to and including this row."""
        return self.scan(last=columns)

    def number(self, name: str = "n") -> "KeyedRows":
        """Add the 1-based position of the row in its key."""
        return self.scan(number=name)

    def done(self) -> DataFrame:
        return self.df.drop(SLICE)

    @property
    def _running(self):
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def slice_of(place: Column, runs: Column) -> Column:
    """How many bounds lie below a place; ``runs`` are ascending bounds in arrays of ``STEP``, of which only one is searched in full."""
    full = F.size(F.filter(runs, lambda r: F.get(r, F.lit(STEP - 1)) < place))
    inside = F.size(F.filter(F.coalesce(F.get(runs, full), F.slice(F.get(runs, F.lit(0)), 1, 0)), lambda b: b < place))
    return F.when(runs.isNotNull(), full * STEP + inside)


def _hot_keys(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], skew: SkewConfig) -> tuple[int, DataFrame | None]:
    """Rows of the largest key and, when there are keys above ``skew.hot_rows``, where their slices are cut.

    About ``SAMPLED`` rows per slice are drawn by hash, and bounds are taken from them at even distances in the key's order, so a key has bounds in proportion to its
    rows.  Bounds only balance work.  The table of hot keys is sent to all tasks while it is small, else joined.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    if largest <= skew.hot_rows:
        return largest, None
    large = cut(counts.filter(F.col("_n") > skew.hot_rows))
    keys_, rows = large.agg(F.count(F.lit(1)), F.sum("_n")).first()
    small = keys_ <= SENT_KEYS
    share = min(1.0, SAMPLED / skew.slice_rows)
    drawn = df.select(*keys, *[c for c in order if c not in keys]).filter(F.pmod(F.xxhash64(*order, *keys), F.lit(1 << 30)) < int(share * (1 << 30)))
    one = F.struct(*order)
    every = max(1, round(share * skew.slice_rows * 3 / 8))  # so that hardly any slice exceeds ``slice_rows``
    rows_of = drawn.join(F.broadcast(large.select(*keys)) if small else large.select(*keys), list(keys)).groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_s"))
    bounds = F.array_distinct(F.filter("_s", lambda b, i: i % every == every - 1))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("_b") / STEP) - 1, F.lit(0)).cast("int")), lambda i: F.slice("_b", i * STEP + 1, STEP))
    hot = cut(rows_of.withColumn("_b", bounds).select(*keys, runs.alias("_bounds")))
    return largest, F.broadcast(hot) if small and rows / skew.slice_rows <= SENT_BOUNDS else hot
