"""Ordered scans: skewed and plain plans agree; decayed statistics follow the recurrence."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from hostwatch.config import SkewConfig
from hostwatch.operators import decay as D, flows as FL, rank as R, sessions as SS, timeline as TL
from hostwatch.operators.ordered import KeyedRows
from hostwatch.sources import tables as T

HOT = SkewConfig(hot_rows=10, slice_rows=3)


@pytest.fixture(scope="module")
def raw(spark):
    return T.raw_flows_from_events(spark, SMALL).cache()


def test_inter_arrival_of_hot_keys(raw):
    cols = ("flow_id", "iat", "iat_delta", "byte_delta")
    assert rows(FL.with_inter_arrival(raw, skew=HOT), *cols) == rows(FL.with_inter_arrival(raw, skew=None), *cols)


def test_sessions_of_hot_keys(raw):
    cols = ("flow_id", "session_id", "session_no")
    plain = SS.sessionize(raw, T.EVENT_TIMEOUT, numbered=True, skew=None)
    assert rows(SS.sessionize(raw, T.EVENT_TIMEOUT, numbered=True, skew=HOT), *cols) == rows(plain, *cols)
    cols = ("session_id", "all_flows", "label", "n_flows", "flows", "end_ts")
    df = FL.with_inter_arrival(FL.with_direction(FL.derive_ratios(raw)), skew=None)
    args = dict(timeout=T.EVENT_TIMEOUT, session_len=4)
    assert rows(SS.build_sessions(df, skew=HOT, **args), *cols) == rows(SS.build_sessions(df, skew=None, **args), *cols)


@pytest.mark.parametrize("order", ["time", "ingest"])
def test_timelines_of_hot_hosts(raw, order):
    s = SS.summarize_sessions(FL.with_inter_arrival(FL.derive_ratios(raw), skew=None), timeout=T.EVENT_TIMEOUT).cache()
    hot = SkewConfig(hot_rows=3, slice_rows=2)
    cols = ("session_id", "n", "partner_n", "inter_session_gap", "partner_gap")
    assert rows(TL.number_sessions(s, order, skew=hot), *cols) == rows(TL.number_sessions(s, order, skew=None), *cols)


def test_any_number_of_keys_may_be_hot(raw):
    keyed = KeyedRows.plan(raw, ("src_ip",), ("ts", "flow_id"), skew=SkewConfig(hot_rows=5, slice_rows=2))
    assert keyed.sliced and keyed.largest == raw.groupBy("src_ip").count().agg(F.max("count")).first()[0]
    large = raw.groupBy("src_ip").count().filter("count > 5").count()
    assert keyed.df.filter(F.col("_slice").isNotNull()).select("src_ip").distinct().count() == large > 2
    got = keyed.number("n").running_sum(s=F.col("orig_bytes")).done().select("flow_id", "n", F.round("s", 6))
    want = KeyedRows.plan(raw, ("src_ip",), ("ts", "flow_id"), skew=None).number("n").running_sum(s=F.col("orig_bytes")).done()
    assert rows(got) == rows(want.select("flow_id", "n", F.round("s", 6)))


def recurrence(xs, decay):
    """Welford with decay: count, mean, sum of squares, weight."""
    n, mean, m2, w, out = 0, 0.0, 0.0, 0.0, []
    for x in xs:
        before = (n, mean, math.sqrt(max(0.0, m2 / w)) if w else 0.0)
        n, w, old = n + 1, w * decay + 1.0, mean
        mean = old + (x - old) / w
        m2 = m2 * decay + (x - old) * (x - mean)
        out.append((n, mean, math.sqrt(max(0.0, m2 / w)), *before))
    return out


def series(n=700):
    rnd = random.Random(3)
    return {"uniform": [rnd.uniform(0, 1e6) for _ in range(n)], "constant": [42.5] * n, "offset": [1e9 + rnd.random() for _ in range(n)],
            "step": [1e6 if i == 50 else 5.0 for i in range(n)], "two_steps": [10.0 if i < 200 else 2e5 if i < 400 else 3.0 for i in range(n)]}


@pytest.mark.parametrize("block, longest", [(16, None), (None, None), (None, 700), (1000, 700)])
def test_decayed_statistics(spark, block, longest):
    data = [(k, i + 1, x) for k, xs in series().items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(data, "k string, n bigint, x double")
    got = D.decayed_stats(df, ["k"], "n", {"x": 0}, block=block, longest=longest)
    z = D.zscore_vs_past(got, "x")
    found = {(r.k, r.n): r for r in got.withColumn("z", z).collect()}
    assert len(found) == len(data)
    for k, xs in series().items():
        for i, (n, mean, std, pn, pmean, pstd) in enumerate(recurrence(xs, 0.95)):
            r = found[k, i + 1]
            scale = max(abs(x) for x in xs)
            assert (r.x_count, r.x_prev_count) == (n, pn)
            assert r.x_mean == pytest.approx(mean, rel=1e-9) and r.x_prev_mean == pytest.approx(pmean, rel=1e-9)
            assert r.x_std == pytest.approx(std, rel=1e-4, abs=1e-9 * scale)
            assert r.x_prev_std == pytest.approx(pstd, rel=1e-4, abs=1e-9 * scale)
            if k in ("uniform", "constant", "two_steps"):
                want = 0.0 if pn < 2 or pstd < 1e-9 else (xs[i] - pmean) / pstd
                assert r.z == pytest.approx(want, rel=1e-5, abs=1e-9)


def test_leading_row_without_value(spark):
    rnd = random.Random(5)
    xs = [None] + [rnd.uniform(-50, 50) for _ in range(60)]
    df = spark.createDataFrame([("a", i + 1, x) for i, x in enumerate(xs)], "k string, n bigint, gap double")
    got = {r.n: r for r in D.decayed_stats(df, ["k"], "n", {"gap": 1}, decay=0.8, block=8).collect()}
    assert (got[1].gap_count, got[1].gap_mean, got[1].gap_std) == (0, 0.0, 0.0)
    for i, (n, mean, std, *_) in enumerate(recurrence(xs[1:], 0.8)):
        assert got[i + 2].gap_count == n
        assert got[i + 2].gap_mean == pytest.approx(mean, rel=1e-9, abs=1e-9) and got[i + 2].gap_std == pytest.approx(std, rel=1e-7, abs=1e-9)
    with pytest.raises(ValueError):
        D.decayed_stats(df, ["k"], "n", {"gap": 1}, decay=1.0)


def test_global_running_sum_and_quantiles(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("ab"), round(rnd.expovariate(0.1), 1)) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, v double")
    counts = df.groupBy("v").count()
    got = {r.v: (r.c, r.c_total) for r in R.global_running_sum(counts, "v", {"c": "count"}, descending=True, parts=40).collect()}
    for v, (c, total) in got.items():
        assert (c, total) == (sum(x >= v for _, x in data), 3000)
    quant = {r.g: (r.lo, r.mid, r.hi) for r in R.exact_quantiles(df, "v", {"lo": 0.0, "mid": 0.5, "hi": 0.95}, by=("g",)).collect()}
    import numpy as np

    for g in "ab":
        xs = [x for k, x in data if k == g]
        assert quant[g] == pytest.approx((min(xs), float(np.median(xs)), float(np.quantile(xs, 0.95))))
    ranks = {r.v: r["rank"] for r in R.global_rank(df, "v").collect()}
    assert all(ranks[v] == 1 + sum(x < v for _, x in data) for v in ranks)


def test_ranks_over_many_groups_texts_and_dates(spark, monkeypatch):
    df = spark.range(6000).selectExpr("id % 1500 AS g", "cast(id % 7 AS double) AS v", "concat('t', id % 50) AS t", "date_add(date'2024-01-01', cast(id % 40 AS int)) AS d")
    got = {r.g: r.m for r in R.exact_quantiles(df, "v", {"m": 0.5}, by=["g"]).collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == want
    monkeypatch.setattr(R, "LEVEL_PARTS", 4)
    for order in ("t", "d", "v"):
        for down in (False, True):
            counts = df.groupBy(order).agg(F.count("*").alias("n"))
            rows = [tuple(r) for r in R.global_running_sum(counts, order, {"c": "n"}, descending=down, parts=10).select(order, "n", "c", "c_total").collect()]
            total = 0
            for value, n, c, all_ in sorted(rows, reverse=down):
                total += n
                assert c == total and all_ == 6000


def test_a_burst_is_spread_over_slices(spark):
    df = spark.range(10_001).selectExpr("'h' AS k", "CASE WHEN id = 0 THEN 0.0 ELSE 1e6 + id / 200 END AS ts", "id AS flow_id", "1.0 AS v")
    keyed = KeyedRows.plan(df, ("k",), ("ts", "flow_id"), skew=SkewConfig(hot_rows=1000, slice_rows=500))
    assert keyed.df.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 500
    got = keyed.number("n").running_sum(s=F.col("v")).lag(p="flow_id").done()
    assert got.filter("n != flow_id + 1 OR s != n OR coalesce(p, -1) != flow_id - 1").count() == 0


def test_one_scan_of_a_hot_key_has_a_small_plan(spark, tmp_path):
    """Gap, session and number of a hot key: two scans and four hash exchanges at most; also when all rows fall into one second."""
    spread = spark.range(6000).selectExpr("concat('k', CASE WHEN id % 4 = 0 THEN id % 40 ELSE 0 END) AS k", "cast(id * 37 % 6000 AS double) AS ts", "id AS flow_id", "id % 5 AS v")
    second = spark.range(6000).selectExpr("'k0' AS k", "cast(7 + (id % 2) / 2 AS double) AS ts", "id * 7919 % 6000 AS flow_id", "id % 5 AS v")
    for name, df in (("spread", spread), ("second", second)):
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        skew = SkewConfig(hot_rows=1000, slice_rows=400)

        def scanned(skew):
            rows_ = KeyedRows.plan(df, ("k",), ("ts", "flow_id"), skew=skew)
            cut = F.col("p").isNull() | (F.col("ts") - F.col("p") > 1.5)
            return rows_, rows_.scan(lag={"p": "ts", "pv": "v"}, cut=cut, at_cut={"began": F.col("flow_id")}, cut_as="first", cut_number="no",
                                     total={"s": F.col("v")}, last={"even": F.when(F.col("v") % 2 == 0, F.col("flow_id"))}, number="n").done()

        keyed, hot = scanned(skew)
        assert keyed.sliced and keyed.df.filter("_slice IS NOT NULL").groupBy("k", "_slice").count().agg(F.max("count"), F.count("*")).first()[0] <= 400
        _, plain = scanned(None)
        columns = ("k", "flow_id", "p", "pv", "began", "first", "no", "s", "even", "n")
        assert rows(hot, *columns) == rows(plain, *columns)
        plan = hot._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= 2 and plan.count("Exchange hashpartitioning") <= 4, plan


@pytest.mark.parametrize("down", [False, True])
def test_global_rank_over_borders_and_ties(spark, down):
    """One score held by nine tenths of all rows stays spread; nulls and not-a-number have ranks as Spark orders them."""
    data = [(n, 0.5 if n % 10 else n / 7.0) for n in range(4000)] + [(9000 + n, None) for n in range(3)] + [(9100 + n, float("nan")) for n in range(5)]
    df = spark.createDataFrame(data, "id long, v double").repartition(5)
    got = R.global_rank(df, "v", descending=down, parts=16)
    from pyspark.sql import Window

    want = df.withColumn("rank", F.rank().over(Window.orderBy(F.desc("v") if down else F.asc("v"))).cast("long"))
    assert rows(got, "id", "rank") == rows(want, "id", "rank")
    by_part = got.groupBy(F.spark_partition_id()).count()
    assert by_part.agg(F.max("count")).first()[0] < 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    texts = df.select(F.concat(F.lit("t"), F.col("id") % 11).alias("t"))
    assert rows(R.global_rank(texts, "t", parts=8)) == rows(texts.withColumn("rank", F.rank().over(Window.orderBy("t")).cast("long")))
    assert R.global_rank(df.filter("id < 0"), "v").count() == 0


@pytest.mark.parametrize("accuracy, bracket", [(10_000, 1_000_000), (20, 50)])
def test_quantiles_of_columns(spark, accuracy, bracket):
    """Exact quantiles of many columns at once, with rough first intervals too."""
    import numpy as np

    rng = np.random.default_rng(4)
    data = {s: np.c_[rng.normal(size=n), rng.integers(0, 3, n), rng.pareto(0.3, n), np.full(n, 7.0)] for s, n in (("a", 3000), ("b", 1111))}
    df = spark.createDataFrame([(s, *map(float, r)) for s, rows_ in data.items() for r in rows_] + [("a", None, None, None, None), ("c", None, 1.0, None, 2.0)],
                               "side string, u double, i double, p double, c double").repartition(4)
    qs = {"min": 0.0, "mid": 0.5, "p95": 0.95, "max": 1.0}
    got = {(r.side, r.column, r["quantile"]): r.value for r in R.column_quantiles(df, ["u", "i", "p", "c"], qs, "side", accuracy, bracket).collect()}
    for s, x in data.items():
        for k, c in enumerate("uipc"):
            for name, q in qs.items():
                assert got[s, c, name] == pytest.approx(float(np.quantile(x[:, k], q)), rel=1e-12), (s, c, name)
    assert got["c", "i", "mid"] == 1.0 and ("c", "u", "mid") not in got
