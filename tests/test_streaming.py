"""A stream that arrives in time order gives the batch results; late rows are dropped."""

import math
import time

from pyspark.sql import functions as F

from conftest import SMALL
from hostwatch.config import TimelineConfig
from hostwatch.operators import flows as FL, sessions as SS, timeline as TL
from hostwatch.sources import datasets, tables as T
from hostwatch.streaming import baselines as B, sessions as ST
from test_sources import FIELDS, conn, write_log


def drain(stream, name, where):
    q = (stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(where / name))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def feed(spark, df, column, edges, where):
    """One file per interval, oldest first."""
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        df.filter((F.col(column) >= a) & (F.col(column) < b)).coalesce(1).write.parquet(str(where / f"part{i}"))
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(where / "part*"))


EDGES = [0.0, 1704700000.0, 1705400000.0, 1706000000.0, 9e9]


SUMMARY = ("host_id", "dest_id", "protocol", "start_ts", "end_ts", "num_flows", "label", "duration", "total_orig_bytes", "total_resp_bytes", "total_orig_pkts", "total_resp_pkts",
           "mean_iat", "std_iat", "cv_iat", "mean_bytes_per_pkt", "mean_packet_ratio", "mean_byte_ratio")
SCORES = ("n", "partner_n", "inter_session_gap", "partner_gap", "byte_volume", "hour", *[f"{m}_{p}" for m in TL.METRICS for p in ("count", "mean", "std")],
          *[f"{m}_zscore" for m in TL.SCORED], "is_new_destination", "is_idle_hour")


def differing(got, want, columns, key="session_id"):
    """Rows of ``got`` without an equal row in ``want``, by column; ``got`` may hold fewer rows."""
    want = {r[key]: r for r in want.select(key, *columns).collect()}
    off = {}
    for r in got.select(key, *columns).collect():
        for c in columns:
            a, b = r[c], want[r[key]][c]
            same = a == b if not isinstance(a, float) or b is None else math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-6)
            if not same:
                off.setdefault(c, []).append((r[key], a, b))
    return {c: v[:2] for c, v in off.items()}


def test_stream_equals_batch(spark, tmp_path):
    """Flows to sessions to deviations in one stream: all columns, in batch order, with sessions that overlap over several batches."""
    flows = FL.derive_ratios(T.raw_flows_from_events(spark, SMALL))
    stream = feed(spark, flows, "ts", EDGES, tmp_path / "flows")
    got = drain(ST.stream_sessions(stream, T.EVENT_TIMEOUT, "1 hour"), "sessions", tmp_path)
    batch = SS.summarize_sessions(FL.with_inter_arrival(flows), timeout=T.EVENT_TIMEOUT).cache()
    # Sessions that the last watermark has not closed yet are still open.
    assert 0 < got.count() < batch.count() and got.select("session_id").distinct().count() == got.count()
    assert not differing(got, batch, SUMMARY)
    sequences = SS.build_sessions(FL.with_inter_arrival(flows), timeout=T.EVENT_TIMEOUT)
    assert not differing(got.select("session_id", F.to_json("flows").alias("flows"), "n_flows"), sequences.select("session_id", F.to_json("flows").alias("flows"), "n_flows"), ("flows", "n_flows"))

    events = ST.stream_events(stream, T.EVENT_TIMEOUT, "1 hour")
    deviations = drain(B.stream_deviations(events), "deviations", tmp_path)
    want = TL.build_host_sessions(batch)
    assert 0 < deviations.count() <= got.count()
    assert not differing(deviations, want, SCORES)
    # what is held back begins behind an open session of its host
    left = got.join(deviations, "session_id", "left_anti").select("host_id", "start_ts").collect()
    still_open = {}
    for r in batch.join(got, "session_id", "left_anti").select("host_id", "start_ts").collect():
        still_open[r.host_id] = min(r.start_ts, still_open.get(r.host_id, math.inf))
    assert all(r.start_ts >= still_open[r.host_id] for r in left)
    z = max(abs(getattr(r, f"{v}_zscore") or 0.0) for r in deviations.collect() for v in TL.SCORED)
    assert B.stream_alerts(deviations, z).count() >= 1 and B.stream_alerts(deviations, z + 1e-6).count() == 0


def test_sessions_in_host_order_need_no_markers(spark, tmp_path):
    batch = SS.summarize_sessions(T.flows_from_events(spark, SMALL), timeout=T.EVENT_TIMEOUT).cache()
    deviations = drain(B.stream_deviations(feed(spark, batch, "start_ts", EDGES, tmp_path / "closed")), "ordered", tmp_path)
    assert deviations.count() == batch.count()
    assert not differing(deviations, TL.build_host_sessions(batch), SCORES)


def test_ends_in_another_order_than_beginnings(spark, tmp_path):
    """A long session of one destination spans short ones of another; rows of a batch come in no order, and some are repeated."""
    rows = [("h", "long", t, f"l{t}") for t in range(0, 4000, 250)] + [("h", "short", t, f"s{t}") for t in (100, 110, 1500, 1500, 3000)] + [("h", "third", 5000, "t"), ("g", "long", 90, "g")]
    rows += [("h", "short", 1500, "s1500")] + [("z", "far", t, f"z{t}") for t in (30_000, 60_000)]
    flows = spark.createDataFrame([(s, d, "tcp", 1e6 + t, i, float(t % 7 + 1), 1.0, 2.0, 1.0, t % 2) for s, d, t, i in rows],
                                  "src_ip string, dst_ip string, proto string, ts double, flow_id string, orig_bytes double, resp_bytes double, orig_pkts double, resp_pkts double, label int")
    flows = FL.derive_ratios(flows)
    stream = feed(spark, flows.orderBy(F.desc("ts")), "ts", [1e6 + t for t in (0, 900, 2000, 3300, 20_000, 40_000, 1e9)], tmp_path / "overlap")
    deviations = drain(B.stream_deviations(ST.stream_events(stream, watermark="10 seconds"), TimelineConfig(min_sessions=2)), "overlap", tmp_path)
    batch = SS.summarize_sessions(FL.with_inter_arrival(flows))
    want = TL.build_host_sessions(batch, TimelineConfig(min_sessions=2)).filter("host_id != 'z'")
    assert deviations.filter("host_id != 'z'").count() == want.count() == 6
    assert not differing(deviations.filter("host_id != 'z'"), want, SCORES)


def test_stream_continues_stored_history(spark, tmp_path):
    """Batch over the flows up to some time, timelines stored and read again, then a stream of the rest: as batch over both."""
    flows = FL.derive_ratios(T.raw_flows_from_events(spark, SMALL))
    until = flows.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    history = ST.hand_over(flows.filter(F.col("ts") <= until), until, T.EVENT_TIMEOUT)
    assert history.opened.count() and history.waiting.count() and history.released.count()
    datasets.write_timelines(TL.build_timelines(history.released), str(tmp_path / "timelines"))
    stored = datasets.read_timelines(spark, str(tmp_path / "timelines"))
    stream = feed(spark, flows.filter(F.col("ts") > until), "ts", [until, *[e for e in EDGES if e > until]], tmp_path / "rest")
    events = ST.stream_events(stream, T.EVENT_TIMEOUT, "1 hour", history=history)
    deviations = drain(B.stream_deviations(events, history=(stored, history)), "continued", tmp_path)
    want = TL.build_host_sessions(SS.summarize_sessions(FL.with_inter_arrival(flows), timeout=T.EVENT_TIMEOUT))
    assert deviations.count() > 0 and deviations.join(history.released, "session_id").count() == 0
    assert not differing(deviations, want, SCORES)
    assert deviations.join(history.opened, "session_id").count() > 0


def test_zeek_stream_timeout_and_late_rows(spark, tmp_path):
    logs = tmp_path / "logs"
    # 300 s apart stays one session, 301 s cuts; the flow at 1310 arrives after its watermark and would join both.
    write_log(logs / "1.log", [conn(1000), conn(1300), conn(1601), conn(1602)])
    time.sleep(1.1)
    write_log(logs / "2.log", [conn(90000)])
    time.sleep(1.1)
    write_log(logs / "3.log", [conn(180000)])
    time.sleep(1.1)
    write_log(logs / "4.log", [conn(1310), conn(360000)])
    rows = ST.stream_zeek(spark, str(logs), FIELDS, max_files_per_trigger=1)
    got = drain(ST.stream_sessions(ST.stream_flows(rows)), "zeek_sessions", tmp_path).orderBy("start_ts").collect()
    assert [(r.start_ts, r.end_ts, r.num_flows) for r in got][:3] == [(1000.0, 1300.0, 2), (1601.0, 1602.0, 2), (90000.0, 90000.0, 1)]
    assert all(r.num_flows == 1 for r in got[3:])
