"""Streaming sources and sessions.

Flows wait in the state of their key until the watermark has passed them, so that none can arrive before them any more; they are then taken
in order, as in batch: gap to the flow before, cut at the timeout, one more flow of the open session.  Event-time timers wake a key
when its next flow is due or its open session can no longer go on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hostwatch.config import FEATURES, FLOW_KEY, INACTIVITY_TIMEOUT, SESSION_LEN
from hostwatch.functions import scalars as S
from hostwatch.operators import flows as FL, sessions as SS
from hostwatch.operators.lineage import cut

#: Columns that a session adds up over its flows.
SUMMED = ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "bytes_per_pkt", "packet_ratio", "byte_ratio")
KEY_SCHEMA = ", ".join(f"{k} string" for k in FLOW_KEY)
RECORD = ", ".join(f"{f} double" for f in FEATURES)
EVENT = Row(*FLOW_KEY, "kind", "start_ts", "start_flow_id", "end_ts", "num_flows", "label", "total_orig_bytes", "total_resp_bytes", "total_orig_pkts", "total_resp_pkts",
            "mean_iat", "std_iat", "mean_bytes_per_pkt", "mean_packet_ratio", "mean_byte_ratio", "flows")


def stream_zeek(spark: SparkSession, path: str, fields: Sequence[str], max_files_per_trigger: int | None = None) -> DataFrame:
    """New log files of one layout as a stream of text columns."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    reader = spark.readStream.schema(schema).options(sep="\t", comment="#", quote="", nullValue="-")
    return (reader.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else reader).csv(path)


def stream_flows(rows: DataFrame) -> DataFrame:
    """Raw Zeek rows of a stream to cleaned flows with ratios and direction; rows without an id get a hash of the row."""
    df = FL.canonical_names(rows.withColumn("ts", S.to_number("ts")))
    df = df if "flow_id" in df.columns else df.withColumn("flow_id", FL.row_identity(df))
    return FL.with_direction(FL.derive_ratios(FL.clean_flows(FL.drop_unusable(df.withColumn("proto", F.lower("proto"))))))


def _state_schema(id_type: str) -> str:
    """What is kept of a key: the last flow's time, the next timer and, where ``start_ts`` is set, the open session's sums so far."""
    return (f"last_ts double, timer bigint, start_ts double, start_flow_id {id_type}, end_ts double, num_flows bigint, labelled bigint, positive bigint, "
            + ", ".join(f"sum_{c} double" for c in SUMMED) + ", iat_mean double, iat_m2 double")


def _micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


class SessionCutter(StatefulProcessor):
    """Per flow key: flows that may still be preceded by others, the open session, and its last flows.

    Gives a row of kind ``open`` when a session begins and one of kind ``closed`` when nothing can join it any more.
    """

    def __init__(self, timeout: float, session_len: int, id_type: str):
        self.timeout, self.session_len, self.id_type = timeout, session_len, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"ts double, flow_id {self.id_type}, label int, {', '.join(f'sum_{c} double' for c in SUMMED)}, {RECORD}")
        self.recent = handle.getListState("recent", RECORD)
        self.state = handle.getValueState("session", _state_schema(self.id_type))

    def handleInitialState(self, key, initial: Row, timerValues) -> None:
        names = [c.split()[0] for c in _state_schema(self.id_type).split(", ")]
        state = {n: initial[n] if n != "timer" else None for n in names}
        if initial["recent"]:
            self.recent.put([tuple(r) for r in initial["recent"]])
        self._keep(state, None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.ts, r.flow_id, r.label, *[r[f"sum_{c}"] for c in SUMMED], *[r[f] for f in FEATURES]) for r in rows]
        self.pending.appendList(new)
        state = self._state()
        self._keep(state, min(r[0] for r in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # later flows up to here are dropped
        waiting = sorted(self.pending.get(), key=lambda r: (r[0], r[1]))
        due = sum(_micros(r[0]) <= passed for r in waiting)
        state, recent, out = self._state(), [tuple(r) for r in self.recent.get()], []
        state["timer"] = None
        for r in waiting[:due]:
            recent = self._take(key, r, state, recent, out)
        if state["start_ts"] is not None and _micros(state["end_ts"] + self.timeout) <= passed:
            recent = self._end(key, state, recent, out)
        for values, kept in ((waiting[due:], self.pending), (recent, self.recent)):
            kept.put([tuple(r) for r in values]) if values else kept.clear()
        self._keep(state, waiting[due][0] if due < len(waiting) else None, least=passed // 1000 + 1)
        yield from out

    def _take(self, key, r, state: dict, recent: list, out: list) -> list:
        """One flow in order: ends the open session if the gap is too long, and goes to the open or a new one."""
        ts, flow_id, label = r[0], r[1], r[2]
        gap = max(ts - state["last_ts"], 0.0) if state["last_ts"] is not None else 0.0
        if state["start_ts"] is not None and ts - state["end_ts"] > self.timeout:
            recent = self._end(key, state, recent, out)
        if state["start_ts"] is None:
            state.update({"start_ts": ts, "start_flow_id": flow_id, "num_flows": 0, "labelled": 0, "positive": 0, "iat_mean": 0.0, "iat_m2": 0.0},
                         **{f"sum_{c}": 0.0 for c in SUMMED})
            out.append(self._row(key, "open", state, []))
        state["num_flows"] += 1
        state["labelled"] += label is not None
        state["positive"] += label or 0
        for c, v in zip(SUMMED, r[3:]):
            state[f"sum_{c}"] += v
        step = gap - state["iat_mean"]
        state["iat_mean"] += step / state["num_flows"]
        state["iat_m2"] += step * (gap - state["iat_mean"])
        state["last_ts"] = state["end_ts"] = ts
        record = list(r[3 + len(SUMMED):])
        record[FEATURES.index("iat")] = gap
        return [*recent, tuple(record)][-self.session_len:]

    def _end(self, key, state: dict, recent: list, out: list) -> list:
        out.append(self._row(key, "closed", state, recent))
        state["start_ts"] = None
        return []

    def _row(self, key, kind: str, s: dict, recent: list) -> Row:
        if kind == "open":
            return EVENT(*key, kind, s["start_ts"], s["start_flow_id"], *[None] * (len(EVENT) - 6))
        n = s["num_flows"]
        return EVENT(*key, kind, s["start_ts"], s["start_flow_id"], s["end_ts"], n, int(2 * s["positive"] > s["labelled"]), *[s[f"sum_{c}"] for c in SUMMED[:4]],
                     s["iat_mean"], math.sqrt(max(s["iat_m2"], 0.0) / n), *[s[f"sum_{c}"] / n for c in SUMMED[4:]], [Row(*FEATURES)(*r) for r in recent])

    def _state(self) -> dict:
        names = [c.split()[0] for c in _state_schema(self.id_type).split(", ")]
        old = self.state.get()
        return dict(zip(names, old if old is not None else [None] * len(names)))

    def _keep(self, state: dict, pending, least: int = 0) -> None:
        """Store the state, with one timer at the time that the next flow or the end of the open session is due."""
        times = [_micros(pending)] if pending is not None else []
        if state["start_ts"] is not None:
            times.append(_micros(state["end_ts"] + self.timeout))
        due = max(-(-min(times) // 1000), least) if times else None
        if state["timer"] is not None and due is not None and state["timer"] <= due:
            due = state["timer"]
        if due != state["timer"]:
            if state["timer"] is not None:
                self.handle.deleteTimer(state["timer"])
            if due is not None:
                self.handle.registerTimer(due)
        state["timer"] = due
        self.state.update(tuple(state[c.split()[0]] for c in _state_schema(self.id_type).split(", ")))

    def close(self) -> None:
        pass


def _output(id_type: str) -> str:
    record = ",".join(f"{f}:double" for f in FEATURES)
    return (f"{KEY_SCHEMA}, kind string, start_ts double, start_flow_id {id_type}, end_ts double, num_flows bigint, label int, total_orig_bytes double, total_resp_bytes double, "
            f"total_orig_pkts double, total_resp_pkts double, mean_iat double, std_iat double, mean_bytes_per_pkt double, mean_packet_ratio double, "
            f"mean_byte_ratio double, flows array<struct<{record}>>")


def stream_events(flows: DataFrame, timeout: float = INACTIVITY_TIMEOUT, watermark: str = "10 minutes", session_len: int = SESSION_LEN,
                  history: "Handover | None" = None) -> DataFrame:
    """Beginnings and ends of sessions: rows of kind ``open`` and ``closed``, each with session_id, host_id, dest_id, protocol and start_ts.

    ``flows`` has ts, flow_id and the flow key; flows later than the watermark are dropped.  Closed rows hold what ``summarize_sessions`` gives over
    flows with inter-arrival times, and the last ``session_len`` flows.  A session is closed once the watermark has passed its end plus the timeout.
    ``history`` hands over what batch work knows of earlier flows.
    """
    FL.require_columns(flows, ("ts", "flow_id") + FLOW_KEY, "flow stream")
    id_type = dict(flows.dtypes)["flow_id"]
    timed = FL.drop_unusable(flows).withColumn("event_time", F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("bigint"))).withWatermark("event_time", watermark)
    rows = _columns(timed.withColumn("iat", F.lit(0.0)), "event_time")
    initial = history.keys.groupBy(*FLOW_KEY) if history is not None else None
    found = rows.groupBy(*FLOW_KEY).transformWithState(SessionCutter(timeout, session_len, id_type), _output(id_type), "Append", "EventTime", initialState=initial)
    return _named(found)


def _columns(flows: DataFrame, *more: str) -> DataFrame:
    """Key, time, id and label of every flow, what sessions add up (``sum_``), and the feature record."""
    kinds = dict(flows.dtypes)

    def summed(name: str):
        if name not in kinds:
            return F.lit(0.0)
        return F.coalesce(F.col(name), F.lit(0.0)) if kinds[name] == "double" else S.to_number(name)

    label = F.col("label").cast("int") if "label" in kinds else F.lit(0)
    return (flows.withColumn("_x", SS.as_flow(flows))
            .select(*FLOW_KEY, F.col("ts").cast("double").alias("ts"), "flow_id", label.alias("label"), *more, *[summed(c).alias(f"sum_{c}") for c in SUMMED], "_x.*"))


def _named(found: DataFrame) -> DataFrame:
    """Ids and derived columns, as in batch."""
    return (found.withColumns({
        "session_id": SS.session_id(), "host_id": F.col("src_ip"), "dest_id": F.col("dst_ip"), "protocol": F.col("proto"),
        "duration": F.greatest(F.col("end_ts") - F.col("start_ts"), F.lit(0.0)), "cv_iat": S.ratio_or_zero(F.col("std_iat"), F.col("mean_iat"), S.EPS),
        "n_flows": F.when(F.col("kind") == "closed", F.size("flows"))}).drop(*FLOW_KEY, "start_flow_id"))


def stream_sessions(flows: DataFrame, timeout: float = INACTIVITY_TIMEOUT, watermark: str = "10 minutes", session_len: int = SESSION_LEN,
                    history: "Handover | None" = None) -> DataFrame:
    """Closed sessions in append mode; see :func:`stream_events`.  A gap strictly longer than the timeout separates sessions, as in batch."""
    return stream_events(flows, timeout, watermark, session_len, history).filter("kind = 'closed'").drop("kind")


@dataclass(frozen=True)
class Handover:
    """What batch work over flows up to some time leaves to a stream of the flows behind it.

    ``keys``: per flow key its last flow's time and the sums of its open session; ``opened``: the open sessions' places; ``waiting``: closed sessions
    that an open one of their host precedes; ``released``: all other sessions, which are the history of their hosts.
    """

    keys: DataFrame
    opened: DataFrame
    waiting: DataFrame
    released: DataFrame


def hand_over(flows: DataFrame, until: float, timeout: float = INACTIVITY_TIMEOUT, session_len: int = SESSION_LEN) -> Handover:
    """Cut the sessions of ``flows`` (all flows with ``ts <= until``) into finished and open ones.

    A session is open while a flow behind ``until`` may still join it.
    """
    tagged = cut(SS.sessionize(FL.with_inter_arrival(flows), timeout))
    group = list(FLOW_KEY) + ["start_ts", "start_flow_id"]
    ends = cut(tagged.groupBy(*group, "session_id").agg(F.max("ts").alias("end_ts")).withColumn("open", F.col("end_ts") + F.lit(float(timeout)) >= F.lit(float(until))))
    open_flows = tagged.join(ends.filter("open").select("session_id"), "session_id", "left_semi")
    rows = _columns(open_flows, "start_ts", "start_flow_id")
    entry = F.struct("ts", "flow_id", F.struct(*FEATURES).alias("x"))
    sums = rows.groupBy(*group).agg(
        F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("num_flows"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive"),
        *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in SUMMED], F.avg("iat").alias("iat_mean"), (F.var_pop("iat") * F.count(F.lit(1))).alias("iat_m2"))
    recent = SS.recent_flows(rows, group, session_len).groupBy(*group).agg(F.sort_array(F.collect_list(entry)).alias("_s")).withColumn("recent", F.col("_s.x")).drop("_s")
    last = tagged.groupBy(*FLOW_KEY).agg(F.max("ts").alias("last_ts"))
    keys = cut(last.join(sums.join(recent, group), list(FLOW_KEY), "left"))
    opened = ends.filter("open").select(F.col("src_ip").alias("host_id"), "session_id", "start_ts")
    summary = SS.summarize_tagged(tagged).join(ends.filter("NOT open").select("session_id"), "session_id", "left_semi")
    first = opened.groupBy("host_id").agg(F.min("start_ts").alias("_first"))
    closed = cut(summary.join(first, "host_id", "left"))
    early = F.coalesce(F.col("start_ts") < F.col("_first"), F.lit(True))
    return Handover(keys, opened, closed.filter(~early).drop("_first"), closed.filter(early).drop("_first"))
