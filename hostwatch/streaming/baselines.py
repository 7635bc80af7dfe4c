"""Streaming host baselines: every session is scored against the host's past, then added to it, in the order of batch work.

Sessions end in another order than they begin.  A host therefore keeps the places of its open sessions and its closed sessions that
begin behind one of them; once no open session begins earlier, they leave in order of start, end and id.  All sessions that begin before the
watermark have been announced by then, so no other can come in between.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hostwatch.config import TimelineConfig
from hostwatch.functions.scalars import EPS
from hostwatch.operators.timeline import METRICS, SCORED, Timelines
from hostwatch.streaming.sessions import Handover

PASSED = (("session_id", "string"), ("dest_id", "string"), ("protocol", "string"), ("start_ts", "double"), ("end_ts", "double"), ("label", "int"),
          ("duration", "double"), ("num_flows", "double"), ("total_orig_bytes", "double"), ("total_resp_bytes", "double"), ("mean_iat", "double"), ("cv_iat", "double"),
          ("mean_packet_ratio", "double"))
SESSION = ", ".join(f"{n} {t}" for n, t in PASSED)
OUTPUT = (f"host_id string, {SESSION}, n bigint, partner_n bigint, inter_session_gap double, partner_gap double, byte_volume double, hour int, "
          + ", ".join(f"{m}_count bigint, {m}_mean double, {m}_std double" for m in METRICS) + ", "
          + ", ".join(f"{m}_zscore double" for m in SCORED) + ", is_new_destination double, is_idle_hour double")
SCORED_ROW = Row(*[c.split()[0] for c in OUTPUT.split(", ")])
STATE = "n bigint, last_end double, " + ", ".join(f"{m}_count bigint, {m}_mean double, {m}_m2 double, {m}_weight double" for m in METRICS)


class HostBaseline(StatefulProcessor):
    """Per host: decayed moments of each metric, its destinations, its open sessions and the closed ones that wait for them."""

    def __init__(self, cfg: TimelineConfig = TimelineConfig()):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", STATE)
        self.known = handle.getMapState("destinations", "dest_id string", "n bigint, last_end double")
        self.open = handle.getMapState("open", "session_id string", "start_ts double")
        self.waiting = handle.getListState("waiting", SESSION)

    def handleInitialState(self, key, initial: Row, timerValues) -> None:
        if initial.kind == "profile":
            self.state.update(tuple(initial[c.split()[0]] for c in STATE.split(", ")))
        elif initial.kind == "partner":
            self.known.updateValue((initial.dest_id,), (initial.n, initial.last_end))
        elif initial.kind == "open":
            self.open.updateValue((initial.session_id,), (initial.start_ts,))
        else:
            self.waiting.appendValue(tuple(initial[n] for n, _ in PASSED))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closed = []
        for r in rows:
            if r.kind == "open":
                self.open.updateValue((r.session_id,), (r.start_ts,))
            else:
                closed.append(tuple(r[n] for n, _ in PASSED))
        for r in closed:
            if self.open.containsKey((r[0],)):
                self.open.removeKey((r[0],))
        first = min((v[0] for v in self.open.values()), default=math.inf)
        waiting = sorted([*map(tuple, self.waiting.get()), *closed], key=lambda r: (r[3], r[4], r[0]))
        ready = sum(r[3] < first for r in waiting)
        self.waiting.put(waiting[ready:]) if waiting[ready:] else self.waiting.clear()
        if ready:
            yield from self._score(key[0], waiting[:ready])

    def _score(self, host: str, sessions: list[tuple]) -> Iterator[Row]:
        old = self.state.get()
        n, last_end = (0, None) if old is None else (old[0], old[1])
        moments = {m: ([0, 0.0, 0.0, 0.0] if old is None else list(old[2 + 4 * i:6 + 4 * i])) for i, m in enumerate(METRICS)}
        names = [c for c, _ in PASSED]
        for session in sessions:
            r = dict(zip(names, session))
            seen, partner_end = self.known.getValue((r["dest_id"],)) if self.known.containsKey((r["dest_id"],)) else (0, None)
            values = {**r, "byte_volume": r["total_orig_bytes"] + r["total_resp_bytes"], "inter_session_gap": r["start_ts"] - last_end if n else None}
            ready = n >= self.cfg.min_sessions
            z = [zscore(moments[m], values[m]) if ready and values[m] is not None else None for m in SCORED]
            for m in METRICS:
                if values[m] is not None:
                    add(moments[m], values[m], self.cfg.decay)
            hour = math.floor(r["start_ts"] / 3600) % 24
            states = [x for m in METRICS for x in (moments[m][0], moments[m][1], deviation(moments[m]))]
            yield SCORED_ROW(host, *session, n + 1, seen + 1, values["inter_session_gap"], None if partner_end is None else r["start_ts"] - partner_end, values["byte_volume"], hour, *states,
                      *z, float(seen == 0) if ready else None, float(hour in self.cfg.idle_hours) if ready else None)
            self.known.updateValue((r["dest_id"],), (seen + 1, r["end_ts"]))
            n, last_end = n + 1, r["end_ts"]
        self.state.update((n, last_end, *[x for m in METRICS for x in moments[m]]))

    def close(self) -> None:
        pass


def add(m: list, x: float, decay: float) -> None:
    """One observation into (count, mean, m2, weight)."""
    weight = m[3] * decay + 1.0
    mean = m[1] + (x - m[1]) / weight
    m[:] = [m[0] + 1, mean, m[2] * decay + (x - m[1]) * (x - mean), weight]


def deviation(m: list) -> float:
    return math.sqrt(max(0.0, m[2] / m[3])) if m[3] > 0 else 0.0


def zscore(m: list, x: float) -> float:
    std = deviation(m)
    return 0.0 if m[0] < 2 or std < EPS else (x - m[1]) / std


def initial_state(tl: Timelines, history: Handover) -> DataFrame:
    """Stored timelines of the released sessions, with what still waits, as the first state of the stream's hosts."""
    decay = tl.config.decay
    rows = tl.host_sessions.groupBy("host_id").agg(F.max("n").alias("n"), F.max_by("end_ts", "n").alias("last_end"))
    # a profile holds the state behind its last session; weights have a closed form
    moments = {}
    for m in METRICS:
        weight = (1 - F.pow(F.lit(decay), F.col(f"{m}_count"))) / (1 - decay)
        moments |= {f"{m}_m2": F.pow(F.col(f"{m}_std"), 2) * weight, f"{m}_weight": weight}
    profiles = tl.host_profile.withColumns(moments).select("host_id", *[f"{m}_{p}" for m in METRICS for p in ("count", "mean", "m2", "weight")])
    profiles = rows.join(profiles, "host_id").withColumn("kind", F.lit("profile"))
    partners = tl.host_partners.select("host_id", F.lit("partner").alias("kind"), "dest_id", F.col("total_sessions").alias("n"), F.col("last_seen").alias("last_end"))
    opened = history.opened.withColumn("kind", F.lit("open"))
    waiting = history.waiting.select("host_id", F.lit("waiting").alias("kind"), *[F.col(c).cast(t).alias(c) for c, t in PASSED])
    parts = [profiles, partners, opened, waiting]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def stream_deviations(events: DataFrame, cfg: TimelineConfig = TimelineConfig(), history: tuple[Timelines, Handover] | None = None) -> DataFrame:
    """Every closed session with its host's baselines and deviations, as ``build_host_sessions`` gives them; state is kept per host (RocksDB).

    ``events`` is the result of ``stream_events``; a stream of sessions that all come in host order will do as well.  ``history`` continues stored timelines.
    """
    kind = F.col("kind") if "kind" in events.columns else F.lit("closed")
    needed = events.select("host_id", kind.alias("kind"), *[F.col(c).cast(t).alias(c) for c, t in PASSED])
    initial = initial_state(*history).groupBy("host_id") if history is not None else None
    return needed.groupBy("host_id").transformWithState(HostBaseline(cfg), OUTPUT, "Append", "None", initialState=initial)


def stream_alerts(deviations: DataFrame, z: float = TimelineConfig().z_threshold) -> DataFrame:
    """Deviating sessions only; a stateless filter."""
    strongest = F.greatest(*[F.coalesce(F.abs(F.col(f"{m}_zscore")), F.lit(0.0)) for m in SCORED])
    return deviations.filter(strongest >= z)
