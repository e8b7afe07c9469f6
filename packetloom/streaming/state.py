"""Per-client state: profiles and behaviour sequences.

Input is one row per client session, not per packet, so even the busiest client brings few rows to a batch. Sets of a
profile live in map state, one entry per value, and never have to fit in memory together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from packetloom.functions.timing import width_us

HISTORY = 50
_DAY = 86_400.0

PROFILE_OUTPUT = (
    "client_ip string, timestamp timestamp, frame_no long, uri string, user_agent string, total_bytes long, "
    "is_new_uri_for_ip int, is_new_user_agent_for_ip int, is_first_session_for_ip int, days_since_first_seen double, "
    "days_since_last_seen double, profile_session_count long, profile_total_bytes long, profile_history int"
)


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(["timestamp", "frame_no"], kind="stable")


class ProfileProcessor(StatefulProcessor):
    """Compare each session with the stored profile of its client, then add it to the profile.

    With ``ttl_us``, what was not seen for so long is forgotten: a value is new again, and after such a silence so is the client. What is
    forgotten follows from the times of the sessions alone; timers only sweep out what no session can meet any more, some times per ttl.
    """

    #: Sweeps per ttl.
    SWEEPS = 4

    def __init__(self, ttl_us: int | None = None) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "sessions long, bytes long, first_us long, last_us long")
        self.seen = {k: handle.getMapState(k, "value string", "at_us long") for k in ("uri", "user_agent")}
        self.history = handle.getListState("history", "session string")

    def _is_new(self, kind: str, value: str | None, us: int) -> int:
        if not value:
            return 0
        state = self.seen[kind]
        last = state.getValue((value,))[0] if state.containsKey((value,)) else None
        if last is None or (self.ttl_us is not None and us > last):
            state.updateValue((value,), (us,))
        return int(last is None or self._forgotten(last, us))

    def _forgotten(self, last: int, now: int) -> bool:
        return self.ttl_us is not None and now - last >= self.ttl_us

    def _forget_all(self) -> None:
        for state in (self.totals, *self.seen.values(), self.history):
            state.clear()

    def _sweep_later(self, after_us: int) -> None:
        step = max(self.ttl_us // self.SWEEPS, 1000)
        for timer in self.handle.listTimers():
            if timer > after_us // 1000:
                return
        self.handle.registerTimer((after_us // step + 1) * step // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if self.totals.exists():
            last = self.totals.get()[3]
            if self._forgotten(last, now):
                self._forget_all()
            else:
                for state in self.seen.values():
                    for value in [v for v, (at,) in state.iterator() if self._forgotten(at, now)]:
                        state.removeKey(value)
                self._sweep_later(now)
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sessions, total, first, last = self.totals.get() if self.totals.exists() else (0, 0, None, None)
        history = [h[0] for h in self.history.get()] if self.history.exists() else []
        out = []
        for row in _in_order(rows).itertuples():
            us = row.timestamp.value // 1000
            if last is not None and self._forgotten(last, us):
                self._forget_all()
                sessions, total, first, last, history = 0, 0, None, None, []
            uri = row.uri if isinstance(row.uri, str) else None
            agent = row.user_agent if isinstance(row.user_agent, str) else None
            compared = {
                "is_new_uri_for_ip": self._is_new("uri", uri, us),
                "is_new_user_agent_for_ip": self._is_new("user_agent", agent, us),
                "is_first_session_for_ip": int(sessions == 0),
                # A session that arrives after later ones is no time after them.
                "days_since_first_seen": 0.0 if first is None else max(us - first, 0) / 1e6 / _DAY,
                "days_since_last_seen": 0.0 if last is None else max(us - last, 0) / 1e6 / _DAY,
            }
            sessions, total = sessions + 1, total + int(row.total_bytes)
            first, last = us if first is None else min(first, us), us if last is None else max(last, us)
            history = (history + [json.dumps({"us": us, "uri": uri, "user_agent": agent, "total_bytes": int(row.total_bytes)})])[-HISTORY:]
            out.append({
                "client_ip": key[0], "timestamp": row.timestamp, "frame_no": row.frame_no, "uri": uri, "user_agent": agent,
                "total_bytes": int(row.total_bytes), **compared, "profile_session_count": sessions, "profile_total_bytes": total,
                "profile_history": len(history),
            })
        self.totals.update((sessions, total, first, last))
        self.history.put([(h,) for h in history])
        if self.ttl_us is not None:
            self._sweep_later(max(last, timerValues.getCurrentWatermarkInMs() * 1000))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def compare_stream(sessions: DataFrame, ttl: str | int | None = None) -> DataFrame:
    """Stream form of the profile comparison. Needs the RocksDB state store.

    With ``ttl`` the sessions need a watermark on ``timestamp``, and state that was not touched for so long is removed, as
    ``compare_with_history(ttl=…)`` forgets it; without, profiles are kept for ever.
    """
    ttl_us = None if ttl is None else width_us(ttl)
    return sessions.groupBy("client_ip").transformWithStateInPandas(
        statefulProcessor=ProfileProcessor(ttl_us), outputStructType=PROFILE_OUTPUT, outputMode="Append", timeMode="None" if ttl is None else "EventTime",
    )


class SequenceProcessor(StatefulProcessor):
    """Keep the last ``length`` vectors of each client."""

    def __init__(self, columns: Sequence[str], length: int) -> None:
        self.columns, self.length = list(columns), length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "vector array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = [list(v[0]) for v in self.last.get()] if self.last.exists() else []
        ordered = _in_order(rows)
        vectors = last + ordered[self.columns].astype(float).fillna(0.0).to_numpy().tolist()
        before = len(last)
        ends = range(before + 1, len(vectors) + 1)
        sequences = [vectors[max(0, end - self.length) : end] for end in ends]
        self.last.put([(v,) for v in vectors[-self.length :]])
        yield pd.DataFrame({
            "client_ip": key[0], "timestamp": ordered["timestamp"], "frame_no": ordered["frame_no"], "sequence": sequences,
            "is_ready": [int(len(s) == self.length) for s in sequences],
        })

    def close(self) -> None:
        pass


def sequence_stream(sessions: DataFrame, columns: Sequence[str], length: int) -> DataFrame:
    """Stream form of the behaviour sequences. Needs the RocksDB state store."""
    return sessions.groupBy("client_ip").transformWithStateInPandas(
        statefulProcessor=SequenceProcessor(columns, length),
        outputStructType="client_ip string, timestamp timestamp, frame_no long, sequence array<array<double>>, is_ready int",
        outputMode="Append", timeMode="None",
    )


class FrequencyProcessor(StatefulProcessor):
    """Keep the number of distinct peers in the latest window of each source."""

    PEERS = "src_host_distinct_dst_ips_win"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "peers long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        windows = pd.concat(list(rows), ignore_index=True).sort_values("time_window", ignore_index=True)
        peers = windows[self.PEERS].astype("int64")
        before = peers.shift(1)
        if self.latest.exists():
            before.iloc[0] = self.latest.get()[0]
        windows["src_host_session_freq_change_win"] = (peers - before).fillna(0).astype("int64")
        self.latest.update((int(peers.iloc[-1]),))
        yield windows

    def close(self) -> None:
        pass


def frequency_change_stream(windows: DataFrame) -> DataFrame:
    """Source windows of a stream with ``src_host_session_freq_change_win``, the change against the source's window before; 0 for the first.

    Windows come closed and in order of the watermark, so one number per source is all the state. Needs the RocksDB state store.
    """
    schema = StructType([StructField(f.name, f.dataType) for f in windows.schema]).add("src_host_session_freq_change_win", "long")
    return windows.groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=FrequencyProcessor(), outputStructType=schema, outputMode="Append", timeMode="None",
    )


def use_rocksdb(spark) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
