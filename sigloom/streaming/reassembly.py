"""Reassembly of live packets: state by connection, with a time-out on event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigloom.operators.sessions import CONNECTION

STATE = "first double, last double, pkts int, status string, data binary"
OUT = "src string, dst string, sport int, dport int, first_ts timestamp, last_ts timestamp, pkts int, status string, data binary"


def reassemble(packets: DataFrame, timeout: float = 2000.0, delay: str = "1 minute") -> DataFrame:
    """Streams of a streaming DataFrame of TCP packets.  A stream ends with a fin or rst, when its connection's next packet
    comes more than ``timeout`` seconds later, or when the watermark (``delay`` behind the newest packet) passes its
    time-out.  Other connections' packets don't end it early, which the batch form's rule of arrival order does."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(s: tuple, status: str) -> pd.DataFrame:
            return pd.DataFrame([(*key, pd.Timestamp(round(s[0] * 1e6), unit="us"), pd.Timestamp(round(s[1] * 1e6), unit="us"), s[2], status, s[4])], columns=[*CONNECTION, "first_ts", "last_ts", "pkts", "status", "data"])

        now = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if now and len(now[4]):
                yield row(now, "timeout")
            return
        rows = pd.concat(list(batches)).sort_values("pkt_no")
        for p in rows.itertuples():
            ts = p.ts.timestamp()
            if now and ts - now[1] > timeout:
                yield row(now, "timeout")
                now = None
            payload = bytes(p.payload or b"")
            if now:
                now = (now[0], max(now[1], ts), now[2] + 1, p.status, bytes(now[4]) + payload)
                if p.status in ("fin", "rst"):
                    yield row(now, p.status)
                    now = None
            elif payload:
                now = (ts, ts, 1, p.status, payload)
        if now:
            state.update(now)
            state.setTimeoutTimestamp(max(int((now[1] + timeout) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    live = packets.where("proto = 'tcp'").withWatermark("ts", delay)
    return live.groupBy(*CONNECTION).applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
