"""Packets to streams: reassembly by connection and idle timeout.

``reassemble`` follows the arrival-order rules exactly; ``by_gap`` is the window form that splits where a
connection pauses; ``by_session_window`` is the engine's own session window, which splits eagerly.

Packets: ``pkt_no, src, dst, sport, dport, ts, proto, status (open, fin, rst, udp), payload (binary)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.occurrences import lag_over_all

CONNECTION = ["src", "dst", "sport", "dport"]
STREAMS = "emitted double, src string, dst string, sport int, dport int, first_ts timestamp, last_ts timestamp, pkts int, status string, data binary"


class Tracker:
    """One connection's state.  ``packet`` gives the streams that end; times are seconds.  A stream's status is its last packet's.

    A stream ends with a fin or rst while open, or when a TCP packet of any connection comes more than the
    timeout after its last packet; that packet's own connection is served before stale ones are ended, so a
    late packet still extends a stream if no other packet came in between."""

    def __init__(self, timeout: float):
        self.timeout, self.open = timeout, None

    def packet(self, no: int, ts: float, status: str, payload: bytes, before: float | None) -> list[dict]:
        """``before``: time of the TCP packet before this one, of any connection."""
        out = []
        if self.open and before is not None and before - self.open["last_ts"] > self.timeout:
            out.append(self.open | {"status": "timeout", "emitted": no - 0.5})
            self.open = None
        if self.open:
            self.open["parts"].append(payload)
            self.open["pkts"] += 1
            self.open["last_ts"] = ts
            self.open["status"] = status
            if status in ("fin", "rst"):
                out.append(self.open | {"status": status, "emitted": float(no)})
                self.open = None
        elif payload:
            self.open = {"first_ts": ts, "last_ts": ts, "pkts": 1, "status": status, "parts": [payload]}
        return out

    def flush(self, end: float | None, last_no: int) -> list[dict]:
        """At the end of the trace, whose last TCP packet was at ``end``."""
        if not self.open:
            return []
        stale = end is not None and end - self.open["last_ts"] > self.timeout
        out = [self.open | {"status": "timeout" if stale else self.open["status"], "emitted": float(last_no) + (0.5 if stale else 1.0)}]
        self.open = None
        return out


def reassemble(packets: DataFrame, timeout: float = 2000.0, empty: bool = False) -> DataFrame:
    """Streams by the exact rules, a row each; ``emitted`` orders them.  Streams without data are left out unless
    ``empty``.  Connections are served one behind the other from sorted rows, so a task holds one open stream only."""
    tcp = packets.where("proto = 'tcp'").withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    end = tcp.agg(F.max_by("t", "pkt_no").alias("t"), F.max("pkt_no").alias("n")).first()
    tcp = lag_over_all(tcp, "pkt_no", "t", "before")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tracker, held = None, None, []
        names = ["emitted", *CONNECTION, "first_ts", "last_ts", "pkts", "status", "data"]
        at = lambda t: pd.Timestamp(round(t * 1e6), unit="us")

        def keep(found: list[dict]) -> None:
            held.extend((x["emitted"], *key, at(x["first_ts"]), at(x["last_ts"]), x["pkts"], x["status"], b"".join(x["parts"])) for x in found)

        for batch in batches:
            before = batch["before"].to_numpy()
            for i, p in enumerate(zip(*(batch[c] for c in (*CONNECTION, "pkt_no", "t", "status", "payload")), strict=True)):
                own, (no, t, status, payload) = p[:4], p[4:]
                if own != key:
                    if tracker:
                        keep(tracker.flush(end.t, end.n))
                    key, tracker = own, Tracker(timeout)
                keep(tracker.packet(no, t, status, bytes(payload or b""), None if pd.isna(before[i]) else before[i]))
                if len(held) >= 2000:
                    yield pd.DataFrame(held, columns=names)
                    held.clear()
        if tracker:
            keep(tracker.flush(end.t, end.n))
        yield pd.DataFrame(held, columns=names)

    ready = tcp.select(*CONNECTION, "pkt_no", "t", "before", "status", "payload").repartition(*CONNECTION).sortWithinPartitions(*CONNECTION, "pkt_no")
    streams = ready.mapInPandas(run, STREAMS)
    udp = packets.where("proto = 'udp'").select(F.col("pkt_no").cast("double").alias("emitted"), *CONNECTION, F.col("ts").cast("timestamp").alias("first_ts"), F.col("ts").cast("timestamp").alias("last_ts"), F.lit(1).alias("pkts"), F.lit("udp").alias("status"), F.col("payload").alias("data"))
    both = streams.unionByName(udp)
    return both if empty else both.where(F.octet_length("data") > 0)


def by_gap(rows: DataFrame, key: list[str], ts: str, order: str, gap_seconds: float) -> DataFrame:
    """``rows`` with ``session``: 1 and up within each key; a pause over the gap begins a new one."""
    own = Window.partitionBy(*key).orderBy(order)
    at = F.col(ts).cast("timestamp").cast("double")
    pause = at - F.lag(at).over(own)
    return rows.withColumn("_new", F.when(pause > gap_seconds, 1).otherwise(0)).withColumn("session", (F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long")).drop("_new")


def by_session_window(rows: DataFrame, key: list[str], ts: str, gap: str) -> DataFrame:
    """``(key, start, end, n)`` by the engine's session window; works on streams with a watermark too."""
    return rows.groupBy(*key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(*key, "w.start", "w.end", "n")


def join_in_order(rows: DataFrame, key: str, order: str, text: str, separator: str = "") -> DataFrame:
    """``(key, n, text)``: the texts of a key joined in order; the bodies of one key must fit a row."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key).agg(F.count("*").alias("n"), parts.alias("p")).select(key, "n", F.array_join(F.transform("p", lambda p: p[text]), separator).alias(text))
