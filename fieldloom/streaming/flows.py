"""Structured Streaming forms of the packet and signal operators.

Aggregates are windowed with a watermark (10 minutes unless told otherwise;
later rows are dropped).  State that no aggregate expresses, the last sequence
of a flow, a byte buffer, an on-delay, lives in ``applyInPandasWithState``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldloom.operators.network import feed, service_id

LATE = "10 minutes"


def interval_totals(packets: DataFrame, ts: str, by: Column, size: str, every: str, late: str = LATE) -> DataFrame:
    """``(start, by, packets, bytes)`` of tumbling windows."""
    out = packets.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), by.alias("by"))
    return out.agg(F.count("*").alias("packets"), F.sum(size).alias("bytes")).select(F.col("w.start").alias("start"), "by", "packets", "bytes")


def sessions(samples: DataFrame, ts: str, key: str, gap: str, late: str = LATE) -> DataFrame:
    out = samples.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def retransmissions(packets: DataFrame, flow: str, order: str, seq: str) -> DataFrame:
    """``(flow, retrans)`` so far, a row whenever a flow has new packets."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (None, 0)
        for batch in batches:
            for s in batch.sort_values(order)[seq].tolist():
                count, last = count + (last is not None and s == last), s
        state.update((last, count))
        yield pd.DataFrame({"flow": [str(key[0])], "retrans": [count]})

    return packets.groupBy(flow).applyInPandasWithState(
        run, "flow string, retrans long", "last long, n long", "update", GroupStateTimeout.NoTimeout
    )


def messages(packets: DataFrame, flow: str, order: str, payload: str) -> DataFrame:
    """``(flow, type, size, service)`` of messages as they are completed."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = bytes(state.get[0]) if state.exists else b""
        rows = []
        for batch in batches:
            for data in batch.sort_values(order)[payload]:
                buffer, found = feed(buffer, bytes(data or b""))
                rows += [(str(key[0]), m[:3].decode("latin-1"), len(m), service_id(m)) for m in found]
        state.update((buffer,))
        yield pd.DataFrame(rows, columns=["flow", "type", "size", "service"]).astype({"service": "Int32"})

    return packets.groupBy(flow).applyInPandasWithState(
        run, "flow string, type string, size int, service int", "buffer binary", "append", GroupStateTimeout.NoTimeout
    )


def on_delay(samples: DataFrame, key: str, ts: str, value: str, preset_us: int) -> DataFrame:
    """``(key, ts, q)``: an on-delay over a stream in order of time within a batch."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        for batch in batches:
            batch = batch.sort_values(ts)
            out = []
            for t, v in zip(batch[ts], batch[value]):
                us = int(t.value // 1000)
                since = (us if since is None else since) if v else None
                out.append(since is not None and us - since >= preset_us)
            yield pd.DataFrame({"key": str(k[0]), "ts": batch[ts].to_numpy(), "q": out})
        state.update((since,))

    return samples.groupBy(key).applyInPandasWithState(
        run, "key string, ts timestamp, q boolean", "since long", "append", GroupStateTimeout.NoTimeout
    )
