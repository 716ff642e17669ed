"""Packets: protocol and host totals, TCP health, binary protocol messages."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Well-known ports of controller networks.
PORTS = {
    4840: "OPC-UA", 102: "S7comm", 8000: "API/WS", 5173: "Vite-HMR", 6379: "Redis", 5432: "PostgreSQL", 22: "SSH", 53: "DNS",
    123: "NTP", 514: "Syslog", 6514: "Syslog-PLC", 443: "HTTPS", 80: "HTTP", 88: "Kerberos", 389: "LDAP", 636: "LDAPS", 445: "SMB",
}


def protocol(l4: Column, sport: Column, dport: Column) -> Column:
    """By destination port, else source port, else the transport's own name or Other."""
    table = F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv])
    return F.when(l4.isin("ICMP", "ARP"), l4).otherwise(F.coalesce(table[dport], table[sport], F.lit("Other")))


def protocol_totals(packets: DataFrame, proto: Column, size: str) -> DataFrame:
    return packets.groupBy(proto.alias("proto")).agg(F.count("*").alias("packets"), F.round(F.sum(size), 2).alias("bytes"))


def host_totals(packets: DataFrame, src: Column, dst: Column, size: str) -> DataFrame:
    """``(host, bytes, packets)``, sent and received."""
    both = packets.select(F.explode(F.array(src, dst)).alias("host"), size)
    return both.groupBy("host").agg(F.round(F.sum(size), 2).alias("bytes"), F.count("*").alias("packets"))


def top_hosts(totals: DataFrame, n: int = 10) -> DataFrame:
    return totals.orderBy(F.desc("bytes"), "host").limit(n)


def destinations(packets: DataFrame, src: str, dst: str) -> DataFrame:
    return packets.groupBy(src).agg(F.array_sort(F.collect_set(dst)).alias("destinations"))


def retransmissions(packets: DataFrame, flow: str, order: tuple[str, ...], seq: str) -> DataFrame:
    """``(flow, retrans)``: packets whose sequence is that of the flow's previous one."""
    prev = F.lag(seq).over(Window.partitionBy(flow).orderBy(*order))
    return packets.withColumn("_p", prev).where(F.col(seq) == F.col("_p")).groupBy(flow).agg(F.count("*").alias("retrans"))


def tcp_health(packets: DataFrame, flags: str = "flags") -> DataFrame:
    """One row of flag counters: syn, fin, rst."""
    has = lambda bit: F.col(flags).bitwiseAND(F.lit(bit)) != 0
    return packets.agg(*[F.count_if(has(b)).alias(n) for n, b in (("syn", 2), ("fin", 1), ("rst", 4))])


def interval_rate(packets: DataFrame, ts: str, by: str, unit: str, seconds: float) -> DataFrame:
    """``(w, by, packets, rate)`` of tumbling intervals."""
    out = packets.groupBy(F.date_trunc(unit, ts).alias("w"), by).agg(F.count("*").alias("packets"))
    return out.withColumn("rate", F.round(F.col("packets") / seconds, 8))


#: Message types of the binary protocol, and bounds of a message's size.
MESSAGE_TYPES = ("HEL", "ACK", "ERR", "OPN", "CLO", "MSG")
LEAST, MOST = 8, 65536
SERVER_PORT = 4840


def feed(buffer: bytes, data: bytes) -> tuple[bytes, list[bytes]]:
    """More bytes of a flow: what is left over, and the messages that are complete.

    The size stands at offset 4, little-endian; a size out of bounds drops the buffer.
    """
    buffer, out = buffer + data, []
    while len(buffer) >= LEAST:
        size = int.from_bytes(buffer[4:8], "little")
        if not LEAST <= size <= MOST:
            return b"", out
        if len(buffer) < size:
            break
        out.append(buffer[:size])
        buffer = buffer[size:]
    return buffer, out


def service_id(message: bytes) -> int | None:
    """Numeric node id of the service in a MSG frame, by its encoding 0, 1 or 2."""
    body = message[24:]
    if message[:3] != b"MSG" or not body:
        return None
    if body[0] == 0 and len(body) >= 2:
        return body[1]
    if body[0] == 1 and len(body) >= 4:
        return int.from_bytes(body[2:4], "little")
    if body[0] == 2 and len(body) >= 7:
        return int.from_bytes(body[3:7], "little")
    return None


MESSAGES = "flow string, n int, type string, size int, service int, request boolean"


def dissect(packets: DataFrame, flow: str = "flow", order: str = "ts", payload: str = "payload", dport: str = "dport") -> DataFrame:
    """``MESSAGES`` rows of reassembled flows, each in order of arrival."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, buffer = [], b""
        for data, port in pdf.sort_values(order)[[payload, dport]].itertuples(index=False):
            buffer, found = feed(buffer, bytes(data or b""))
            for m in found:
                rows.append((str(pdf[flow].iloc[0]), len(rows), m[:3].decode("latin-1"), len(m), service_id(m), port == SERVER_PORT))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in MESSAGES.split(", ")]).astype({"service": "Int32"})

    return packets.groupBy(flow).applyInPandas(run, MESSAGES)


def message_totals(messages: DataFrame) -> DataFrame:
    return messages.groupBy("type").agg(F.count("*").alias("messages"), F.sum("size").alias("bytes"))


def service_totals(messages: DataFrame) -> DataFrame:
    return messages.where("service is not null").groupBy("service").agg(
        F.count_if("request").alias("requests"), F.count_if(~F.col("request")).alias("responses"), F.sum("size").alias("bytes")
    )


