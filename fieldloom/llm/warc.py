"""WARC archives: write, normalise to one gzip member a record, index, read back.

A crawl is first written as monolithic archives (one gzip stream a file, every
record a ``response``).  The normaliser inflates each stream once, in bounded
pieces, rewrites every record as a gzip member of its own and writes a sidecar
index of offsets.  On the way records whose payload was seen elsewhere become
``revisit`` records that refer to the record with the smallest id.

Files live in the shared folder and are opened through ``pyarrow.fs``, so any
store it knows by URI will do.  A file is written under a name that no other
attempt of the task uses and is only known through the row that the task
returns; a task that is run again leaves an unread file behind, never a torn one.

Defined results: a null payload is an empty one; rows without an id or with a
repeated id are all written, a record each; an empty table writes no file and reads back as
no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns_only, scratch_path

#: An archive is closed after so many bytes of records or so many records.
ARCHIVE_BYTES = 32 << 20
ARCHIVE_RECORDS = 2048
#: Tasks at most that rewrite or read archives; only speed depends on it.
TASKS = 4096
#: Bytes of compressed input inflated at a time.
CHUNK = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_urn(record_id: int | None) -> str:
    return f"<urn:fieldloom:record:{'' if record_id is None else record_id}>"


def urn_record(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:fieldloom:record:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _clean(value: str | None) -> str:
    return re.sub(r"[\r\n\x00]+", " ", value or "")


def render_record(
    record_id: int | None, uri: str | None, payload: bytes, digest: str, length: int, refers_to: int | None = None
) -> bytes:
    """One WARC/1.1 record; ``refers_to`` makes it a revisit, which has no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_urn(record_id)}",
        f"WARC-Target-URI: {_clean(uri)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def inflate(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, piece by piece."""
    inner = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            if inner.eof:
                inner = zlib.decompressobj(31)
            out = inner.decompress(data, 1 << 20)
            data = inner.unused_data if inner.eof else inner.unconsumed_tail
            if out:
                yield out
    if not inner.eof:
        raise EOFError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an inflated stream; holds one record at a time."""
    buf = bytearray()

    def fill(n: int) -> bool:
        while len(buf) < n:
            more = next(pieces, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while True:
        while (cut := buf.find(b"\r\n\r\n")) < 0:
            if not fill(len(buf) + 1):
                if buf.strip():
                    raise EOFError("a record's head ends early")
                return
        head = parse_head(bytes(buf[:cut]))
        size, start = int(head["content-length"]), cut + 4
        if not fill(start + size + 4):
            raise EOFError("a record's block ends early")
        yield head, bytes(buf[start : start + size])
        del buf[: start + size + 4]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _ArchiveWriter:
    """Monolithic gzip archives, a new one whenever the last is full."""

    def __init__(self, root: str):
        self.root, self.path = root, None

    def add(self, record: bytes) -> str:
        if self.path is None:
            self.path = f"{self.root}/{uuid.uuid4().hex}.warc.gz"
            system, at = _open(self.path)
            self.out, self.gz = system.open_output_stream(at, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
            self.bytes = self.count = 0
        self.out.write(self.gz.compress(record))
        self.bytes, self.count = self.bytes + len(record), self.count + 1
        path = self.path
        if self.bytes >= ARCHIVE_BYTES or self.count >= ARCHIVE_RECORDS:
            self.close()
        return path

    def close(self) -> None:
        if self.path is not None:
            self.out.write(self.gz.flush())
            self.out.close()
            self.path = None


WRITTEN = "record_id long, payload_bytes long, payload_digest string, archive string, seq int"


def write_monolithic(pages: DataFrame, root: str, id_col: str, uri_col: str, payload_col: str) -> DataFrame:
    """Write every row as a response record; one row per record, see ``WRITTEN``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, at, seq = _ArchiveWriter(root), None, 0
        for batch in batches:
            rows = []
            for rid, uri, text in zip(batch["rid"], batch["uri"], batch["payload"]):
                payload = (text or "").encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                key = None if pd.isna(rid) else int(rid)
                path = writer.add(render_record(key, uri, payload, digest, len(payload)))
                seq = seq + 1 if path == at else 0
                at = path
                rows.append((key, len(payload), digest, path, seq))
            yield pd.DataFrame(rows, columns=["record_id", "payload_bytes", "payload_digest", "archive", "seq"]).astype(
                {"record_id": "Int64"}
            )
        writer.close()

    src = pages.select(
        pages[id_col].cast("long").alias("rid"),
        pages[uri_col].cast("string").alias("uri"),
        pages[payload_col].cast("string").alias("payload"),
    )
    return src.mapInPandas(run, WRITTEN)


def decide_revisits(scratch: Scratch, written: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: null for a response.

    Equal payloads are those of one digest and length.  The first record in
    order of (id, archive, position) is the response, so a repeated id still
    gives one response a payload.  Counting the first a digest is a partial
    aggregation; the join back has plain tables on both sides, so that a
    payload with a third of all rows is split.
    """
    here = F.struct("record_id", "archive", "seq")
    first = scratch.keep(
        written.where(f"record_id is not null and payload_bytes >= {int(min_bytes)}")
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(here).alias("first")),
        "first",
    )
    return written.join(first, ["payload_digest", "payload_bytes"], "left").select(
        "archive",
        "seq",
        F.when(F.col("first").isNotNull() & (F.col("first") != here), F.col("first.record_id")).alias("refers_to"),
    )


INDEX = "archive string, offset long, length long, index string"


def normalise(decisions: DataFrame, root: str, tasks: int = TASKS) -> DataFrame:
    """Rewrite every archive named in ``decisions`` (archive, seq, refers_to).

    One row a rewritten archive: (archive, source, index, records).  An archive
    holds at most ``ARCHIVE_RECORDS`` records, which bounds each group.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        source = group["archive"].iloc[0]
        refers = {int(s): (None if pd.isna(r) else int(r)) for s, r in zip(group["seq"], group["refers_to"])}
        target = f"{root}/{uuid.uuid4().hex}.warc.gz"
        system, at = _open(source)
        system2, at2 = _open(target)
        offset, lines = 0, []
        with (
            system.open_input_stream(at, compression=None) as stream,
            system2.open_output_stream(at2, compression=None) as out,
        ):
            for seq, (head, block) in enumerate(records(inflate(stream))):
                http, payload = split_http(block)
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                refers_to = refers.get(seq)
                rid = urn_record(head["warc-record-id"])
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = member.compress(
                    render_record(rid, head["warc-target-uri"], payload, digest, int(http["content-length"]), refers_to)
                )
                data += member.flush()
                out.write(data)
                lines.append(json.dumps({"id": rid, "offset": offset, "length": len(data), "digest": digest}))
                offset += len(data)
        index = target.removesuffix(".warc.gz") + ".cdxj"
        system3, at3 = _open(index)
        with system3.open_output_stream(at3) as out:
            out.write("".join(f"{x}\n" for x in lines).encode())
        return pd.DataFrame([(target, source, index, len(lines))], columns=["archive", "source", "index", "records"])

    # so many partitions as archives: the decisions are small, what a group reads is not
    tasks = max(1, min(tasks, decisions.select("archive").distinct().count()))
    spread = decisions.repartition(tasks, "archive")
    return spread.groupBy("archive").applyInPandas(one, "archive string, source string, index string, records long")


READ = (
    "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, "
    "archive string, offset long, length long"
)


def read_archives(archives: DataFrame, verify: bool = True) -> DataFrame:
    """Read records through the sidecar index, a member at a time.

    ``verify`` recomputes the digest of each response's payload and the place
    of each member, and raises where they differ from what was written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, index in zip(batch["archive"], batch["index"]):
                system, at = _open(index)
                with system.open_input_stream(at) as stream:
                    entries = [json.loads(x) for x in stream.read().decode().splitlines()]
                system, at = _open(archive)
                rows = []
                with system.open_input_file(at) as file:
                    for e in entries:
                        file.seek(e["offset"])
                        data = zlib.decompress(file.read(e["length"]), 31)
                        ((head, block),) = records(iter([data]))
                        http, payload = split_http(block)
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        rid = urn_record(head["warc-record-id"])
                        if verify and (
                            rid != e["id"]
                            or digest != e["digest"]
                            or head["warc-type"] == "response"
                            and (payload_digest(payload) != digest or len(payload) != int(http["content-length"]))
                        ):
                            raise ValueError(f"{archive} at {e['offset']}: the record differs from its index")
                        rows.append(
                            (rid, int(http["content-length"]), digest, head["warc-type"], urn_record(head.get("warc-refers-to")), head["warc-target-uri"], archive, e["offset"], e["length"])
                        )
                yield pd.DataFrame(
                    rows,
                    columns=["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "archive", "offset", "length"],
                ).astype({"record_id": "Int64", "refers_to": "Int64"})

    return columns_only(archives, "archive", "index").mapInPandas(run, READ)


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, tasks: int = TASKS
) -> DataFrame:
    """Write, normalise, index and read back; one row per row of ``pages``."""
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark)
    raw, done = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    from .common import delete_path

    for root in (raw, done):
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    written = scratch.keep(write_monolithic(pages, raw, id_col, uri_col, payload_col), "written")
    decisions = decide_revisits(scratch, written, min_bytes)
    archives = scratch.keep(normalise(decisions, done, tasks), "archives")
    delete_path(spark, raw)
    return read_archives(archives.repartition(max(1, min(archives.count(), tasks)), F.xxhash64("archive")))
