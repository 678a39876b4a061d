"""WARC archives: written as one gzip stream each, then normalised to a member for each record with an offset index."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import known, put_file, shared_dir, shuffle_partitions, store, written

#: Payload bytes in an archive, unless a single record has more.
ARCHIVE = 1 << 26
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; it names the payload's digest, length and record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", "".join((url or "").splitlines())),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive, from its parts in order; holds one record at a time."""
    held, need = bytearray(), None
    for part in stream:
        held += part
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(_fields(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def inflate(f, size: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's content in parts, whether it is one member or many."""
    d = zlib.decompressobj(31)
    while part := f.read(size):
        while part:
            yield d.decompress(part)
            part = d.unused_data
            if part:
                d = zlib.decompressobj(31)


def deflate(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def normalise(f) -> tuple[bytes, list[tuple[int, int]]]:
    """Inflates a whole archive once; returns it with a gzip member for each record, and their (offset, length)."""
    out, index = io.BytesIO(), []
    for raw in records(inflate(f)):
        member = deflate(raw)
        index.append((out.tell(), len(member)))
        out.write(member)
    return out.getvalue(), index


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record, checked against its payload."""
    head, _, block = raw.partition(b"\r\n\r\n")
    f = _fields(head)
    block = block[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    of = lambda name: int(x) if (x := f[name].removeprefix("<urn:page:").removesuffix(">")) else None
    said, size = f["warc-payload-digest"].removeprefix("sha1:"), int(_fields(http)["content-length"])
    if f["warc-type"] == "revisit":
        return of("warc-record-id"), size, said, "revisit", of("warc-refers-to")
    if digest(payload) != said or len(payload) != size:
        raise ValueError("payload and digest differ")
    return of("warc-record-id"), size, said, "response", None


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload binary, first long, revisit): which record others with an equal payload refer to.

    Of pages whose payloads are equal and have least_bytes or more, the largest page_id is the response; rows that
    share this page_id all are. A null page_id counts as the smallest. Null html is the empty payload.
    """
    rows = pages.select(known("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    several = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.min("page_id").alias("last"))
    # Which pages share a payload is told by digests alone; payloads are dealt by page, so one that most pages have is spread.
    marks = keyed.select("page_id", "sha").distinct().join(several.where("first <> last"), "sha").select("page_id", "sha", "first")
    return keyed.join(marks, ["page_id", "sha"], "left").select("page_id", "url", "payload", "first", F.coalesce(F.col("first") != F.col("page_id"), F.lit(False)).alias("revisit"))


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes every page's record and returns the index, (archive, offset, length), one row for each record.

    A task writes its archive as a single gzip stream, then reads it back and writes the normalised one beside it
    with its index (.cdx: offset and length on each line); the stream is deleted then. File names hold the task's attempt.
    """
    folder = folder or shared_dir(pages.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, attempt, part, n = store(folder), uuid.uuid4().hex, TaskContext.get().partitionId(), 0
        c, raw, size = None, io.BytesIO(), 0

        def close() -> pa.RecordBatch:
            path = f"{files[1]}/{part:07d}-{n:05d}-{attempt}"  # the index names the attempt that counts
            put_file(files[0], f"{path}.single.warc.gz", raw.getvalue() + c.flush(), attempt)
            with files[0].open_input_file(f"{path}.single.warc.gz") as f:
                content, index = normalise(f)
            put_file(files[0], f"{path}.warc.gz", content, attempt)
            put_file(files[0], f"{path}.cdx", "".join(f"{a} {b}\n" for a, b in index).encode(), attempt)
            files[0].delete_file(f"{path}.single.warc.gz")
            name = path.rpartition("/")[2] + ".warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name] * len(index), pa.string()), *(pa.array(x, pa.int64()) for x in zip(*index, strict=True))], ["archive", "offset", "length"])

        for b in batches:
            for i, url, payload, first, revisit in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c is None:
                    c, raw, size = zlib.compressobj(1, zlib.DEFLATED, 31), io.BytesIO(), 0
                own = lambda x: None if x in (None, -(2**63)) else x
                raw.write(c.compress(record(own(i), url, payload, own(first), revisit)))
                size += len(payload)
                if size >= ARCHIVE:
                    yield close()
                    c, n = None, n + 1
        if c is not None:
            yield close()

    done = written(marked(pages, least_bytes).mapInArrow(each, "archive string, offset long, length long"))
    return done.withColumn("archive", F.concat(F.lit(folder + "/"), "archive"))


def read(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record that the index names."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for b in batches:
            rows = []
            for archive, offset, length in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if archive != path:
                    files, local = store(archive)
                    path, f = archive, files.open_input_file(local)
                f.seek(offset)
                rows.append(parse(zlib.decompress(f.read(length), 31)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], names)

    names, kinds = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    n = shuffle_partitions(index.sparkSession)
    dealt = index.repartition(n, "archive", F.floor(F.col("offset") / (1 << 20))).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
