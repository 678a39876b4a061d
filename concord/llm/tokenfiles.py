"""Token files: ids by frequency rank, one to four bytes each, two control bits for each id in bytes of their own.

A file: magic, number of ranked ids and those ids (32-bit); then blocks of whole documents: numbers of
documents, ids and data bytes (64-bit), doc_ids (64-bit), null flags (bytes), id counts (64-bit), control bytes, data.
Each file ranks the ids by its own counts and can be read alone. All integers are little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import known, put_file, shared_dir, shuffle_partitions, store, written
from .tokens import encoder

MAGIC, END_ID = b"RANKVB01", 2
#: Ids in a block and in a file, unless a single document has more.
BLOCK, FILE = 1 << 20, 1 << 25
#: Byte counts of the four values of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1
PLACES = np.arange(4, dtype=np.uint8)


def pack_values(v: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = v.astype("<u4").view(np.uint8).reshape(-1, 4)[PLACES < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The values again, by table lookup."""
    size = LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[PLACES < size[:, None]] = data
    return out.view("<u4").reshape(-1)


def data_bytes(control: np.ndarray, n: int) -> int:
    return int(LENGTHS[control].reshape(-1)[:n].sum())


def to_file(documents: list[tuple[int | None, np.ndarray]]) -> bytes:
    """One file's content, its documents in the given order."""
    every = [ids for _, ids in documents]
    counts = np.bincount(np.concatenate(every)) if every else np.zeros(0, np.int64)
    ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    out = [MAGIC, np.array([len(ranked)], "<i8").tobytes(), ranked.astype("<u4").tobytes()]
    at = 0
    while at < len(documents):
        to, size = at, 0
        while to < len(documents) and (to == at or size + len(every[to]) <= BLOCK):
            size += len(every[to])
            to += 1
        control, data = pack_values(rank_of[np.concatenate(every[at:to])])
        out.append(np.array([to - at, size, len(data)], "<i8").tobytes())
        out.append(np.array([i or 0 for i, _ in documents[at:to]], "<i8").tobytes())
        out.append(bytes(i is None for i, _ in documents[at:to]))
        out += [np.array([len(x) for x in every[at:to]], "<i8").tobytes(), control, data]
        at = to
    return b"".join(out)


def from_file(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """The (doc_id, ids) of a file, a block at a time."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    n = int(np.frombuffer(content, "<i8", 1, 8)[0])
    ranked, at = np.frombuffer(content, "<u4", n, 16), 16 + 4 * n
    while at < len(content):
        docs, values, size = np.frombuffer(content, "<i8", 3, at).tolist()
        at += 24
        ids = np.frombuffer(content, "<i8", docs, at).tolist()
        at += 8 * docs
        unknown = content[at : at + docs]
        at += docs
        counts = np.frombuffer(content, "<i8", docs, at)
        at += 8 * docs
        control = np.frombuffer(content, np.uint8, -(-values // 4), at)
        at += len(control)
        v = ranked[unpack_values(control, np.frombuffer(content, np.uint8, size, at), values)]
        at += size
        for i, null, part in zip(ids, unknown, np.split(v, np.cumsum(counts)[:-1]), strict=True):
            yield (None if null else i), part


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of every document, the end id last, in ascending doc_id order, and returns the files:
    (file, part, k, n_docs, n_tokens); file after file by (part, k) is the whole order.

    Null text is empty; a null doc_id comes first; rows that share a doc_id are ordered by their text's hash.
    """
    folder = folder or shared_dir(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, files = encoder(tokenizer).encode, end_id.to_bytes(2, "little"), store(folder)
        part, attempt, rows = TaskContext.get().partitionId(), uuid.uuid4().hex, []
        own: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> None:
            path = f"{files[1]}/{part:07d}-{len(rows):05d}.tok"
            put_file(files[0], path, to_file(own), attempt)
            rows.append((path.rpartition("/")[2], part, len(rows), len(own), size))

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(encode(t.as_py() or "") + end, "<u2")
                if own and size + len(ids) > FILE:
                    flush()
                    own, size = [], 0
                own.append((i, ids))
                size += len(ids)
        if own:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], names)

    names, kinds = ["file", "part", "k", "n_docs", "n_tokens"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [known("doc_id"), F.col("doc_id").isNotNull(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    done = written(dealt.mapInArrow(each, "file string, part long, k long, n_docs long, n_tokens long"))
    return done.withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files that write() returned."""
    before = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, path = store(uri)
                with files.open_input_file(path) as f:
                    content = f.read()
                rows = []
                for i, ids in from_file(content):
                    rows.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = bases.repartition(shuffle_partitions(files.sparkSession), "file")
    return dealt.mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")
