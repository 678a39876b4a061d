"""Packing of documents in the order of a space-filling curve through their projected word vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .tokens import encoder

END_ID, CAPACITY = 1, 2048
#: Token ids are hashed to FEATURES, projected to DIMENSIONS of BITS each. SALT bits of a row's hash follow in the key: equal documents can be parted.
FEATURES, DIMENSIONS, BITS, SALT = 1024, 4, 10, 23
#: Standard deviations from the mean that the curve's cube covers; what lies further is put on its sides.
SPREAD = 2.5
#: Chunks of text that an encoder remembers, twice over, and documents handed on at once: bounds of a worker's memory.
KEEP, ROWS = 500_000, 1000


@lru_cache(maxsize=2)
def projection(features: int = FEATURES, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(12).standard_normal((features, dimensions))


def place(ids: np.ndarray) -> np.ndarray:
    """A document's point: logarithms of its hashed tokens' counts, of unit length, projected."""
    v = np.log1p(np.bincount((ids.astype(np.uint64) * 2654435761 >> 7) % FEATURES, minlength=FEATURES))
    return v @ projection() / max(np.linalg.norm(v), 1e-9)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of whole points below 2^bits, a point in each row (Skilling, Programming the Hilbert curve, 2004)."""
    x = points.T.astype(np.int64)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in x:
            is_set = (axis >> level & 1).astype(bool)
            moved = np.where(is_set, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(is_set, low, moved)
            axis ^= moved
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turned = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turned
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | axis >> level & 1
    return key


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n, point, salt, ids): every document's ids as little-endian 16-bit integers, the end id last."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, KEEP).encode, end_id.to_bytes(2, "little")
        for b in (x.slice(at, ROWS) for x in batches for at in range(0, max(x.num_rows, 1), ROWS)):
            raw = [encode(t.as_py() or "") + end for t in b.column(1)]
            points = [place(np.frombuffer(r, "<u2")).tolist() for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) // 2 for r in raw], pa.int64()), pa.array(points, pa.list_(pa.float64())), pa.array(raw, pa.binary())], names)

    names = ["doc_id", "n", "point", "ids"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, n long, point array<double>, ids binary")
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << SALT)))


def on_curve(rows: DataFrame) -> DataFrame:
    """rows with `key`: the point's place on the curve, scaled by the points' mean and spread over all documents, then the salt."""
    return rows.withColumn("key", curve_key(rows)("point", "salt"))


def curve_key(rows: DataFrame, bounds: np.ndarray | None = None):
    """A function of (point, salt): the key, or with bounds the struct of the key and the place of its range."""
    parts = [(F.avg(F.col("point")[k]), F.stddev_pop(F.col("point")[k])) for k in range(DIMENSIONS)]
    found = rows.agg(*[c for pair in parts for c in pair]).first()
    mean, spread = (np.array([v or 0.0 for v in found[k::2]]) for k in (0, 1))

    def keys(point: pd.Series, salt: pd.Series) -> np.ndarray:
        z = (np.array(point.tolist()).reshape(-1, DIMENSIONS) - mean) / np.where(spread > 0, spread, 1)
        at = hilbert(np.clip((z / SPREAD + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.int64), BITS)
        return (at << SALT) + salt.to_numpy()

    if bounds is None:
        return F.pandas_udf(lambda point, salt: pd.Series(keys(point, salt)), "long")

    def both(point: pd.Series, salt: pd.Series) -> pd.DataFrame:
        k = keys(point, salt)
        return pd.DataFrame({"key": k, "part": np.searchsorted(bounds, k, side="left").astype(np.int32)})

    return F.pandas_udf(both, "key long, part int")


def edges(total: int, capacity: int) -> np.ndarray:
    """Where the sequences after the last full one begin: what is left over is parted into powers of two, which need no padding."""
    at = [total - total % capacity]
    for k in range(capacity.bit_length(), -1, -1):
        if total % capacity >> k & 1:
            at.append(at[-1] + (1 << k))
    return np.array(at)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of every document. Documents follow
    one another along the curve and fill sequence after sequence without a gap; a document that meets a sequence's end goes on in the next.

    The key's quantiles, weighed by tokens, deal the documents into ranges, so that neighbours meet in one task and equal documents, told apart
    by their salt, are dealt over as many tasks as they need. Only the quantiles and each range's number of tokens go to the driver.
    Null text: the end id alone. Null or repeated doc_ids: each row is a document of its own; rows alike in all
    are interchangeable. Very long documents run over many sequences. No rows: no rows.
    """
    rows = written(tokenised(docs, tokenizer, end_id))
    parts = shuffle_partitions(docs.sparkSession)
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)] or [F.lit(1.0)])
    weighed = on_curve(rows.select("n", "point", "salt")).select("key", F.explode(F.expr("sequence(1, ceil(n / 1024))")))  # by tokens
    cuts = weighed.agg(F.percentile_approx("key", shares, 50 * parts + 10_000)).first()[0]
    bounds = np.unique(np.array(cuts or [0], np.int64))
    dealt = rows.withColumn("at", curve_key(rows, bounds)("point", "salt")).select("doc_id", "n", "ids", "at.key", "at.part")
    tokens = np.zeros(len(bounds) + 2, np.int64)
    for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect():  # a row for each range
        tokens[r.part + 1] = r.n
    base = tokens.cumsum()
    total, tail = int(base[-1]), edges(int(base[-1]), capacity)
    full = total // capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = -1, 0
        for b in batches:
            out: list[tuple] = []
            for p, i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if p != now:
                    now, at = p, int(base[p])
                ids = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    s = min(at // capacity, full)
                    s, begin, end = (s, s * capacity, (s + 1) * capacity) if s < full else (full + (k := int(tail.searchsorted(at, "right")) - 1), int(tail[k]), int(tail[k + 1]))
                    own = ids[start : start + end - at]
                    out.append((i, start, len(own), zlib.crc32(own.tobytes()), len(ids), s, at - begin, *([own.astype("<i4")] if with_ids else [])))
                    start, at = start + len(own), at + len(own)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids, strict=True)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    near = dealt.select("part", "doc_id", "ids", "key").repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "doc_id", "ids")
    return near.mapInArrow(cut, ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names))
