"""Best-fit packing of tokenised documents by the linear grouping scheme, planned on the counts of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder

END_ID, CAPACITY, GROUPS, SALTS = 2, 1024, 512, 1024
#: Lengths over this part of the capacity are large. The small ones must be able to fill what rounding leaves open.
LARGE = 0.4


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what is left over."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; null text is empty, its only id the end id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, end_id.to_bytes(2, "little")
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(encode(t.as_py() or "") + end, "<u2").astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[s : s + n]
                    rows.append((i, k, s, n, zlib.crc32(part.tobytes()), *([part.astype("<i4")] if with_ids else [])))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema(list(zip(names, kinds, strict=True))))

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, schema)


@dataclass
class Bins:
    """`count` sequences alike: the j-th holds, for each (length, rank), the document of that length with rank + j."""

    count: int
    room: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def take(self, n: int) -> Bins:
        """Splits the first n off."""
        head = Bins(n, self.room, list(self.items))
        self.count -= n
        self.items = [(length, rank + n) for length, rank in self.items]
        return head


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000, gap: float = 5e-4) -> list[tuple[np.ndarray, float]]:
    """Sets of sizes that fit, and how often each is used, by column generation: the cheapest fractional cover,
    or one within `gap` of it."""
    w, d, m = np.array(sizes), np.array(demand, float), len(sizes)
    columns = np.diag(capacity // w).astype(float)
    x = d / np.diag(columns)
    inverse = np.diag(1 / np.diag(columns))
    reach = np.maximum(np.arange(capacity + 1)[:, None] - w, -1)  # room left by each size, -1: none
    most = capacity // int(w.min())
    for n in range(1, rounds):
        value = inverse.sum(0)
        best, picks = np.zeros(capacity + 2), []  # the last entry is that of room -1
        best[-1] = -np.inf
        for _ in range(most):
            gain = best[reach] + value
            k = gain.argmax(1)
            now = gain[np.arange(capacity + 1), k]
            picks.append(np.where(now > best[:-1] + 1e-12, k, -1))
            if (picks[-1] < 0).all():
                break
            best[:-1] = np.maximum(best[:-1], now)
        if best[capacity] <= 1 + gap:
            break
        new, c = np.zeros(m), capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                new[pick[c]] += 1
                c -= int(w[pick[c]])
        step = inverse @ new
        ratio = np.where(step > 1e-9, x / np.maximum(step, 1e-9), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        columns[:, out], x[out] = new, ratio[out]
        if n % 100:
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
        else:
            inverse = np.linalg.inv(columns)
    return [(columns[:, k].astype(int), float(x[k])) for k in range(m)]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Bins]:
    """Sequences for so many documents of each length (1 to capacity). Size and time follow capacity and groups,
    not the number of documents.

    Lengths over LARGE of the capacity are large. Sorted, they fall into groups of equal numbers of
    documents and count as their group's largest length; configurations of these few lengths are chosen, the group's
    documents take their places at their own lengths, and what is left, then the small ones, goes largest first
    to the sequence with the least room that takes it.
    """
    bins = [Bins(counts[capacity], 0, [(capacity, 0)])] if counts.get(capacity) else []
    free = {n: [0, c] for n, c in counts.items() if 0 < n < capacity and c > 0}  # the next rank, how many are left
    large = sorted((n for n in free if n > capacity * LARGE), reverse=True)
    share = -(-sum(free[n][1] for n in large) // groups) or 1
    members: dict[int, list[list[int]]] = {}  # by rounded length: [length, first rank, number]
    used, top = share, 0
    for n in large:
        rank, left = 0, free[n][1]
        while left:
            if used == share:
                top, used = n, 0
            k = min(left, share - used)
            members.setdefault(top, []).append([n, rank, k])
            rank, left, used = rank + k, left - k, used + k
    if members:
        sizes = list(members)
        whole = [(c, int(x)) for c, x in configurations(sizes, [sum(r[2] for r in members[s]) for s in sizes], capacity) if x >= 1]
        for config, n in whole:
            open_bins = [Bins(n, capacity)]
            for k in np.repeat(np.arange(len(sizes)), config).tolist():
                rows, placed = members[sizes[k]], []
                for b in open_bins:
                    while b.count and rows:
                        head = b.take(min(b.count, rows[0][2]))
                        head.items.append((rows[0][0], rows[0][1]))
                        head.room -= rows[0][0]
                        placed.append(head)
                        rows[0][1] += head.count
                        rows[0][2] -= head.count
                        if not rows[0][2]:
                            rows.pop(0)
                    placed += [b] if b.count else []
                open_bins = placed
            bins += [b for b in open_bins if b.items]
    left: list[list[int]] = [r for rows in members.values() for r in rows] + [[n, 0, free[n][1]] for n in free if n <= capacity * LARGE]
    by_room: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for b in bins:
        by_room[b.room].append(b)
    for n, rank, many in sorted(left, reverse=True):
        while many:
            room = next((r for r in range(n, capacity + 1) if by_room[r]), None)
            if room is None:
                by_room[capacity].append(Bins(-(-many // (capacity // n)), capacity))
                room = capacity
            b = by_room[room].pop()
            if b.count > many:
                by_room[room].append(b)
                b = b.take(many)
            b.items.append((n, rank))
            b.room -= n
            by_room[b.room].append(b)
            rank, many = rank + b.count, many - b.count
    return [b for row in by_room for b in row if b.items]


def ranked(rows: DataFrame) -> DataFrame:
    """rows with `rank`, from 0 within each length. A length's rows are dealt over SALTS groups by hash, so that a
    length that most documents share is no single group."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return salted.withColumn("own", own).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own")).drop("salt", "own", "base")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document with sequence_id and offset, gapless from 0 in each sequence.

    Null text: the end id alone. Null or repeated doc_ids: each row is a document of its own. No rows: no rows.
    Only the counts of lengths, `capacity` at most, go to the driver; the plan made of them is broadcast and is
    bounded by capacity and groups.
    """
    rows = written(pieces(docs, tokenizer, capacity, end_id, with_ids))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    steps, sequence = [], 0
    for b in plan(counts, capacity):
        offset = 0
        for length, rank in b.items:
            steps.append((length, rank, rank + b.count, sequence - rank, offset))
            offset += length
        sequence += b.count
    steps_df = docs.sparkSession.createDataFrame(steps, "length long, low long, high long, shift long, offset long")
    placed = ranked(rows).join(F.broadcast(steps_df), "length").where("rank >= low and rank < high")
    return placed.select(*rows.columns, (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")
