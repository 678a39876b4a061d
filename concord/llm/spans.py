"""Repeated windows of bytes: a depth-limited radix order of suffixes, and removal of what starts earlier elsewhere.

Two windows of WINDOW bytes are equal only if their least GRAM-byte hash (the leftmost of the least) lies at the
same place in both. So suffixes need no order one by one: the first digit of a window is the gram at that place (its
anchor), the second its whole surroundings, the last the window itself. Each pass deals only what the digit
before left in a group with others:
  1. anchors by gram: an anchor that no other shares ends here;
  2. in a gram's group, by surroundings: all but the first of equal surroundings are repeats, whole;
  3. first ones whose gram has other surroundings too: by the bytes on either side of the gram in quarter steps,
     since a window's two ends must both be shared;
  4. what these leave: window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, known, shuffle_partitions, written

WINDOW, GRAM, STEPS = 100, 24, 4
#: Bytes looked at in one go.
CHUNK = 1 << 20
_C = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _words(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as integers."""
    out = np.empty(len(b) - 7, "<u8")
    raw = b.tobytes()
    for k in range(8):
        n = len(range(k, len(out), 8))
        out[k::8] = np.frombuffer(raw, "<u8", n, k)
    return out


def _grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    w = _words(b)
    n = len(b) - GRAM + 1
    h = w[:n] * _C[0]
    h ^= h >> np.uint64(29)
    h += w[8 : 8 + n]
    h *= _C[1]
    h ^= h >> np.uint64(32)
    h += w[16 : 16 + n]
    h *= _C[2]
    h ^= h >> np.uint64(29)
    return h


def _least(key: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n neighbours."""
    out, have = key, 1
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == n else np.minimum(out[: len(out) - (n - have)], out[n - have :])


def anchors(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, place, first window start, last window start, gram, surroundings) of every anchor of the texts.

    Each text's windows fall into runs with one anchor; a run is cut where a chunk ends, which changes no result.
    """
    found: list[tuple] = []
    wide = window - GRAM + 1

    def chunk(parts: list[tuple[int, int, bytes]]) -> None:
        """parts: (text, offset, bytes), each with one window at least."""
        raw = b"".join(p for _, _, p in parts)
        b = np.frombuffer(raw, np.uint8)
        size = np.array([len(p) for _, _, p in parts])
        base = np.cumsum(size) - size
        h = _grams(b)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        place = (_least(key, wide) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by window start
        valid = np.zeros(len(place) + 1, bool)
        for a, s in zip(base.tolist(), size.tolist(), strict=True):
            valid[a : a + s - window + 1] = True
        own = np.flatnonzero(valid[:-1])
        at = place[own]
        part = np.searchsorted(base, own, "right") - 1
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])])
        first, last = own[new], own[np.r_[new[1:], len(own)] - 1]
        at, part = at[new], part[new]
        view, seed = memoryview(raw), (at - first).tolist()
        around = np.fromiter((xxhash.xxh3_64_intdigest(view[a:z], s) for a, z, s in zip(first.tolist(), (last + window).tolist(), seed, strict=True)), np.uint64, len(at))
        shift = np.array([o for _, o, _ in parts])[part] - base[part]
        text = np.array([t for t, _, _ in parts])[part]
        found.append((text, at + shift, first + shift, last + shift, h[at].view(np.int64), around.view(np.int64)))

    parts, size = [], 0
    for t, b in enumerate(texts):
        for o in range(0, len(b) - window + 1, CHUNK):
            p = b[o : o + CHUNK + window - 1]
            parts.append((t, o, p))
            size += len(p)
            if size >= CHUNK:
                chunk(parts)
                parts, size = [], 0
    if parts:
        chunk(parts)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(6))


ANCHOR = "doc long, th long, at long, first int, last int, gram long, around long"


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o in range(0, b.num_rows, 256):
                s = b.slice(o, 256)
                t, at, first, last, gram, around = anchors([x.as_py() for x in s.column(2)], window)
                doc, th = (s.column(k).to_numpy()[t] if len(t) else np.zeros(0, np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, th, at, (at - first).astype(np.int32), (last - at).astype(np.int32), gram, around)], ["doc", "th", "at", "first", "last", "gram", "around"])

    return docs.where(F.octet_length("b") >= window).select("doc", "th", "b").mapInArrow(each, ANCHOR)


def _judged(dealt: DataFrame) -> DataFrame:
    """Anchors that repeat or share their gram: (doc, th, a, z, repeat, at, gram), window starts from a to z. dealt: by gram, sorted by gram."""

    def groups(cols: list[np.ndarray]) -> pa.RecordBatch:
        doc, th, at, first, last, gram, around = cols
        order = np.lexsort((at, doc, around, gram))
        doc, th, at, first, last, gram, around = (c[order] for c in cols)
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new_both = new_gram | np.r_[True, around[1:] != around[:-1]]
        both, grams = np.cumsum(new_both) - 1, np.cumsum(new_gram) - 1
        start = np.flatnonzero(new_both)
        repeat = (doc != doc[start][both]) | (at != at[start][both])
        kinds = np.bincount(grams, weights=new_both)
        keep = repeat | (kinds[grams] > 1)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (doc, th, at - first, at + last, repeat, at, np.where(repeat, 0, gram))], ["doc", "th", "a", "z", "repeat", "at", "gram"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            held = cols if held is None else [np.r_[x, y] for x, y in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(held[5], held[5][-1])) if len(held[5]) else 0
            if cut:
                yield groups([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield groups(held)

    return dealt.mapInArrow(each, "doc long, th long, a long, z long, repeat boolean, at long, gram long")


def _sides(met: DataFrame, window: int) -> DataFrame:
    """(gram, doc, th, at, a, z, sides): hashes of the bytes left and right of the gram, a quarter of the window's rest more
    each time, 0 where the text ends before. met: (doc, th, b, ask array of (a, z, at, gram))."""
    steps = [(window - GRAM) * k // STEPS for k in range(1, STEPS + 1)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for d, t, text, ask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                view = memoryview(text.as_py())
                for r in ask:
                    p, e = r["at"], r["at"] + GRAM
                    left = [xxhash.xxh3_64_intdigest(view[p - k : p]) if p >= k else 0 for k in steps]
                    right = [xxhash.xxh3_64_intdigest(view[e : e + k]) if e + k <= len(view) else 0 for k in steps]
                    for c, x in zip(rows, (r["gram"], d, t, p, r["a"], r["z"], np.array(left + right, np.uint64).view(np.int64)), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:6]), pa.array(rows[6], pa.list_(pa.int64()))], ["gram", "doc", "th", "at", "a", "z", "sides"])

    return met.mapInArrow(each, "gram long, doc long, th long, at long, a long, z long, sides array<long>")


def _narrowed(dealt: DataFrame, window: int) -> DataFrame:
    """(doc, th, a, z): the window starts left, where another anchor of the gram shares both ends up to a step. dealt: by gram."""
    rest = window - GRAM
    steps = np.array([rest * k // STEPS for k in range(STEPS + 1)])
    reach = np.r_[steps[1:-1] - 1, steps[-1] - 1, rest]  # how far windows go whose first unshared step is the next

    def groups(gram: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray, a: np.ndarray, z: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
        far = []
        for side in (sides[:, :STEPS], sides[:, STEPS:]):
            shared = np.zeros((len(gram), STEPS + 1), bool)
            for k in range(STEPS):
                order = np.lexsort((side[:, k], gram))
                same = (gram[order][1:] == gram[order][:-1]) & (side[order, k][1:] == side[order, k][:-1])
                shared[order, k] = (np.r_[False, same] | np.r_[same, False]) & (side[order, k] != 0)
            far.append(reach[np.argmin(shared, axis=1)])
        low, high = np.maximum(a, at - far[0]), np.minimum(z, at - (rest - far[1]))
        ok = low <= high
        return pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (doc, th, low, high)], ["doc", "th", "a", "z"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [c.to_numpy() for c in b.columns[:6]]
            cols.append(b.column(6).flatten().to_numpy().reshape(-1, 2 * STEPS))
            held = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield groups(*(c[:cut] for c in held))
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield groups(*held)

    return dealt.mapInArrow(each, "doc long, th long, a long, z long")


def _windows(met: DataFrame, window: int) -> DataFrame:
    """(w1, w2, doc, th, a): each asked window, with 128 bits of hash. met: (doc, th, b, ask array of (a, z))."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o in range(0, b.num_rows, 64):
                s = b.slice(o, 64)
                doc, th, at, w = [], [], [], []
                for d, t, text, ask in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), s.column(2), s.column(3).to_pylist(), strict=True):
                    view = memoryview(text.as_py())
                    for r in ask:
                        for k in range(r["a"], r["z"] + 1):
                            w.append(xxhash.xxh3_128_digest(view[k : k + window]))
                            at.append(k)
                        doc += [d] * (r["z"] - r["a"] + 1)
                        th += [t] * (r["z"] - r["a"] + 1)
                h = np.frombuffer(b"".join(w), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h[:, 0], h[:, 1], doc, th, at)], ["w1", "w2", "doc", "th", "a"])

    return met.mapInArrow(each, "w1 long, w2 long, doc long, th long, a long")


def _later(dealt: DataFrame) -> DataFrame:
    """(doc, th, a, z) of the windows that are not their text's first. dealt: by w1, sorted by w1, w2, doc and a; a
    group is read past its first row without being held."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            w1, w2, doc, th, at = (c.to_numpy() for c in b.columns)
            new = np.r_[last is None or (w1[0], w2[0]) != last[:2], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
            first = np.maximum.accumulate(np.where(new, np.arange(len(w1)), -1))
            old = (0, 0) if last is None else last[2:]
            first_doc = np.where(first < 0, old[0], doc[first])
            first_at = np.where(first < 0, old[1], at[first])
            late = (doc > first_doc) | ((doc == first_doc) & (at > first_at))
            last = (w1[-1], w2[-1], first_doc[-1], first_at[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[late]) for c in (doc, th, at, at)], ["doc", "th", "a", "z"])

    return dealt.mapInArrow(each, "doc long, th long, a long, z long")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end) spans; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[new], e[np.r_[new[1:], len(s)] - 1] if len(s) else e


def _based(docs: DataFrame) -> DataFrame:
    """(doc, th, b, row): each text's bytes and what it is known by."""
    return docs.select(known("doc_id").alias("doc"), F.xxhash64("text").alias("th"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("b"), F.struct(*docs.columns).alias("row"))


def _gone(texts: DataFrame, window: int) -> DataFrame:
    """(doc, th, gone array of (a, z)): window starts whose window starts earlier elsewhere. texts: (doc, th, b), joined twice
    in one plan, so that their exchange is used again."""
    n = shuffle_partitions(texts.sparkSession)
    judged = written(_judged(_anchors(texts, window).repartition(n, "gram").sortWithinPartitions("gram")))
    asked = judged.where("not repeat").groupBy("doc", "th").agg(F.collect_set(F.struct("a", "z", "at", "gram")).alias("ask"))
    sides = _sides(texts.join(asked, ["doc", "th"]).select("doc", "th", "b", "ask"), window)
    narrow = _narrowed(sides.repartition(n, "gram").sortWithinPartitions("gram"), window)
    ask = narrow.groupBy("doc", "th").agg(F.collect_set(F.struct("a", "z")).alias("ask"))
    single = _windows(texts.join(ask, ["doc", "th"]).select("doc", "th", "b", "ask"), window)
    late = _later(single.repartition(n, "w1").sortWithinPartitions("w1", "w2", "doc", "a"))
    spans = judged.where("repeat").select("doc", "th", "a", "z").union(late)
    return spans.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "z")).alias("gone"))


def _applied(met: DataFrame, window: int) -> DataFrame:
    """met's first column, (b, gone) taken, with kept and spans."""
    first = met.columns[0]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans = [], []
            size = [len(x.as_py()) for x in b.column(1)]
            for text, gone in zip(b.column(1), b.column(2), strict=True):
                raw, runs = text.as_py(), []
                if gone.is_valid:
                    g = gone.values
                    s, e = merged(g.field(0).to_numpy(), g.field(1).to_numpy() + window)
                    runs = list(zip(s.tolist(), e.tolist(), strict=True))
                    cuts = [0, *(x for r in runs for x in r), len(raw)]
                    raw = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                kept.append(raw)
                spans.append([{"start": x, "end": y} for x, y in runs])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [first, "n_bytes", "kept", "spans"])

    kind = met.schema[first].dataType.simpleString()
    return met.select(first, "b", "gone").mapInArrow(each, f"{first} {kind}, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs' own columns with kept (binary) and spans (array of (start, end)): the bytes of the text that are covered
    by a string of `window` bytes that also starts earlier, in a smaller doc_id or before in the same text, are removed.

    Null or empty text has no bytes. A null doc_id counts as the smallest. Rows that share a doc_id are texts of
    their own that start at the same places: neither is earlier than the other at an equal start.
    """
    rows = _based(docs.select(*[c for c in docs.columns if c not in ("kept", "spans")]))
    met = rows.join(_gone(rows.select("doc", "th", "b"), window), ["doc", "th"], "left")
    return _applied(met.select("row", "b", "gone"), window).select("row.*", "kept", "spans")


def summary(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document, by the rules of repeats()."""
    texts = _based(docs.select("doc_id", "text")).select("doc", "th", "b")
    done = _applied(texts.join(_gone(texts, window), ["doc", "th"], "left").select("doc", "b", "gone"), window)
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return done.select(doc_id, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
