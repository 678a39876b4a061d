"""Embedding near-duplicates: iterative quantisation to 64-bit codes, multi-index Hamming tables, exact cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, components, known, shuffle_partitions, written

COSINE = 0.93
#: Vectors that the rotation is learned on, at most (those with the smallest hashes), and its steps.
SAMPLE, STEPS, BITS = 20_000, 40, 64
#: Parts of a code, each a table. Pairs are found that have a part with at most one differing bit: all pairs with
#: at most 2 * TABLES - 1 differing bits, and most of those with more. At the least cosine, 7.7 of 64 bits differ on average.
TABLES = 6
#: Candidates with more differing bits are not reranked; at the least cosine 1 pair in 10,000 has more.
FARTHEST = 18


def learn(x: np.ndarray, dimensions: int, bits: int = BITS, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """The projection whose signs are the code: principal directions, turned so that the signs lose little.

    Where the vectors have fewer dimensions than bits, turns from several random starts follow one another. The mean
    is not taken off: signs about the mean would part vectors of a small angle that lie near it.
    """
    rng = np.random.default_rng(seed)
    d = dimensions
    _, directions = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(d))
    parts, left = [], bits
    while left > 0:
        k = min(d, left)
        basis = directions[:, ::-1][:, :k]
        v = x @ basis
        turn = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(steps if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        parts.append(basis @ turn)
        left -= k
    return np.hstack(parts)


def codes(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits(x @ projection >= 0, axis=1, bitorder="little").view("<u8")[:, 0]


def part_bounds(tables: int = TABLES, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of each table's part."""
    cuts = [bits * k // tables for k in range(tables + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def vectors(embeddings: DataFrame, column: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, group, v): unit length in double precision, and null where the vector can link with nothing: null,
    zero, with null or non-finite components, or a null label. Vectors of other lengths are groups of their own."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(known("vec_id").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(column).cast("array<double>").alias("v"))
    most = F.array_max(F.transform(v, lambda c: F.abs(c)))
    usable = v.isNotNull() & F.col("label").isNotNull() & finite & (most > 0)
    scaled = rows.withColumn("v", F.when(usable, F.transform(v, lambda c: c / most)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    return scaled.withColumn("norm", norm).select("vec_id", F.concat(F.size("v").cast("string"), F.lit(":"), F.col("label")).alias("group"), F.transform(v, lambda c: c / F.col("norm")).alias("v"))


def _coded(classes: DataFrame, models: dict[int, np.ndarray]) -> DataFrame:
    """(cls, group, v, code)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            size = np.diff(lists.offsets.to_numpy())
            flat, out = lists.values.to_numpy()[lists.offsets[0].as_py() :], np.zeros(b.num_rows, np.uint64)
            starts = np.cumsum(size) - size
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                out[own] = codes(flat[starts[own][:, None] + np.arange(d)], models[d])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.view(np.int64))], ["cls", "group", "v", "code"])

    return classes.select("cls", "group", "v").mapInArrow(each, "cls long, group string, v array<double>, code long")


def candidates(coded: DataFrame, tables: int = TABLES, farthest: int = FARTHEST) -> DataFrame:
    """(a, b) classes of one group with a part that differs in one bit at most, each pair once."""
    bounds = part_bounds(tables)
    n = shuffle_partitions(coded.sparkSession)
    rows = []
    for t, (first, width) in enumerate(bounds):
        part = F.shiftrightunsigned("code", first).bitwiseAND(F.lit((1 << width) - 1))
        # A pair that differs in one bit meets where it is set: only the one without it looks there.
        number = F.lit(t).cast("long").alias("t")
        rows.append(F.struct(number, part.alias("key"), F.lit(False).alias("probe")))
        for k in range(width):
            probe = F.struct(number, part.bitwiseOR(F.lit(1 << k)).alias("key"), F.lit(True).alias("probe"))
            rows.append(F.when(part.bitwiseAND(F.lit(1 << k)) == 0, probe))
    dealt = coded.select("cls", "code", "group", F.explode(F.array(*rows)).alias("r")).where("r is not null")
    dealt = dealt.select(F.xxhash64("group", "r.t", "r.key").alias("h"), "r.t", "r.probe", "cls", "code")

    def near(x: np.ndarray, width: int, first: int) -> np.ndarray:
        return np.bitwise_count(x >> np.uint64(first) & np.uint64((1 << width) - 1)) <= 1

    def pairs(h: np.ndarray, t: np.ndarray, probe: np.ndarray, cls: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Home rows with later home rows and with probes, a block of a group at a time."""
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        a, b, held = [], [], 0
        for s, m in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            home = s + np.flatnonzero(~probe[s : s + m])
            every = np.r_[home, s + np.flatnonzero(probe[s : s + m])]
            for o in range(0, len(home), 512):
                i, j = home[o : o + 512], every[o:]
                x = code[i][:, None] ^ code[j]
                ok = np.bitwise_count(x) <= farthest
                ok &= np.arange(len(j)) > np.arange(len(i))[:, None]
                for k in range(int(t[s])):  # found in an earlier table
                    ok &= ~near(x, *bounds[k][::-1])
                p, q = np.nonzero(ok)
                a.append(cls[i[p]])
                b.append(cls[j[q]])
                held += len(p)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], ["a", "b"])
                    a, b, held = [], [], 0
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[4] = cols[4].view(np.uint64)
            held = cols if held is None else [np.r_[x, y] for x, y in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield from pairs(*(c[:cut] for c in held))
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield from pairs(*held)

    return dealt.repartition(n, "h").sortWithinPartitions("h").mapInArrow(each, "a long, b long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, tables: int = TABLES, farthest: int = FARTHEST) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of embeddings.

    Vectors link if their labels are equal and their cosine is `cosine` or more; those that cannot link (see vectors())
    are alone. Rows with the same vector and label are one class: its rows all link with each other and only the
    class goes to the tables. A null vec_id counts as the smallest. Rows that share a vec_id count as two vectors.
    tables and farthest decide what is compared: with `farthest` 64 every pair that shares a part up to one bit is, and with 22
    tables (43 bits may differ then, where 8 do at the least cosine on average) all but none; both cost more candidates.
    The sample is the bound of what the rotation is learned on, shared among vector lengths; one task ranks a fifth more rows than it holds.
    """
    rows = written(vectors(embeddings))
    usable = rows.where("v is not null")
    keyed = usable.withColumn("x1", F.xxhash64("group", "v")).withColumn("x2", F.xxhash64(F.lit(1), "group", "v"))
    classes = written(keyed.groupBy("x1", "x2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("group").alias("group"), F.first("v").alias("v")).withColumn("cls", F.col("x1")))
    counts = {r.d: r["count"] for r in classes.groupBy(F.size("v").alias("d")).count().collect()}  # by a vector's length, one as a rule
    sizes, share = list(counts), max(1, sample // max(1, len(counts)))
    # The smallest hashes of each length; few more than are wanted get as far as the one task that ranks them.
    below = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, min(2**63 - 1, int(-(2**63) + 2**64 * (1.2 * share + 100) / n)))] or [F.lit(0), F.lit(0)])
    first = Window.partitionBy(F.size("v")).orderBy("x1")
    few = classes.where(F.col("x1") <= below[F.size("v")])
    some = few.withColumn("place", F.row_number().over(first)).where(F.col("place") <= share).select("v").collect()
    models = {d: learn(np.array([r.v for r in some if len(r.v) == d]), d) for d in sizes}
    coded = written(_coded(classes, models))
    near = candidates(coded, tables, farthest)
    left = near.join(coded.select(F.col("cls").alias("a"), F.col("v").alias("va")), "a")
    both = left.join(coded.select(F.col("cls").alias("b"), F.col("v").alias("vb")), "b")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, c: s + c)
    links = written(both.where(dot >= cosine).select("a", "b"))
    ways = links.union(links.select(F.col("b"), F.col("a")))
    size = classes.select(F.col("cls").alias("b"), "n")
    others = ways.join(size, "b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    reach = components(links)
    of = classes.select("cls", "x1", "x2", "n", "least").join(others, "cls", "left").join(reach.withColumnRenamed("id", "cls"), "cls", "left")
    of = of.withColumn("root", F.coalesce("component", "cls"))
    least = of.groupBy("root").agg(F.min("least").alias("smallest"))
    of = of.join(least, "root").select("x1", "x2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "smallest")
    linked = keyed.select("vec_id", "x1", "x2").join(of, ["x1", "x2"]).select("vec_id", "n_links", "smallest")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("smallest"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return linked.unionByName(alone).select(null("vec_id").alias("vec_id"), "n_links", null("smallest").alias("component_id"), (F.col("vec_id") == F.col("smallest")).alias("kept"))
