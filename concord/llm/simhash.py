"""SimHash near-duplicates: fingerprints, pigeonhole blocks, checked Hamming distance, linked groups.

Two forms. near_duplicates(): 64 bits of three-word shingles, at most three of them different; its blocks miss no such
pair. first_of_groups(): texts whose sets of five-word shingles have a similarity of 0.8 or more. Their 64-bit fingerprints
differ in 10 bits on average, which no blocks can hold, so there the fingerprints are longer: many blocks of
bits over word pairs, of which close texts share some, and other bits over five-word shingles to measure the distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, known, shuffle_partitions, text_key, whole_groups, written

SEED = 42
#: Four blocks of 16 bits; the other 48 bits are four blocks of 12. Two words that differ in at most
#: three bits agree on one block of the first kind and on one of the second kind beside it.
WIDE, NARROW, MAX_DISTANCE = 16, 12, 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of every shingle (unsigned); zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII blanks and A-Z only
    if not words:
        return 0
    whole = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)), strict=False)] or [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(whole), 65536):
        part = whole[at : at + 65536]
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(whole), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): one row per document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, fp long")


def forest(words: np.ndarray, most: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """Links of at most that many bits that connect whatever all such links connect: one fewer than members.
    words: a row of 64-bit words for each member. Members near each other cost one pass over the rest for each that
    others are linked to; the square of their number only where none is near another."""
    left, out = np.arange(1, len(words)), []
    queue = [0]
    while left.size:
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        at = queue.pop()
        near = np.bitwise_count(words[left] ^ words[at]).sum(1) <= most
        for k in left[near].tolist():
            out.append((at, k))
            queue.append(k)
        left = left[~near]
    return out


def block_keys(fp: str = "fp") -> list:
    """The 16 (wide, narrow) block keys of a fingerprint, each a struct of its number and its bits."""
    keys = []
    for i in range(64 // WIDE):
        wide = F.shiftrightunsigned(fp, WIDE * i).bitwiseAND(F.lit((1 << WIDE) - 1))
        low = F.col(fp).bitwiseAND(F.lit((1 << (WIDE * i)) - 1)) if i else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, WIDE * (i + 1)), WIDE * i) if i < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for j in range((64 - WIDE) // NARROW):
            bits = F.shiftrightunsigned(rest, NARROW * j).bitwiseAND(F.lit((1 << NARROW) - 1))
            number = F.lit((i * 4 + j) << (WIDE + NARROW)).cast("long")
            keys.append(number.bitwiseOR(F.shiftleft(wide, NARROW)).bitwiseOR(bits))
    return keys


def _linked(dealt: DataFrame, most: int, kind: str) -> DataFrame:
    """(a, b) of rows (k, id, word) whose k is equal and whose words differ in `most` bits or fewer: enough links of each
    block to connect what all of them connect. dealt: by k, sorted by k; word: a long, or bytes in a multiple of eight."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            k, ids = t.column(0).to_numpy(), t.column(1)
            w = t.column(2).to_numpy().view(np.uint64)[:, None] if kind == "long" else np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint64).reshape(len(k), -1)
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[first, len(k)])
            two = first[size == 2]
            two = two[np.bitwise_count(w[two] ^ w[two + 1]).sum(1) <= most]
            a, b = [two], [two + 1]
            for f, s in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if found := forest(w[f : f + s], most):
                    x, y = np.array(found).T
                    a.append(f + x)
                    b.append(f + y)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(x))).combine_chunks() for x in (a, b)], ["a", "b"])

    return dealt.mapInArrow(each, f"a {kind}, b {kind}").distinct()


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) fingerprints at most three bits apart, enough of them to connect every group. distinct: (fp)."""
    rows = distinct.select(F.explode(F.array(*block_keys())).alias("k"), F.col("fp").alias("id"), F.col("fp").alias("word"))
    n = shuffle_partitions(distinct.sparkSession)
    return _linked(rows.repartition(n, "k").sortWithinPartitions("k"), MAX_DISTANCE, "long")


def grouped(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp, ...) with their group: root, one fingerprint for all of it, and its smallest known doc_id."""
    classes = rows.groupBy("fp").agg(F.min(known("doc_id")).alias("least"))
    linked = components(links(classes.select("fp")))
    groups = classes.join(linked.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = groups.groupBy("root").agg(F.min("least").alias("smallest"))
    return rows.join(groups.join(least, "root").select("fp", "root", "smallest"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept): one row per row of docs.

    Null text counts as empty; texts without words have fingerprint zero and link with each other.
    component_id is the smallest doc_id reachable over links of at most three differing bits. A null
    doc_id counts as smaller than all others, so a group that holds one has a null component_id.
    Repeated rows give repeated rows. kept: whether the row has its group's smallest doc_id.
    Documents with one fingerprint are one class: only distinct fingerprints go to the blocks.
    """
    unknown = F.col("smallest") == F.lit(-(2**63))
    return grouped(written(fingerprints(docs, shingle))).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(~unknown, F.col("smallest")).alias("component_id"),
        (known("doc_id") == F.col("smallest")).alias("kept"),
    )


#: The long fingerprints: blocks and the bits of one (over pairs of words, of which an edit changes the fewest), and the
#: 64-bit words that the distance is measured on. A text pair of similarity 0.8 differs in 9 to 10 % of the block bits,
#: so that it shares one of 64 blocks of 24 bits with a chance of 0.99; unrelated texts share one by 4 in a million.
BLOCKS, BLOCK_BYTES, PAIR, MEASURED = 64, 3, 2, 32
#: Odd factors that make as many hashes out of one.
_FACTORS = np.random.default_rng(SEED).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Distinct hashes of each run of that many words, given the words' hashes; fewer words are one run."""
    k = min(shingle, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def majority(hashes: np.ndarray, n: int) -> bytes:
    """n * 64 bits: of as many derived hash bits, which are set in over half of the hashes."""
    ones = np.zeros(64 * n, np.int64)
    for at in range(0, len(hashes), 255):  # so many that a byte can count them
        x = hashes[at : at + 255, None] * _FACTORS[:n]
        x ^= x >> np.uint64(29)
        x *= _MIX
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def long_fingerprint(text: str | None, shingle: int) -> tuple[bytes, bytes]:
    """(blocks, measured); all zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(BLOCKS * BLOCK_BYTES), bytes(8 * MEASURED)
    own = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), np.uint64, len(words))
    return majority(shingle_set(own, PAIR), BLOCKS * BLOCK_BYTES // 8), majority(shingle_set(own, shingle), MEASURED)


def farthest(similarity: float) -> int:
    """Differing bits of the measured words that are taken for that similarity of sets or more: the mean and one
    standard deviation, so that five of six pairs at the very limit are found and nearly all above it."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(64 * MEASURED * p + (64 * MEASURED * p * (1 - p)) ** 0.5)


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(kept_id, text_key, root): for each row of docs its id (null: below all others), its text's hash and its group.

    Texts are linked whose sets of word shingles have that similarity, as their long fingerprints tell: the share of
    differing bits gives the similarity within 0.02 (standard deviation). Texts with one fingerprint are a class, and
    only classes go to the blocks; a block key that one class has alone ends there.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [long_fingerprint(t.as_py(), shingle) for t in b.column(2)]
            cls = [xxhash.xxh3_128_digest(x + y) for x, y in both]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.binary()) for x in (cls, *zip(*both, strict=True)))], names)

    names = ["kept_id", "text_key", "cls", "blocks", "word"]
    own = docs.select(known("doc_id").alias("kept_id"), text_key().alias("text_key"), F.col("text").cast("string"))
    rows = written(own.mapInArrow(each, "kept_id long, text_key string, cls binary, blocks binary, word binary"))
    classes = rows.select("cls", "blocks", "word").dropDuplicates(["cls"])
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("blocks", k * BLOCK_BYTES + 1, BLOCK_BYTES)) for k in range(BLOCKS)])
    several = classes.select("cls", F.explode(keys).alias("k")).withColumn("n", F.count("*").over(Window.partitionBy("k"))).where("n > 1").select("k", "cls")
    n = shuffle_partitions(docs.sparkSession)
    dealt = several.join(classes.select("cls", "word"), "cls").select("k", F.col("cls").alias("id"), "word")
    links = _linked(dealt.repartition(n, "k").sortWithinPartitions("k"), farthest(similarity), "binary")
    linked = components(links).withColumnRenamed("id", "cls")
    return rows.select("kept_id", "text_key", "cls").join(linked, "cls", "left").select("kept_id", "text_key", F.coalesce("component", "cls").alias("root"))


def first_of_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs, with its own columns, for each group of similar_groups(): of the rows with the group's
    smallest doc_id (null is smallest) the one with the smallest hash of its text. A row is known by both, so rows
    of other groups with the same doc_id, or none, stay for their own. Null text is empty; texts without words are a group."""
    own = similar_groups(docs, shingle, similarity).groupBy("root", "kept_id", "text_key").agg(F.count("*").alias("copies"))
    first = own.groupBy("root").agg(F.min(F.struct("kept_id", "text_key", "copies")).alias("first")).select("first.*")
    rows = docs.select(F.struct(*docs.columns).alias("row"), known("doc_id").alias("kept_id"), text_key().alias("text_key")).join(first, ["kept_id", "text_key"])
    several = Window.partitionBy("kept_id", "text_key").orderBy(F.to_json("row"))
    one = rows.where("copies > 1").withColumn("rank", F.row_number().over(several)).where("rank = 1")
    return rows.where("copies = 1").select("row.*").union(one.select("row.*"))
