"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, dropped, known, shared_dir, shuffle_partitions, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def small_letters(c: Column) -> Column:
    """A-Z to a-z, nothing else. lower() does just that on pure ASCII, and faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, th, pos, h1, h2): 128 bits for each line whose key has min_chars code points or more."""
    lines = docs.select(known("doc_id").alias("doc"), F.xxhash64("text").alias("th"), F.posexplode(split_lines("text")).alias("pos", "line"))
    stripped = lines.select("doc", "th", "pos", F.btrim("line", F.lit(BLANKS)).alias("s")).where(F.char_length("s") >= min_chars)
    key = small_letters(F.col("s"))
    return stripped.select("doc", "th", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, holder), in levels of at most `fanout` runs.

    A run is a table bucketed and sorted by both hashes, the key of every join with it: a batch that is dealt by them meets
    a run where it lies, without an exchange of the run. (Spark sorts a bucket again before a merge join, which for rows in
    order is one pass over them.) When a level is full its runs are merged into one run of the next and dropped: a hash
    is in O(log batches) runs at most.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]

    def _store(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        sorted_rows = rows.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
        sorted_rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", shared_dir(self.spark)).saveAsTable(name)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._store(self._merged([self.spark.table(run) for run in full]), level + 1)
            self._drop(full)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            dropped(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        """Drops all runs; no later plan may read them."""
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        # Full outer merge joins: a union of bucketed tables would count as dealt by hash although it is not.
        every = runs[0]
        for run in runs[1:]:
            other = run.withColumnsRenamed({"n_docs": "n_more", "holder": "other"})
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))
            every = every.join(other, KEY, "full").select(*KEY, total.alias("n_docs"), F.greatest("holder", "other").alias("holder"))
        return every

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(run) for level in self.levels for run in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys that no run has: one merge anti-join for each run."""
        for run in self.runs():
            keys = keys.join(run.select(*KEY), KEY, "left_anti")
        return keys

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of (doc, h1, h2) as a run. Its fresh keys name their largest doc as holder; keys that
        older runs have bring their number of documents only. Batches come in descending ids, a doc in one batch."""
        keys = lines.groupBy(*KEY).agg(F.countDistinct("doc").alias("n_docs"), F.max("doc").alias("own"))
        fresh = self.fresh(keys).select(*KEY, F.lit(True).alias("is_new"))
        self._store(keys.join(fresh, KEY, "left").select(*KEY, "n_docs", F.when(F.col("is_new"), F.col("own")).alias("holder")), 0)

    def merged(self) -> DataFrame:
        return self._merged(self.runs())


def _batches(lines: DataFrame, n: int) -> list[DataFrame]:
    """lines by ranges of doc, the largest ids first."""
    low, high = lines.where(F.col("doc") > NO_ID).agg(F.min("doc"), F.max("doc")).first()
    if low is None:
        return [lines]
    cuts = [high - (high - low + 1) * k // n for k in range(1, n)]
    tops, bottoms = [None, *cuts], [*cuts, None]
    doc = F.col("doc")
    return [lines.where((doc <= t if t is not None else F.lit(True)) & (doc > b if b is not None else F.lit(True))) for t, b in zip(tops, bottoms, strict=True)]


def dedup(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 3) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text beside their own columns.

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of min_chars code points or
    more that is in min_docs documents or more stays in the largest doc_id only (there in all its lines).
    Null or empty text: one empty line, kept. A null doc_id is one document below all others. Rows that share
    a doc_id are one document: all their lines count for it, and each row keeps its own text.
    Columns of docs named as the three results are replaced.
    """
    lines = written(line_hashes(docs, min_chars))
    index = LineRuns(docs.sparkSession)
    for batch in _batches(lines, batches):
        index.add(batch)
    frequent = written(index.merged().where(F.col("n_docs") >= min_docs).select(*KEY, "holder"))
    index.close()
    drops = lines.join(frequent, KEY).where("doc < holder").groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = docs.select(F.struct(*own).alias("row"), known("doc_id").alias("doc"), F.xxhash64("text").alias("th"))
    met = rows.join(drops, ["doc", "th"], "left").withColumn("lines", split_lines("row.text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return met.select(
        "row.*",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.array_join("lines", "\n"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
        .alias("kept_text"),
    )
