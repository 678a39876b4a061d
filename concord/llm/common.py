"""Shared folders, written stage results and linked groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id while rows are grouped and joined; sorts before every other id.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see. Where that is unset, a temporary folder for a
    local master (tests, benchmarks); a cluster's executors would each write to a disk of their own, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/concord-{uuid.uuid4().hex}"


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and outlives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the folder that written() made for df, which no later plan may read."""
    for file in df.inputFiles()[:1]:
        files, path = store(file)
        folder = path.rpartition("/")[0]
        if folder.rpartition("/")[2].startswith("concord-"):
            files.delete_dir(folder)


def known(column: str) -> Column:
    """An id, or NO_ID in place of null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_key() -> Column:
    """128-bit hash of the text, empty for null: with the doc_id it tells rows apart whose doc_id is null or shared."""
    return F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest id reachable from each linked id: (id, component).

    links: (a, b) pairs of different ids, each meaning that both belong together. Alternates
    large-star and small-star steps: every id is linked to the smallest of its neighbours, then every
    larger neighbour is moved on to that one, until no pair changes. A step is one aggregation, combined before the
    shuffle, and one join on the id; a hub's pairs meet in one task there and are read as a stream.
    Each round's pairs are written to the shared folder, and the round before is deleted.
    """
    pairs = written(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())

    def large_star(p: DataFrame) -> DataFrame:
        both = p.select("v", "u").union(p.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        return both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()

    def small_star(p: DataFrame) -> DataFrame:
        least = p.groupBy("v").agg(F.min("u").alias("m"))
        moved = p.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        return moved.union(least.select("v", F.col("m").alias("u"))).distinct()

    before = None
    for _ in range(max_rounds):
        older, pairs = pairs, written(small_star(large_star(pairs)))
        dropped(older)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if now == before:
            return pairs.select(F.col("v").alias("id"), F.col("u").alias("component"))
        before = now
    raise RuntimeError(f"components: no end after {max_rounds} rounds")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables in which no value of the first column goes on in the next; batches are sorted by it. A value's rows are held
    as the batches that brought them and put together once."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = int(key.searchsorted(key[-1]))
        if cut or key[0] != last:
            if held or cut:
                yield pa.Table.from_batches([*held, *([b.slice(0, cut)] if cut else [])]).combine_chunks()
            held = []
        held.append(b.slice(cut))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def store(uri: str):
    """(file system, path) of a shared folder, for whole files that tasks write and read."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(files, path: str, content: bytes, attempt: str) -> None:
    """Writes under a name of its own and moves it: a second attempt of a task leaves one whole file."""
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(f"{path}.{attempt}") as out:
        out.write(content)
    files.move(f"{path}.{attempt}", path)
