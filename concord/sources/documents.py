"""JSON documents as files: read whole, paired by name, and written one by one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jsondiff import MAX_BYTES

_BOM = "﻿"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of a file, or of every .json file below a folder; name is the path below it, empty for a file itself.

    A file over MAX_BYTES is an error, before its content is read; so are an empty file, which Spark's scan would pass over, and a text that
    is no UTF-8. A byte order mark at the beginning is dropped. A folder without such files has no documents; a path that does
    not exist is an error. Names that begin with a point or a low line are not read, as by any scan of Spark's.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    if len(files.inputFiles()) != files.select("path").count():  # both know names and lengths only
        raise ValueError(f"an empty file is no JSON document: below {path}")
    files = files.withColumn("name", F.substring("path", len(root) + 2, 1 << 30))
    large = files.where(F.col("length") > MAX_BYTES)
    refused = large.select("name", F.raise_error(F.concat(F.lit(f"a JSON document of more than {MAX_BYTES} bytes: "), "path")).cast("string").alias("text"))
    text = F.validate_utf8(F.col("content").cast("string"))
    read = files.where(F.col("length") <= MAX_BYTES).select("name", F.when(F.startswith(text, F.lit(_BOM)), F.substring(text, 2, MAX_BYTES)).otherwise(text).alias("text"))
    return read.union(refused)


def document_pairs(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(name, a, b): the documents of two folders by their names, null where a side lacks one; or of two files, whose name is empty."""
    sides = [read_documents(spark, p).withColumnRenamed("text", c) for p, c in ((left, "a"), (right, "b"))]
    return sides[0].join(sides[1], "name", "full")


def write_documents(docs: DataFrame, folder: str) -> int:
    """Writes each row (name, text) as a file of that name below the folder, by the tasks that hold them, and returns how many.
    Names must differ. A file is written under a name of its own attempt and then moved, so that a lost task leaves none half written."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}"
                files.create_dir(path.rpartition("/")[0], recursive=True)
                with files.open_output_stream(f"{path}.{attempt}") as out:
                    out.write(text.encode())
                if files.get_file_info(path).type != fs.FileType.NotFound:  # some stores do not move onto a name
                    files.delete_file(path)
                files.move(f"{path}.{attempt}", path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return docs.select("name", "text").mapInArrow(each, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
