"""Every source as nullable text, in source order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import normalize_headers
from .csvcheck import open_csv
from .source import ORDER, Source, by_file, quoted


@F.pandas_udf(T.StringType())
def _python_float(s):
    return s.map(lambda x: str(float(x)))


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as the text that comparisons see."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.FloatType | T.DoubleType):
        d = c.cast("double")
        usual = (F.abs(d) >= 1e-3) & (F.abs(d) < 1e7) | ((d == 0) & (d.cast("string") == "0.0"))
        return F.when(d.isNull(), None).when(usual, d.cast("string")).when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").otherwise(_python_float(F.coalesce(F.when(~usual, d), F.lit(0.0))))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("base64:"), F.base64(c))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.concat(F.lit("["), nested(e["key"], kind.keyType), F.lit(","), nested(e["value"], kind.valueType), F.lit("]")))
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]")))
    if isinstance(kind, T.ArrayType | T.StructType):
        return F.when(c.isNotNull(), nested(c, kind))
    return c.cast("string")


def nested(c: Column, kind: T.DataType) -> Column:
    """Compact JSON of a value inside another: object keys sorted, arrays in order, other scalars as JSON texts."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}":'), nested(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), *[x for k, p in enumerate(parts) for x in ([F.lit(",")] if k else []) + [p]], F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda e: nested(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        text = as_text(c, kind)
    elif isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.BooleanType | T.FloatType | T.DoubleType):
        text = as_text(c, kind)
    else:
        text = F.substring(F.to_json(F.array(as_text(c, kind))), 2, 2**31 - 1)
        text = F.expr("null") if text is None else F.regexp_replace(text, r"\]$", "")
    return F.when(c.isNull(), "null").otherwise(text)


def text_table(df: DataFrame) -> DataFrame:
    """All columns as text, ORDER kept as it is."""
    name = lambda f: f"`{f.name.replace('`', '``')}`"
    plain = lambda f: f.name == ORDER or isinstance(f.dataType, T.StringType)
    return df.select(*[name(f) if plain(f) else as_text(F.col(name(f)), f.dataType).alias(f.name) for f in df.schema.fields])


def open_parquet(spark: SparkSession, path: str) -> Source:
    """A Parquet source in its order: files by path, then rows by position."""
    df = spark.read.parquet(path)
    several = len(df.inputFiles()) > 1
    files = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect()) if several else []  # reads no column
    return Source.of(by_file(df, files, "row_index", ORDER, order=True)).named(normalize_headers(df.columns))


def open_source(spark: SparkSession, path: str, **options: str) -> Source:
    """A source by its suffix."""
    if path.rstrip("/").endswith(".parquet"):
        return replace(open_parquet(spark, path), path=path)
    if path.rstrip("/").endswith(".csv"):
        return replace(open_csv(spark, path, **options), path=path)
    if path.endswith((".xlsx", ".xlsm")):
        from .excel import read_excel

        return replace(Source.of(read_excel(spark, path, **options)), path=path)
    raise ValueError(f"no reader for {path}")


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A source as a table of text columns with its order."""
    return open_source(spark, path, **options).df


def preview(df: DataFrame, rows: int = 20, first_column: int = 0, columns: int = 20, chars: int = 500, most_bytes: int = 2 << 20) -> DataFrame:
    """The first rows (1,000 at most) of one page of columns in source order, long texts cut, nulls shown; it ends before the row
    with which the texts would exceed most_bytes."""
    from ..functions.texts import shown

    names = [c for c in df.columns if c != ORDER][first_column : first_column + columns]
    order = ORDER if ORDER in df.columns else "__place"
    given = df if order == ORDER else df.withColumn(order, F.monotonically_increasing_id())
    few = given.orderBy(order).limit(min(rows, 1000)).select(order, *[F.substring(shown(F.col(quoted(c))), 1, chars).alias(c) for c in names])
    size = sum((F.octet_length(quoted(c)) for c in names), F.lit(0))
    return few.withColumn("__size", F.sum(size).over(Window.orderBy(order))).where(F.col("__size") <= most_bytes).select(*[F.col(quoted(c)) for c in names])  # of 1,000 rows


def result_preview(df: DataFrame, order: list[str], rows: int = 100, chars: int = 1000, most: int = 250_000) -> DataFrame:
    """The first rows of a result, texts cut; it ends with the row that brings its characters over `most`."""
    few = df.orderBy(*order).limit(rows).select(*[F.substring(c, 1, chars).alias(c) for c in df.columns])
    size = sum((F.coalesce(F.char_length(c), F.lit(0)) for c in df.columns), F.lit(0))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # of the first rows only
    return few.withColumn("__size", F.coalesce(F.sum(size).over(before), F.lit(0))).where(F.col("__size") <= most).drop("__size")


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, row_groups, columns, types) of a Parquet source's files: their footers, read in tasks."""
    files = sorted(spark.read.parquet(path).inputFiles())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for b in batches:
            out = []
            for f in b.column(0).to_pylist():
                store, own = fs.FileSystem.from_uri(f)
                with store.open_input_file(own) as h:
                    p = pq.ParquetFile(h)
                    out.append({"file": f, "rows": p.metadata.num_rows, "row_groups": p.num_row_groups, "columns": p.schema_arrow.names, "types": [str(x.type) for x in p.schema_arrow]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("rows", pa.int64()), ("row_groups", pa.int64()), ("columns", pa.list_(pa.string())), ("types", pa.list_(pa.string()))]))

    paths = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 1000))
    return paths.mapInArrow(each, "file string, rows long, row_groups long, columns array<string>, types array<string>")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of a source's files. Their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
