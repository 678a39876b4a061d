"""A source as it is compared: its names, and rows whose columns are not touched before they are needed."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER, PACKED, FILE = "__source_order", "__packed", "__file"
#: A row's order is one number: the file's place among the source's files, then the row's place in its file.
PLACE_BITS, MOST_FILES = 44, 1 << 19
#: So many files are told apart by an expression; more are joined.
FEW_FILES = 16
#: Between the fields of a packed row, and before one whose fields are a JSON array since they hold either sign.
SEPARATOR, ODD = "\x1f", "\x00"
#: Columns hashed as one.
CHUNK = 64
_PLAIN = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.DecimalType)


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def literal(text: str) -> str:
    """A text as a literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(spark: SparkSession, rows: Sequence[Sequence], **columns: str) -> DataFrame:
    """A short list of settings as a table, columns by name and type. A literal of the plan, so that no Python worker starts for it."""
    if len(rows) > 10_000:
        return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` {k}" for n, k in columns.items()))
    kind = "array<struct<" + ", ".join(f"`{n}`: {k}" for n, k in columns.items()) + ">>"
    text = json.dumps([dict(zip(columns, r, strict=True)) for r in rows], ensure_ascii=False)
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), kind)).alias("r")).select("r.*")


def by_file(df: DataFrame, files: Sequence[str], field: str, name: str, order: bool = False) -> DataFrame:
    """A scan with FILE, the place of a row's file among `files`, and a field of its metadata under a name; or with both as one
    number of that name. One projection, as the scan may have thousands of columns."""
    if len(files) > MOST_FILES:
        raise ValueError(f"a source of more than {MOST_FILES} files")
    path, own, place = F.col("_metadata.file_path"), F.col(f"_metadata.{field}"), F.lit(0).cast("long")
    if len(files) > FEW_FILES:
        places = df.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), f"__path string, {FILE} long")
        met = df.select("*", path.alias("__path"), own.alias("__own")).join(F.broadcast(places), "__path")  # at most MOST_FILES short rows
        number = F.shiftleft(FILE, PLACE_BITS).bitwiseOR(F.col("__own"))
        return met.withColumn(name, number if order else F.col("__own")).drop("__path", "__own", *([FILE] if order else []))
    if len(files) > 1:
        known = reduce(lambda c, k: c.when(path == files[k], k), range(1, len(files)), F.when(path == files[0], 0))
        unknown = F.raise_error(F.concat(F.lit("a file that was not there before: "), path)).cast("long")
        place = F.coalesce(known.cast("long"), unknown)
    return df.select("*", F.shiftleft(place, PLACE_BITS).bitwiseOR(own).alias(name)) if order else df.select("*", place.alias(FILE), own.alias(name))


@dataclass(frozen=True)
class Source:
    """rows: ORDER and either one column for each name, or PACKED, all fields in one text. Columns are referred to by
    their place, and rendered as text where they are read, so that no plan holds all of them unless it needs them."""

    rows: DataFrame
    names: tuple[str, ...]
    fields: tuple[str, ...] = ()  # the columns' own names; none: packed
    path: str = ""  # of the files, where it comes from files

    @classmethod
    def of(cls, df: DataFrame) -> Source:
        """Any table. Columns that are no text are rendered by as_text() beforehand where a cast would not do."""
        from .texts import as_text

        fields = [f for f in df.schema.fields if f.name != ORDER]
        other = {f.name: as_text(F.col(quoted(f.name)), f.dataType) for f in fields if not isinstance(f.dataType, _PLAIN)}
        return cls(df.withColumns(other) if other else df, tuple(f.name for f in fields), tuple(f.name for f in fields))

    def named(self, names: Sequence[str]) -> Source:
        return replace(self, names=tuple(names))

    def at(self, names: Sequence[str]) -> list[int]:
        places = {n: k for k, n in enumerate(self.names)}
        return [places[n] for n in names]

    @property
    def _whole(self) -> str:
        p = PACKED
        return f"if(startswith({p}, '\\u0000'), from_json(substring({p}, 2), 'array<string>'), split({p}, '\\u001F', -1))"

    def cell(self, k: int) -> str:
        """SQL of the text in a column."""
        if self.fields:
            name = quoted(self.fields[k])
            return name if isinstance(self.rows.schema[self.fields[k]].dataType, T.StringType) else f"cast({name} as string)"
        plain = f"substring_index(substring_index({PACKED}, '\\u001F', {k + 1}), '\\u001F', -1)"
        return f"if(startswith({PACKED}, '\\u0000'), {self._whole}[{k}], {plain})"

    def cells(self, places: Sequence[int]) -> str:
        """SQL of the texts in some columns, as an array."""
        if self.fields:
            own = {f.name: isinstance(f.dataType, T.StringType) for f in self.rows.schema.fields}
            names = [self.fields[k] for k in places]
            return "array(" + ", ".join(quoted(n) if own[n] else f"cast({quoted(n)} as string)" for n in names) + ")" if names else "cast(array() as array<string>)"
        if list(places) == list(range(len(self.names))):
            return self._whole
        if len(places) <= 2:
            return "array(" + ", ".join(self.cell(k) for k in places) + ")" if places else "cast(array() as array<string>)"
        return f"transform(from_json('{list(places)}', 'array<int>'), i -> {self._whole}[i])"

    def hashes(self, places: Sequence[int], whole: bool) -> list[str]:
        """SQL of 128 bits of hash for each CHUNK columns, two numbers each: of the texts joined, with a sign that no text has for
        nulls, and of the texts one by one, which nulls do not change. Arrays keep the generated code small. whole: all columns of a packed source are
        wanted in its own order, keys included: its text is hashed unparted."""
        if whole and not self.fields:
            return [f"xxhash64({PACKED})", f"xxhash64(1, {PACKED})"]
        parts = [places[k : k + CHUNK] for k in range(0, len(places), CHUNK)] if self.fields else [places]
        out = []
        for v in map(self.cells, parts):
            out += [f"xxhash64(array_join({v}, '\\u001F', cast(X'FF' as string)))", f"xxhash64(1, {v})"]
        return out or ["0L", "0L"]

    @property
    def df(self) -> DataFrame:
        """One column of text for each name, and ORDER."""
        if self.fields:
            out = [f"{self.cell(k)} as {quoted(n)}" for k, n in enumerate(self.names)]
            return self.rows.selectExpr(*out, *([ORDER] if ORDER in self.rows.columns else []))
        v = self.rows.selectExpr(f"{self._whole} as v", ORDER)
        return v.selectExpr(*[f"v[{k}] as {quoted(n)}" for k, n in enumerate(self.names)], ORDER)
