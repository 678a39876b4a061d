"""Strict reading of CSV by any number of tasks, in the order of the source.

Only quotes carry over a line's end, so a stretch of lines (a split of a file) is a function of two states: whether it begins inside a
quoted field or not. Where a source has quotes, tasks work that function out for their stretch, whatever came before, and the driver chains one
small row of each stretch. Reading then starts every stretch in its state: a record that goes on in the next stretch is
put together from its pieces, all others are parsed where they lie. Files are read in splits; lines without quotes are
judged by Arrow's kernels, lines with quotes in their places by the bytes of all of them, a batch at a time. Only what
is left over, and what is wrong, is looked at line by line.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import normalize_headers
from .source import MOST_FILES, ODD, ORDER, PACKED, PLACE_BITS, SEPARATOR, Source

OUTSIDE, QUOTED = 0, 1
MIXED = "another line end than the first line's"
#: Characters of a field at most.
MAX_FIELD = 64 << 20
#: Lines at the start of a source that are looked at for quotes before all of them are.
FIRST_LINES = 1000
#: Characters of a piece of a record, and of a header, that come with a stretch's row; longer ones are read again. Headers come so from so many files at most.
MOST_PIECE, MOST_HEADER, HEADER_FILES = 4096, 1 << 16, 1000
_QUOTE = ord('"')


class CsvError(ValueError):
    """A record that strict CSV does not allow."""


def after_line(line: str, state: int, delimiter: str) -> tuple[int, str]:
    """(the state at the line's end, what is wrong with it): one line, begun inside a quoted field or at a record's start."""
    if state == OUTSIDE and not line:
        return OUTSIDE, "a blank line"
    if '"' not in line:
        return state, MIXED if state == OUTSIDE and ("\r" in line or "\n" in line) else ""
    at, fresh = 0, state == OUTSIDE  # fresh: at a field's start
    while at < len(line):
        if state == QUOTED:
            end = line.find('"', at)
            if end < 0:
                return QUOTED, ""
            if line[end + 1 : end + 2] == '"':
                at = end + 2
                continue
            if end + 1 < len(line) and not line.startswith(delimiter, end + 1):
                return OUTSIDE, "text after a closing quote"
            state, at, fresh = OUTSIDE, end + 1 + len(delimiter), True
        elif fresh and line[at] == '"':
            state, at = QUOTED, at + 1
        else:
            end = line.find(delimiter, at)
            own = line[at : end if end >= 0 else len(line)]
            if "\r" in own or "\n" in own:
                return OUTSIDE, MIXED
            at, fresh = (len(line), False) if end < 0 else (end + len(delimiter), True)
    return state, ""


@dataclass(frozen=True)
class Block:
    """Lines that begin in a state, as the bytes of all of them with the line ends between, where every quote is in a place that
    strict CSV allows and in a quoted field: then a byte lies inside of quotes if the quotes up to it are odd in number."""

    data: np.ndarray
    inside: np.ndarray  # the state after each byte
    quotes: np.ndarray  # where they are
    starts: np.ndarray  # of the lines, and where a line after the last would begin
    before: np.ndarray  # the state before each line
    after: np.ndarray  # and after it

    @classmethod
    def of(cls, values: pa.Array, state: int, delimiter: str, end: str) -> Block | None:
        """None: there is something that these lines' bytes do not tell, or that strict CSV does not allow."""
        size, last, sign = pc.binary_length(values).to_numpy(), ord(end[-1]), ord(delimiter)
        starts = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + np.int64(len(end)), out=starts[1:])
        if sign > 127 or not len(end) < starts[-1] <= MAX_FIELD:
            return None
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), end)
        data = np.frombuffer(whole.buffers()[2], np.uint8)[: starts[-1] - len(end)]
        quote = data == _QUOTE
        inside = np.bitwise_xor.accumulate(quote.view(np.uint8))
        if state:
            inside ^= 1
        before = np.empty(len(size), np.uint8)
        before[0], before[1:] = state, inside[starts[1:-1] - 1]
        after = np.append(before[1:], inside[-1] if len(inside) else state)
        if np.any((size == 0) & (before == OUTSIDE)):
            return None
        signs = [np.count_nonzero(data == ord(x)) for x in "\r\n"]
        if signs != [(len(size) - 1) * (x in end) for x in "\r\n"]:  # other line ends than these: they lie in quotes
            odd = (data == ord("\r")) | (data == ord("\n"))
            for k in range(len(end)):
                odd[starts[1:-1] - 1 - k] = False
            if np.any(odd & (inside == OUTSIDE)):
                return None
        quotes = np.flatnonzero(quote)
        opens, closes = quotes[state::2], quotes[1 - state :: 2]
        prior = data[opens[int(np.searchsorted(opens, 1)) :] - 1]
        following = data[closes[: int(np.searchsorted(closes, len(data) - 1))] + 1]
        # A quote before one that opens, and after one that closes, is its other half: both stand for one.
        if not np.all((prior == sign) | (prior == last) | (prior == _QUOTE)) or not np.all((following == sign) | (following == ord(end[0])) | (following == _QUOTE)):
            return None
        if len(data) and data.max() > 127:
            try:
                whole.validate(full=True)
            except pa.ArrowInvalid:
                return None
        return cls(data, inside, quotes, starts, before, after)

    def records(self, delimiter: str, end: str, width: int) -> tuple[np.ndarray, pa.Array, np.ndarray, int] | None:
        """Of a block begun outside: (the first line of each record, their packed fields, whether they need another form as
        they hold its signs, the first line of the record that is open at the end, or the number of lines). None: a record has another width."""
        data, inside, starts, sign = self.data, self.inside, self.starts, ord(delimiter)
        first = np.flatnonzero(self.before == OUTSIDE)
        n = len(self.before)
        left = int(first[-1]) if self.after[-1] == QUOTED else n
        first = first[first < left]
        if not len(first):
            return first, pa.array([], pa.string()), np.zeros(0, bool), left
        stop = int(starts[left]) - len(end)
        data, inside = data[:stop], inside[:stop]
        at = starts[first]
        between = np.flatnonzero((data == sign) & (inside == OUTSIDE))
        if np.any(np.diff(np.searchsorted(between, np.append(at, stop))) != width - 1):
            return None
        quotes = self.quotes[: np.searchsorted(self.quotes, stop)]
        opens = quotes[2::2]
        kept = np.ones(stop, bool)
        kept[quotes] = False
        kept[opens[opens - quotes[1 : 2 * len(opens) : 2] == 1]] = True  # the second of two
        for k in range(len(end)):
            kept[at[1:] - 1 - k] = False
        signs = (data == ord(ODD)) | (data == ord(SEPARATOR)) & ((inside == QUOTED) | (sign != ord(SEPARATOR)))
        other = np.zeros(len(first), bool)
        other[np.searchsorted(at, np.flatnonzero(signs), "right") - 1] = True
        if sign != ord(SEPARATOR):
            data = data.copy()
            data[between] = ord(SEPARATOR)
        away = np.flatnonzero(~kept)
        offsets = np.append(at - np.searchsorted(away, at), stop - len(away)).astype(np.int32)
        return first, pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[kept])), other, left


def walk(values: pa.Array, state: int, delimiter: str, end: str) -> tuple[np.ndarray, str]:
    """(the state after each line, what is wrong): lines, some of them perhaps with quotes, begun in a state."""
    if pc.any(pc.match_substring(values, '"')).as_py() and (block := Block.of(values, state, delimiter, end)):
        return block.after, ""
    ask = suspect(values)
    after, done = np.empty(len(values), np.uint8), 0
    for k in np.flatnonzero(ask).tolist():
        after[done:k] = state
        state, wrong = after_line(values[k].as_py(), state, delimiter)
        if wrong:
            return after, wrong
        after[k], done = state, k + 1
    after[done:] = state
    return after, ""


def two_bytes(encoding: str) -> bool:
    return encoding.lower().replace("_", "-").startswith("utf-16")


def utf8(encoding: str) -> bool:
    return encoding.lower().replace("_", "-") in ("utf-8", "utf8", "utf-8-sig", "us-ascii", "ascii")


def decoder(encoding: str):
    """From a batch's values to texts, in tasks."""
    if utf8(encoding) or two_bytes(encoding):
        return lambda column: column
    return lambda column: pa.array([x.decode(encoding) for x in column.to_pylist()], pa.string())


@dataclass(frozen=True)
class Files:
    """A CSV source's files in order, and how they are read."""

    spark: SparkSession
    path: str
    delimiter: str
    encoding: str

    def __post_init__(self):
        if len(self.delimiter) != 1 or self.delimiter in '\r\n\0"':
            raise ValueError("the delimiter is one character, no line end and no quote")
        "".encode(self.encoding)

    def _texts(self) -> DataFrame:
        """(path, text) of files in a two-byte encoding, which no split can be read of."""
        text = F.ltrim(F.decode("content", self.encoding), F.lit("﻿"))
        return self.spark.read.format("binaryFile").load(self.path).select(F.xxhash64("_metadata.file_path").alias("path"), text.alias("text"))

    def paths(self) -> dict[int, str]:
        """All files by the hash of their path, which lines go with."""
        files = self.spark.read.format("binaryFile").load(self.path).select("_metadata.file_path")  # no contents are read
        rows = files.select(F.xxhash64("file_path").alias("at"), "file_path").collect()
        if len(found := {r.at: r.file_path for r in rows}) < len(rows):
            raise CsvError(f"{self.path}: two paths of the same hash")
        if len(found) > MOST_FILES:
            raise ValueError(f"a source of more than {MOST_FILES} files")
        return found

    def line_end(self) -> str:
        """What ends the first line: CRLF, LF or CR."""
        if two_bytes(self.encoding):
            first = self._texts().select(F.substring_index("text", "\n", 1).alias("value")).first()
        else:
            first = self.spark.read.text(self.path, lineSep="\n").select(F.regexp_replace("value", "[^\r]", "x").alias("value")).first()
        own = first.value if first else ""
        return "\r" if "\r" in own[:-1] else "\r\n" if own.endswith("\r") else "\n"

    def lines(self, end: str) -> DataFrame:
        """(path, start, value): lines with the stretch they are in, its path as a hash, in order within it. Two-byte encodings are read by one task for each file."""
        if two_bytes(self.encoding):
            lines = F.split(F.regexp_replace("text", f"{end}$", ""), end)
            return self._texts().select("path", F.lit(0).cast("long").alias("start"), F.explode(lines).alias("value"))
        raw = self.spark.read.text(self.path, lineSep=end)
        return raw.select(F.xxhash64("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")

    @property
    def value(self) -> str:
        return "value" if utf8(self.encoding) or two_bytes(self.encoding) else "cast(value as binary) as value"


@dataclass(frozen=True)
class Stretch:
    """Where reading begins. origin: the stretch in which the record began that is open when this one begins."""

    path: str
    start: int
    state: int = OUTSIDE
    origin: tuple[str, int] | None = None
    left_open: tuple[str, int] | None = None  # where the record began that is open at the end
    header: str | None = None  # a file's first record; None: it was not kept
    head: str | None = None  # what belongs to the record from before; None: too long, as the tail
    tail: str | None = None  # what belongs to the record that begins here and is left open
    at: int = 0  # where that begins


class Guess:
    """A stretch as it is if it begins in a state: the state reached, what is wrong, the lines up to the end of the first record, and those of the record
    that is open. Lines that are too long together are not kept."""

    def __init__(self, state: int):
        self.begun, self.state, self.wrong, self.closed, self.at = state, state, "", False, 0
        self.head, self.tail = [], []

    def add(self, values: pa.Array, offsets: np.ndarray, delimiter: str, end: str) -> None:
        state = self.state
        after, self.wrong = walk(values, state, delimiter, end)
        if self.wrong:
            return
        self.state = int(after[-1])
        if not self.closed:
            ends = np.flatnonzero(after == OUTSIDE)
            self.closed = len(ends) > 0
            self.head = more(self.head, values[: int(ends[0]) + 1] if self.closed else values, MOST_HEADER if self.begun == OUTSIDE else MOST_PIECE)
        if self.state == OUTSIDE:
            self.tail = []
            return
        begins = np.flatnonzero(after[:-1] == OUTSIDE)
        begin = int(begins[-1]) + 1 if len(begins) else 0 if state == OUTSIDE else -1
        if begin >= 0:
            self.tail, self.at = [], int(offsets[begin])
        self.tail = more(self.tail, values[max(begin, 0) :], MOST_PIECE)


def more(lines: list[str] | None, values: pa.Array, most: int) -> list[str] | None:
    """A few lines and others, None if they are too long."""
    if lines is None or len(values) + sum(map(len, lines)) > most or pc.sum(pc.binary_length(values)).as_py() + sum(map(len, lines)) > most:
        return None
    return lines + values.to_pylist()


def stretches(files: Files, end: str, paths: dict[int, str]) -> list[Stretch]:
    """The stretches of all files in order, one row of each on the driver. Raises CsvError for quotes that strict CSV does
    not allow. Without any quote in the source no line leaves the JVM."""
    lines = files.lines(end)
    quotes = F.contains("value", F.lit('"'))

    def named(path: int) -> str:
        if path not in paths:
            raise CsvError(f"{files.path}: a file that was not there before")
        return paths[path]

    if not any(r.quotes for r in lines.select(quotes.alias("quotes")).take(FIRST_LINES)):
        seen = lines.groupBy("path", "start").agg(F.max(quotes).alias("quotes")).collect()
        if not any(r.quotes for r in seen):
            return [Stretch(p, start) for p, start in sorted((named(r.path), r.start) for r in seen)]
    sign, codec, with_header = files.delimiter, files.encoding, len(paths) <= HEADER_FILES

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, place, base, guesses, rows = decoder(codec), None, 0, [], []

        def row():
            text = lambda x: None if x is None else end.join(x)
            out, quoted = guesses
            header = text(out.head) if with_header and place[1] == 0 and out.closed else None
            return *place, out.state, quoted.state, out.wrong, quoted.wrong, quoted.closed, header, text(quoted.head), text(out.tail), text(quoted.tail), out.at, quoted.at

        for b in batches:
            for first, last, path, start in runs(b):
                if (path, start) != place:
                    rows += [row()] if place else []
                    place, base, guesses = (path, start), start, [Guess(OUTSIDE), Guess(QUOTED)]
                raw = b.column(2).slice(first, last - first)
                size = pc.binary_length(raw).to_numpy().astype(np.int64) + len(end)
                offsets, values = base + np.cumsum(size) - size, decode(raw)
                base += int(size.sum())
                for g in guesses:
                    if not g.wrong:
                        g.add(values, offsets, sign, end)
        rows += [row()] if place else []
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 13, kinds, strict=True)], names)

    names = ["path", "start", "outside", "quoted", "wrong_outside", "wrong_quoted", "closed", "header", "head", "tail_outside", "tail_quoted", "at_outside", "at_quoted"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), *[pa.string()] * 4, pa.int64(), pa.int64()]
    schema = "path long, start long, outside int, quoted int, wrong_outside string, wrong_quoted string, closed boolean, header string, head string, tail_outside string, tail_quoted string, at_outside long, at_quoted long"
    parts = lines.selectExpr("path", "start", files.value).mapInArrow(each, schema).collect()
    out: list[Stretch] = []
    for path, start, r in [*sorted(((named(r.path), r.start, r) for r in parts), key=lambda x: x[:2]), (None, 0, None)]:
        open_before = out[-1].left_open if out else None
        if out and open_before and (r is None or path != out[-1].path):
            raise CsvError(f"{out[-1].path}: a quote is never closed")
        if r is None:
            break
        state = QUOTED if open_before else OUTSIDE
        if wrong := (r.wrong_outside, r.wrong_quoted)[state]:
            raise CsvError(f"{path}: {wrong}")
        still = (r.outside, r.quoted)[state] == QUOTED
        left_open = (open_before if open_before and not r.closed else (path, start)) if still else None
        tail, at = ((r.tail_outside, r.at_outside), (r.tail_quoted, r.at_quoted))[state]
        out.append(Stretch(path, start, state, open_before, left_open, r.header, r.head if open_before else None, tail if left_open == (path, start) else None, at))
    return out


def runs(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end, path, start) of the stretches in a batch."""
    path, start = b.column(0).to_numpy(), b.column(1).to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(path) != 0) | (np.diff(start) != 0)) + 1).tolist(), len(start)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield a, z, int(path[a]), int(start[a])


def suspect(values: pa.Array) -> np.ndarray:
    """Lines that need a look: with quotes or other line ends, or blank."""
    odd = pc.equal(pc.binary_length(values), 0)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    for sign in '"\r\n':
        if np.any(data == ord(sign)):
            odd = pc.or_(odd, pc.match_substring(values, sign))
    return odd.to_numpy(zero_copy_only=False)


def records(texts: list[str], delimiter: str) -> list[list[str]]:
    """The fields of whole records."""
    csv.field_size_limit(MAX_FIELD)
    rows = list(csv.reader(io.StringIO("\n".join(texts), newline=""), delimiter=delimiter, strict=True))
    if len(rows) != len(texts):
        raise CsvError("a record of no fields")
    return rows


def packed_fields(fields: list[str]) -> str:
    text = SEPARATOR.join(fields)
    return ODD + json.dumps(fields, ensure_ascii=False) if text.count(SEPARATOR) >= len(fields) or text.startswith(ODD) else text


def headers(files: Files, end: str, places: list[Stretch], known: dict[int, str]) -> dict[str, list[str]]:
    """The first file's header, and those of files whose header is another text."""
    sign, codec = files.delimiter, files.encoding
    paths = sorted({s.path for s in places})
    given = {s.path: s.header for s in places if s.start == 0}
    if len(given) == len(paths) and None not in given.values():
        return {p: records([h.removeprefix("\ufeff")], sign)[0] for p, h in given.items() if p == paths[0] or h != given[paths[0]]}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, place, held = decoder(codec), None, None
        for b in batches:
            found: list[tuple[str, str]] = []
            for first, last, path, _ in runs(b):
                if path != place:
                    place, held, state = path, [], OUTSIDE
                for k in range(first, last if held is not None else first):
                    held.append(decode(b.column(2).slice(k, 1))[0].as_py())
                    state = after_line(held[-1], state, sign)[0]
                    if state == OUTSIDE:
                        found.append((path, end.join(held)))
                        held = None
                        break
            yield pa.RecordBatch.from_pydict({"path": pa.array([f[0] for f in found], pa.int64()), "header": pa.array([f[1] for f in found], pa.string())})

    number = {p: k for k, p in known.items()}
    lines = files.lines(end).where("start = 0").selectExpr("path", "start", files.value)
    lines = lines.limit(1000) if len(paths) == 1 else lines  # a header of more lines is none
    heads = lines.mapInArrow(each, "path long, header string")
    first = heads.where(F.col("path") == number[paths[0]]).first()
    if first is None:
        raise CsvError(f"{paths[0]}: no header")
    others = heads.where(F.col("header") != first.header).collect() if len(paths) > 1 else []
    return {known[r.path]: records([r.header.removeprefix("\ufeff")], sign)[0] for r in [first, *others]}


def open_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> Source:
    """A CSV source: files in the order of their paths, records in the order of their bytes. The first record of every file is its header; all must
    have the first file's names, in any order. Strict: quotes out of place, blank lines, other line ends than the first
    line's and records of another width are errors, those of quotes at once, the others when the rows are read. An empty field is '' and
    never null. Any encoding that Python knows; ASCII's bytes must mean ASCII in it, or it is UTF-16."""
    files = Files(spark, path, delimiter, encoding)
    end, every = files.line_end(), files.paths()
    places = stretches(files, end, every)
    if not places:
        raise CsvError(f"{path}: no header")
    paths = sorted({s.path for s in places})
    number = {p: k for k, p in enumerate(paths)}
    known = headers(files, end, places, every)
    head = known[paths[0]]
    orders: dict[int, list[int]] = {}  # by file, of those that are unlike the first
    for p, own in known.items():
        if sorted(own) != sorted(head) or len(set(own)) < len(own) and own != head:
            raise CsvError(f"{p}: the header differs from that of {paths[0]}")
        if own != head:
            orders[number[p]] = [own.index(n) for n in head]
    numbers = {h: number[p] for h, p in every.items() if p in number}
    begun = {(number[s.path], s.start): s.origin and (number[s.origin[0]], s.origin[1]) for s in places if s.state == QUOTED}
    left_open = {(number[s.path], s.start): (number[s.left_open[0]], s.left_open[1]) for s in places if s.left_open}
    width, codec = len(head), encoding

    def fail(place, offset: int, what: str):
        raise CsvError(f"MALFORMED record after byte {offset} of {paths[place[0]]}: {what}")

    def fields_of(texts: list[str], place, offsets: list[int]) -> list[str]:
        try:
            rows = records(texts, delimiter)
        except (csv.Error, CsvError) as e:
            fail(place, offsets[0], str(e))
        for r, o in zip(rows, offsets, strict=True):
            if len(r) != width:
                fail(place, o, f"expected {width} fields, got {len(r)}")
        order = orders.get(place[0])
        return [packed_fields([r[k] for k in order] if order else r) for r in rows]

    def each(batches: Iterator[pa.RecordBatch], pieces: frozenset[tuple[int, int]] | None = None) -> Iterator[pa.RecordBatch]:
        """The records that lie in one stretch, or the pieces of some that do not."""
        decode = decoder(codec)
        place, base, pending, began, state, header, group = None, 0, [], 0, OUTSIDE, False, None

        def piece():
            rows = [pa.array([place[0] << PLACE_BITS | began]), pa.array([group[0] << PLACE_BITS | group[1]]), pa.array([end.join(pending)])]
            return pa.RecordBatch.from_arrays(rows, [ORDER, "piece", "text"])

        def left():
            """What is open at a stretch's end goes on in the next."""
            if state == QUOTED and pieces and group in pieces:
                yield piece()

        for b in batches:
            for first, last, path, start in runs(b):
                if path not in numbers:
                    raise CsvError("a file that was not there before")
                file = numbers[path]
                if (file, start) != place:
                    yield from left()
                    place, base, pending, began = (file, start), start, [], start
                    state, header = (QUOTED if place in begun else OUTSIDE), start == 0
                    group = begun.get(place) or left_open.get(place)
                raw = b.column(2).slice(first, last - first)
                size = pc.binary_length(raw).to_numpy().astype(np.int64) + len(end)
                offsets = base + np.cumsum(size) - size
                base += int(size.sum())
                values = decode(raw)
                ask = suspect(values)
                own, at, plain, k0, quick = [], [], np.ones(len(values), bool), 0, True
                if header and not ask[0]:
                    plain[0], header = False, False
                for k in np.flatnonzero(ask).tolist():
                    if k < k0:
                        continue
                    if state == QUOTED:  # lines up to here belong to the open record
                        pending += values.slice(k0, k - k0).to_pylist()
                        plain[k0:k] = False
                    elif quick and (block := Block.of(values[k:], OUTSIDE, delimiter, end)) and (found := block.records(delimiter, end, width)):
                        heads, texts, other, n = found
                        plain[k:], k0 = False, k + n
                        if len(heads) and header:
                            heads, texts, other, header = heads[1:], texts[1:], other[1:], False
                        if place[0] in orders:
                            other[:] = True
                        if pieces is None and len(heads):
                            places_here, stops = offsets[k:][heads], np.append(heads[1:], n)
                            for j in np.flatnonzero(other).tolist():
                                own.append(end.join(values.slice(k + int(heads[j]), int(stops[j] - heads[j])).to_pylist()))
                                at.append(int(places_here[j]))
                            yield batch(file, places_here[~other], texts.filter(pa.array(~other)) if other.any() else texts)
                        if block.after[-1] == QUOTED:
                            began, state, group = int(offsets[k0]), QUOTED, left_open.get(place)
                            pending = values[k0:].to_pylist()
                        k0 = len(values)
                        break
                    else:
                        began, quick = int(offsets[k]), False
                    plain[k] = False
                    line = values[k].as_py()
                    state, wrong = after_line(line, state, delimiter)
                    if wrong:
                        fail(place, int(offsets[k]), wrong)
                    pending.append(line)
                    k0 = k + 1
                    if state == OUTSIDE:
                        if group and group != place:  # the end of a record from before
                            if pieces and group in pieces:
                                yield piece()
                        elif header:
                            header = False
                        else:
                            own.append(end.join(pending))
                            at.append(began)
                        group, pending = left_open.get(place), []
                if state == QUOTED:
                    pending += values.slice(k0).to_pylist()
                    plain[k0:] = False
                if pieces is not None:
                    continue
                orders_here = orders.get(file)
                rest = values.filter(pa.array(plain))
                places_here = offsets[plain]
                if len(rest):
                    width_wrong = np.flatnonzero(pc.count_substring(rest, delimiter).to_numpy() != width - 1)
                    if len(width_wrong):
                        n = rest[int(width_wrong[0])].as_py().count(delimiter) + 1
                        fail(place, int(places_here[width_wrong[0]]), f"expected {width} fields, got {n}")
                    slow = np.full(len(rest), orders_here is not None)
                    if orders_here is None:
                        slow |= pc.starts_with(rest, ODD).to_numpy(zero_copy_only=False)
                        if delimiter != SEPARATOR:
                            slow |= pc.match_substring(rest, SEPARATOR).to_numpy(zero_copy_only=False)
                    if slow.any():
                        own += rest.filter(pa.array(slow)).to_pylist()
                        at += places_here[slow].tolist()
                        rest, places_here = rest.filter(pa.array(~slow)), places_here[~slow]
                    if len(rest):
                        texts = rest if delimiter == SEPARATOR else pc.replace_substring(rest, delimiter, SEPARATOR)
                        yield batch(file, places_here, texts)
                if own:
                    yield batch(file, np.array(at, np.int64), pa.array(fields_of(own, place, at), pa.string()))
        yield from left()

    def batch(file: int, at: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at + (file << PLACE_BITS)), texts.cast(pa.string())], [ORDER, PACKED])

    lines = files.lines(end).selectExpr("path", "start", files.value)
    whole = lines.mapInArrow(lambda batches: each(batches), f"{ORDER} long, {PACKED} string")
    if not left_open:
        return Source(whole, tuple(normalize_headers(head)))

    @F.pandas_udf("string")
    def parsed(order: pd.Series, text: pd.Series) -> pd.Series:
        mask = (1 << PLACE_BITS) - 1
        return pd.Series([fields_of([t], (o >> PLACE_BITS, 0), [o & mask])[0] for o, t in zip(order, text, strict=True)], dtype=object)

    crossing: dict[tuple[str, int], list[Stretch]] = {}  # records, by where they begin: the stretches that they touch
    for s in places:
        for origin in {s.origin, s.left_open} - {None}:
            crossing.setdefault(origin, []).append(s)
    short, long, parts = [], {}, []
    for origin, touched in crossing.items():
        texts = [touched[0].tail, *[s.head for s in touched[1:]]]
        if None in texts:
            long[number[origin[0]], origin[1]] = touched
        else:
            short.append((number[origin[0]] << PLACE_BITS | touched[0].at, end.join(texts)))
    if short:
        parts.append(spark.createDataFrame(pa.table({ORDER: pa.array([o for o, _ in short], pa.int64()), "text": pa.array([t for _, t in short], pa.string())})))
    if long:  # their stretches are read once more for the pieces, a few lines of each
        wanted, hashes = frozenset(long), {p: h for h, p in every.items()}
        again = sorted({(hashes[s.path], s.start) for touched in long.values() for s in touched})
        few = spark.createDataFrame(pa.table({"path": pa.array([h for h, _ in again], pa.int64()), "start": pa.array([x for _, x in again], pa.int64())}))
        pieces = lines.join(F.broadcast(few), ["path", "start"]).mapInArrow(lambda batches: each(batches, wanted), f"{ORDER} long, piece long, text string")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ORDER, "text"))), lambda p: p["text"]), end)
        parts.append(pieces.groupBy("piece").agg(F.min(ORDER).alias(ORDER), text.alias("text")).select(ORDER, "text"))
    for p in parts:
        whole = whole.unionByName(p.select(ORDER, parsed(F.col(ORDER), F.col("text")).alias(PACKED)))
    return Source(whole, tuple(normalize_headers(head)))


def check_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8", end: str = "\n") -> None:
    """Raises CsvError if a file's quotes are not those of strict CSV. Widths and blank lines are the reader's to check."""
    files = Files(spark, path, delimiter, encoding)
    stretches(files, end, files.paths())
