"""Worksheets of .xlsx files as text tables, read with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import ORDER

# The namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MAX_COLUMNS = 16_384


def sheets(content: bytes) -> list[tuple[str, str, str]]:
    """(name, part, state) of the worksheets inside a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = {r.get("Id"): r.get("Target") or "" for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("TargetMode") != "External" and (r.get("Type") or "").endswith("/worksheet")}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        found = [(s.get("name") or "", targets.get(s.get(LINK)), s.get("state", "visible")) for s in book.iter(f"{MAIN}sheet")]
    return [(n, t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"xl/{t}"), state) for n, t, state in found if t]


def _text(node: ET.Element) -> str:
    """Plain text of a string item: all runs, without phonetic hints."""
    own = [t.text or "" for t in node.findall(f"{MAIN}t")]
    return "".join(own + [t.text or "" for r in node.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t")])


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():  # type: ignore[union-attr]
        n = 26 * n + ord(ch) - 64
    return n - 1


def rows(content: bytes, part: str) -> Iterator[list[str]]:
    """The header (row 1) and then each data row that is not blank, as the stored texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        header: list[str] | None = None
        with z.open(part) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                cells: dict[int, str] = {}
                at = -1
                for c in row.findall(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else at + 1  # type: ignore[arg-type]
                    v, kind = c.find(f"{MAIN}v"), c.get("t")
                    raw = (v.text or "") if v is not None else ""
                    if c.find(f"{MAIN}f") is not None and (v is None or (not raw and kind != "str")):
                        raise ValueError("a formula has no saved result")
                    if kind == "inlineStr":
                        raw = _text(c.find(f"{MAIN}is"))  # type: ignore[arg-type]
                    elif kind == "s" and raw:
                        raw = shared[int(raw)]
                    elif kind == "b":
                        raw = {"1": "TRUE", "0": "FALSE"}.get(raw, raw)
                    cells[at] = raw
                number = row.get("r")
                row.clear()
                if any(k >= MAX_COLUMNS for k in cells):
                    raise ValueError("too many columns")
                if header is None:
                    if number not in (None, "1") or not any(cells.values()):
                        raise ValueError("the first row must hold the headers")
                    header = [cells.get(k, "") for k in range(max(k for k, v in cells.items() if v) + 1)]
                    if not all(header) or len(set(header)) < len(header):
                        raise ValueError("headers are blank or repeated")
                    yield header
                elif any(cells.values()):
                    if any(v for k, v in cells.items() if k >= len(header)):
                        raise ValueError("data past the header")
                    yield [cells.get(k, "") for k in range(len(header))]


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A worksheet (the first one, or by name) as text with its source order. A sheet has at most 1,048,576 rows
    and is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("content")
    found = sheets(bytes(files.first().content))
    part = next((p for n, p, _ in found if sheet in (None, n)), None)
    if part is None:
        raise ValueError(f"no worksheet {sheet!r}")
    header = next(rows(bytes(files.first().content), part))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                it = rows(content, part)
                next(it)
                yield pd.DataFrame([(n, r) for n, r in enumerate(it)], columns=["n", "v"])

    out = files.mapInPandas(each, "n long, v array<string>")
    return out.select(*[F.col("v")[k].alias(h) for k, h in enumerate(header)], F.col("n").alias(ORDER))
