"""An .xlsx workbook of text cells, written with the standard library."""

from __future__ import annotations

import io
import re
import string
import zipfile
from collections.abc import Iterable
from itertools import chain, count
from xml.sax.saxutils import escape, quoteattr

# Limits of the format, and what it forbids in sheet names.
MAX_ROWS, MAX_COLUMNS, MAX_CELL, MAX_NAME = 1_048_576, 16_384, 32_767, 31
FORBIDDEN = "[]:*?/\\"
RESERVED = "history"
SPECIAL = re.compile("_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")

# Namespaces and content types of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def valid_name(name: str) -> str:
    """The nearest name that the format allows for a sheet, not yet shortened: never blank, no sign that it forbids, no
    apostrophe at an end, not the reserved word."""
    own = "".join(" " if ch in FORBIDDEN or not ch.isprintable() else ch for ch in name)
    own = own.strip(" '")
    return f"{own} sheet".strip() if own.casefold() in ("", RESERVED) else own


def sheet_names(names: Iterable[str]) -> list[str]:
    """A valid, distinct sheet name for each, without regard to case; the first of equal ones keeps its own."""
    taken: dict[str, str] = {}
    for name in names:
        whole = valid_name(name)
        marks = chain([""], (f" ({k})" for k in count(2)))
        tries = (whole[: MAX_NAME - len(mark)].rstrip(" '") + mark for mark in marks)
        chosen = next(x for x in tries if x.casefold() not in taken)
        taken[chosen.casefold()] = chosen
    return list(taken.values())


def letters(column: int) -> str:
    """The letters of a column, counted from 1."""
    out = ""
    while column:
        column, k = divmod(column - 1, 26)
        out = string.ascii_uppercase[k] + out
    return out


def escaped(text: str) -> str:
    """The format's own escapes: signs that XML has no place for as _xHHHH_, and the underscore of texts that read like one."""
    return SPECIAL.sub(lambda m: f"_x{ord(m[0]):04X}_", text)


def cell(text: str) -> str:
    if len(text) + sum(ch > "\uffff" for ch in text) > MAX_CELL:  # counted in UTF-16 units
        raise ValueError(f"a worksheet's cell holds {MAX_CELL} characters")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(escaped(text), {chr(13): "&#13;"})}</t></is></c>'


def _sheet(f, rows: Iterable[Iterable[object]], links: dict[int, str]) -> None:
    """One worksheet: the first row frozen and filtered, links from rows to other sheets."""
    f.write(f'<?xml version="1.0"?><worksheet xmlns="{MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
    width = n = 0
    for n, row in enumerate(rows, 1):
        own = ["" if x is None else str(x) for x in row]
        width = max(width, len(own))
        if n > MAX_ROWS or width > MAX_COLUMNS:
            raise ValueError(f"a worksheet holds {MAX_ROWS} rows and {MAX_COLUMNS} columns")
        f.write(f'<row r="{n}">{"".join(map(cell, own))}</row>'.encode())
    f.write(b"</sheetData>")
    if width:
        f.write(f'<autoFilter ref="A1:{letters(width)}{n}"/>'.encode())
    if links:
        targets = ((row, "'" + name.replace("'", "''") + "'!A1") for row, name in links.items())
        f.write(f'<hyperlinks>{"".join(f"<hyperlink ref={quoteattr(f"A{row}")} location={quoteattr(to)}/>" for row, to in targets)}</hyperlinks>'.encode())
    f.write(b"</worksheet>")


def workbook(sheets: dict[str, Iterable[Iterable[object]]], contents: str | None = None) -> bytes:
    """The file's bytes; every cell is text, never a formula. contents: the name of a first sheet that lists and links the others."""
    names = sheet_names([*([contents] if contents else []), *sheets])
    parts: list[tuple[Iterable[Iterable[object]], dict[int, str]]] = [(rows, {}) for rows in sheets.values()]
    if contents:
        parts.insert(0, ([["sheet", "of"], *zip(names[1:], sheets, strict=True)], dict(enumerate(names[1:], 2))))
    numbers = range(1, len(names) + 1)
    one = lambda tag, **a: f"<{tag} {' '.join(f'{k}={quoteattr(v)}' for k, v in a.items())}/>"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types">'
        + one("Default", Extension="rels", ContentType="application/vnd.openxmlformats-package.relationships+xml")
        + one("Override", PartName="/xl/workbook.xml", ContentType=f"{KIND}.sheet.main+xml")
        + "".join(one("Override", PartName=f"/xl/worksheets/sheet{k}.xml", ContentType=f"{KIND}.worksheet+xml") for k in numbers)
        + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + one("Relationship", Id="book", Type=f"{RELATION}/officeDocument", Target="xl/workbook.xml") + "</Relationships>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(one("Relationship", Id=f"s{k}", Type=f"{RELATION}/worksheet", Target=f"worksheets/sheet{k}.xml") for k in numbers) + "</Relationships>",
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATION}"><sheets>' + "".join(one("sheet", **{"name": n, "sheetId": str(k), "r:id": f"s{k}"}) for k, n in zip(numbers, names, strict=True)) + "</sheets></workbook>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, f'<?xml version="1.0"?>{text}')
        for k, (rows, links) in zip(numbers, parts, strict=True):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                _sheet(f, rows, links)
    return out.getvalue()
