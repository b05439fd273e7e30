"""Workbooks other than .xlsx as the same relation of cells: binary .xlsb records, and .ods XML."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

#: Record numbers of the public binary format that are read: sheets, shared strings, rows, merged cells, cells by content.
SHEET, STRING, ROW, MERGED = 156, 19, 0, 176
BLANK, RK, ERROR, BOOL, REAL, TEXT, SHARED, F_TEXT, F_REAL, F_BOOL, F_ERROR = range(1, 12)
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#GETTING_DATA"}
OFFICE, TABLE, TEXTNS = ("{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % x for x in ("office", "table", "text"))


def records(body: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, data) of a binary part: numbers take one or two bytes, lengths up to four, seven bits each."""
    at = 0
    while at < len(body):
        number = body[at]
        at += 1
        if number & 0x80:
            number = (number & 0x7F) | (body[at] & 0x7F) << 7
            at += 1
        size = shift = 0
        for _ in range(4):
            part = body[at]
            at += 1
            size |= (part & 0x7F) << shift
            shift += 7
            if not part & 0x80:
                break
        yield number, body[at : at + size]
        at += size


def wide(data: bytes, at: int) -> tuple[str, int]:
    """A string of 16-bit characters after its length, and the place behind it."""
    (n,) = struct.unpack_from("<I", data, at)
    if n == 0xFFFFFFFF:
        return "", at + 4
    return data[at + 4 : at + 4 + 2 * n].decode("utf-16-le"), at + 4 + 2 * n


def number_text(value: float) -> str:
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def rk(packed: int) -> str:
    """A packed number: an integer of 30 bits or the upper bits of a float, each maybe in hundredths."""
    if packed & 2:
        value = float((packed if packed < 1 << 31 else packed - (1 << 32)) >> 2)
    else:
        (value,) = struct.unpack("<d", struct.pack("<Q", (packed & 0xFFFFFFFC) << 32))
    return number_text(value / 100 if packed & 1 else value)


def binary_cell(number: int, data: bytes, shared: list[str]) -> tuple[str | None, str | None, str]:
    """(formula, value, kind) of a cell record. Formulas are stored as tokens, so '=' stands for their text."""
    formula = "=" if number >= F_TEXT else None
    if number == BLANK:
        return None, None, "empty"
    if number == RK:
        return formula, rk(struct.unpack_from("<I", data, 8)[0]), "number"
    if number in (REAL, F_REAL):
        return formula, number_text(struct.unpack_from("<d", data, 8)[0]), "number"
    if number in (ERROR, F_ERROR):
        return formula, ERRORS.get(data[8], "#ERROR!"), "error"
    if number in (BOOL, F_BOOL):
        return formula, str(int(data[8] != 0)), "boolean"
    return formula, shared[struct.unpack_from("<I", data, 8)[0]] if number == SHARED else wide(data, 8)[0], "text"


def xlsb_cells(z: zipfile.ZipFile, file: str, max_row: int | None = None, max_col: int | None = None) -> Iterator[tuple]:
    """Rows of cells.SCHEMA of a binary workbook, sheets in order."""
    names = set(z.namelist())
    shared = [wide(d, 1)[0] for n, d in records(z.read("xl/sharedStrings.bin")) if n == STRING] if "xl/sharedStrings.bin" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.bin.rels"))}
    sheets = [d for n, d in records(z.read("xl/workbook.bin")) if n == SHEET]
    for index, d in enumerate(sheets):
        (state,) = struct.unpack_from("<I", d)
        rel, at = wide(d, 8)
        name, _ = wide(d, at)
        target = targets.get(rel, "")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if part not in names:
            continue
        body, row = z.read(part), 0
        merged = {}
        for n, data in records(body):
            if n == MERGED:
                top, bottom, left, right = struct.unpack_from("<4I", data)
                merged[top + 1, left + 1] = f"{reference(top + 1, left + 1)}:{reference(bottom + 1, right + 1)}"
        for n, data in records(body):
            if n == ROW:
                row = struct.unpack_from("<I", data)[0] + 1
                if max_row and row > max_row:
                    break
            elif BLANK <= n <= F_ERROR:
                col = struct.unpack_from("<I", data)[0] + 1
                if not (max_col and col > max_col):
                    yield (file, name, index, state == 0, row, col, *binary_cell(n, data, shared), merged.get((row, col)))


def reference(row: int, col: int) -> str:
    letters = ""
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def ods_cells(z: zipfile.ZipFile, file: str, max_row: int | None = None, max_col: int | None = None) -> Iterator[tuple]:
    """Rows of cells.SCHEMA of an open document, sheets in order; repeated cells and rows are spread out, empty ones skipped."""
    index, name, row, repeat = -1, "", 0, 1
    with z.open("content.xml") as f:
        for event, node in ET.iterparse(f, events=("start", "end")):
            if event == "start" and node.tag == f"{TABLE}table":
                index, name, row = index + 1, node.get(f"{TABLE}name"), 0
            elif event == "end" and node.tag == f"{TABLE}table-row":
                repeat = int(node.get(f"{TABLE}number-rows-repeated", 1))
                found, col = [], 0
                for cell in node:
                    times = int(cell.get(f"{TABLE}number-columns-repeated", 1))
                    if cell.tag == f"{TABLE}table-cell":
                        formula, value, kind = open_cell(cell)
                        if value is not None or formula is not None:
                            span = int(cell.get(f"{TABLE}number-rows-spanned", 1)), int(cell.get(f"{TABLE}number-columns-spanned", 1))
                            found += [(col + k + 1, formula, value, kind, span) for k in range(times) if not (max_col and col + k + 1 > max_col)]
                    col += times
                for k in range(repeat if found else 0):
                    if max_row and row + k + 1 > max_row:
                        break
                    for at, formula, value, kind, (down, right) in found:
                        top = row + k + 1
                        merged = f"{reference(top, at)}:{reference(top + down - 1, at + right - 1)}" if down * right > 1 else None
                        yield file, name, index, True, top, at, formula, value, kind, merged
                row += repeat
                node.clear()


def open_cell(cell: ET.Element) -> tuple[str | None, str | None, str]:
    formula = cell.get(f"{TABLE}formula")
    formula = None if formula is None else "=" + formula.split("=", 1)[1]
    kind = cell.get(f"{OFFICE}value-type")
    texts = ["".join(p.itertext()) for p in cell.findall(f"{TEXTNS}p")]
    if kind in ("float", "percentage", "currency"):
        return formula, cell.get(f"{OFFICE}value"), "number"
    if kind == "boolean":
        return formula, str(int(cell.get(f"{OFFICE}boolean-value") == "true")), "boolean"
    if kind == "date":
        return formula, cell.get(f"{OFFICE}date-value"), "date"
    if kind is None and not texts:
        return formula, None, "empty"
    value = "\n".join(texts)
    return formula, value, "error" if value.startswith("#") and formula is not None else "text"


def package_cells(body: bytes, file: str, max_row: int | None = None, max_col: int | None = None) -> Iterator[tuple] | None:
    """Cells of a package that is not .xlsx; None for one that is."""
    from reckon.sources.cells import admit

    z = zipfile.ZipFile(io.BytesIO(body))
    admit(z)
    names = set(z.namelist())
    if "xl/workbook.bin" in names:
        return xlsb_cells(z, file, max_row, max_col)
    if "content.xml" in names and "xl/workbook.xml" not in names:
        return ods_cells(z, file, max_row, max_col)
    return None
