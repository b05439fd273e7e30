"""Workbooks as a relation of cells, read from the package's parts (.xlsx here): formula and cached value side by side.

Numbers stay the text that the file holds and never pass through a float. Files come through Spark's own file readers,
so any file system works, a lost task reads its file again, and one file is one unit of work.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.sources.packages import package_cells

SCHEMA = "file string, sheet string, sheet_index int, visible boolean, row int, col int, formula string, value string, kind string, merged string"
#: Bounds of an admitted package: members, inflated bytes, ratio of a member.
MOST_MEMBERS, MOST_BYTES, MOST_RATIO = 10_000, 1024 * 1024 * 1024, 300.0
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def admit(package: zipfile.ZipFile) -> None:
    """Fail on packages that are too large, inflate too much, or hold unsafe paths."""
    from reckon.sources.files import unsafe_member

    members = package.infolist()
    if len(members) > MOST_MEMBERS or sum(m.file_size for m in members) > MOST_BYTES:
        raise ValueError("package too large")
    for m in members:
        if unsafe_member(m.filename) or m.file_size / max(1, m.compress_size) > MOST_RATIO:
            raise ValueError(f"member not admitted: {m.filename}")


def position(reference: str) -> tuple[int, int]:
    """(row, column) of a reference such as BC12, from 1."""
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", reference).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits), col


def text_of(node: ET.Element | None) -> str:
    """All runs of a string item, phonetic hints left out."""
    if node is None:
        return ""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == f"{MAIN}t" else child.findall(f"{MAIN}t") if child.tag == f"{MAIN}r" else []))


def workbook_cells(body: bytes, file: str, max_row: int | None = None, max_col: int | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA for one package, sheets in order; rows and columns beyond the bounds are not parsed further."""
    if (other := package_cells(body, file, max_row, max_col)) is not None:
        yield from other
        return
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        admit(z)
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, node in ET.iterparse(f):
                    if node.tag == f"{MAIN}si":
                        shared.append(text_of(node))
                        node.clear()
        targets = {}
        for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            path = r.get("Target")
            targets[r.get("Id")] = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
        for n, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")):
            part = targets.get(sheet.get(f"{REL}id"))
            if part not in names:
                continue
            merged = {}
            with z.open(part) as f:
                for _, node in ET.iterparse(f):
                    if node.tag == f"{MAIN}mergeCell":
                        merged[position(node.get("ref").split(":")[0])] = node.get("ref")
                    elif node.tag == f"{MAIN}row":
                        node.clear()
            head = (file, sheet.get("name"), n, sheet.get("state", "visible") == "visible")
            with z.open(part) as f:
                for _, node in ET.iterparse(f):
                    if node.tag == f"{MAIN}c":
                        row, col = position(node.get("r"))
                        if (max_row and row > max_row) or (max_col and col > max_col):
                            continue
                        yield (*head, row, col, *content(node, shared), merged.get((row, col)))
                    elif node.tag == f"{MAIN}row":
                        over = max_row and int(node.get("r", 0)) >= max_row
                        node.clear()
                        if over:
                            break


def content(node: ET.Element, shared: list[str]) -> tuple[str | None, str | None, str]:
    """(formula, value, kind) of a cell: kind is number, text, boolean, error, date or empty."""
    kind, value = node.get("t", "n"), node.findtext(f"{MAIN}v")
    f = node.find(f"{MAIN}f")
    formula = None if f is None else f"={f.text or ''}"
    if kind == "inlineStr":
        value = text_of(node.find(f"{MAIN}is"))
    elif kind == "s" and value is not None:
        value = shared[int(value)]
    names = {"n": "number", "s": "text", "str": "text", "inlineStr": "text", "b": "boolean", "e": "error", "d": "date"}
    return formula, value, "empty" if value is None and formula is None else names.get(kind, "text")


def read_cells(spark: SparkSession, *paths: str, max_row: int | None = None, max_col: int | None = None) -> DataFrame:
    """All cells of the workbooks under the paths. A package that is not admitted fails its task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for path, body in zip(b["path"], b["content"]):
                rows = []
                for r in workbook_cells(body, path, max_row, max_col):
                    rows.append(r)
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(parse, SCHEMA)


def sheet_metadata(cells: DataFrame) -> DataFrame:
    """One row per sheet: index, visibility, cells, formulas, errors, merged ranges, and the rows and columns that are used."""
    filled = F.col("kind") != "empty"
    of = lambda f, c: f(F.when(filled, F.col(c)))
    return cells.groupBy("file", "sheet").agg(
        F.min("sheet_index").alias("sheet_index"), F.bool_and("visible").alias("visible"), F.count_if(filled).alias("n_cells"), F.count("formula").alias("n_formulas"), F.count_if(F.col("kind") == "error").alias("n_errors"),
        F.count_distinct("merged").alias("n_merged"), of(F.min, "row").alias("first_row"), of(F.max, "row").alias("last_row"), of(F.min, "col").alias("first_col"), of(F.max, "col").alias("last_col"),
    )
