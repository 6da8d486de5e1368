"""Licence-server and procurement exports: what kind of file it is, and its cells as text with source rows.

Only a file's first bytes are looked at on the driver; rows are read by Spark. Lines of delimited files are joined to
records where a quoted cell goes on, numbered, and parsed by Spark's CSV functions; workbooks go through a scan of binary files, each sheet's rows as maps of header to cell.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are taken, and the first bytes of containers.
EXTENSIONS = (".csv", ".tsv", ".txt", ".xlsx", ".xlsm")
ZIP, OLD_WORKBOOK = b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
MARKS = ((b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"), (b"\xef\xbb\xbf", "UTF-8"))
DELIMITERS = ("\t", ",", ";", "|")


def accepted_name(name: str) -> bool:
    return name.lower().endswith(EXTENSIONS)


def kind_of(head: bytes) -> str:
    """``workbook`` or ``text`` by content, whatever the name says; old binary workbooks are refused."""
    if head.startswith(OLD_WORKBOOK):
        raise ValueError("workbooks of the old binary format cannot be read; save as .xlsx")
    return "workbook" if head.startswith(ZIP) else "text"


def encoding_of(head: bytes) -> str:
    return next((name for mark, name in MARKS if head.startswith(mark)), "UTF-8")


def delimiter_of(head: bytes, name: str = "") -> str:
    """The commonest delimiter of the head line; .tsv settles it."""
    if name.lower().endswith(".tsv"):
        return "\t"
    line = head.decode(encoding_of(head), "replace").lstrip("﻿").split("\n", 1)[0]
    best = max(DELIMITERS, key=line.count)
    return best if line.count(best) else ","


def head_of(spark: SparkSession, path: str, size: int = 65_536) -> bytes:
    """The first bytes of one file, from any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def text_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(value): the lines of one file in their order, blank ones too. UTF-8 is split; other encodings are decoded by one task."""
    if encoding == "UTF-8":
        return spark.read.text(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                lines = re.split("\r\n|\n|\r", content.as_py().decode(encoding))
                if lines and not lines[-1]:
                    lines.pop()
                for at in range(0, len(lines), ROWS_AT_ONCE):
                    yield pa.RecordBatch.from_pydict({"value": pa.array(lines[at : at + ROWS_AT_ONCE], pa.string())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decoded, "value string")


def _closed(line: str, at: int) -> int:
    """The place after the quote that closes a cell whose inside goes on at ``at``; -1 if it stays open. Two quotes are one of the cell."""
    while (at := line.find('"', at)) >= 0:
        if line[at + 1 : at + 2] != '"':
            return at + 1
        at += 2
    return -1


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted cell is open after ``line``, which began inside of one or not. Only a quote at a cell's beginning opens one."""
    at = 0
    while True:
        if inside or line[at : at + 1] == '"':
            at = _closed(line, at if inside else at + 1)
            if at < 0:
                return True
            inside = False
        at = line.find(delimiter, at) + 1
        if not at:
            return False


@dataclass(frozen=True)
class Part:
    """A partition of lines: for a beginning outside and inside of a quoted cell, how many records end in it, and whether one is open at its end."""

    ended: tuple[int, int]
    open: tuple[bool, bool]
    lines: int


def line_parts(lines: DataFrame, delimiter: str) -> dict[int, Part]:
    """What each partition does to the state of a reader: one small row for each, so that all partitions are read at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, ended, n = [False, True], [0, 0], 0
        for batch in batches:
            values = batch.column("value")
            quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
            before = 0
            for k in quoted.tolist():
                line = values[k].as_py()
                for h in (0, 1):
                    ended[h] += 0 if state[h] else k - before
                    state[h] = ends_inside(line, state[h], delimiter)
                    ended[h] += not state[h]
                before = k + 1
            for h in (0, 1):
                ended[h] += 0 if state[h] else batch.num_rows - before
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64()), "ended": pa.array([ended], pa.list_(pa.int64())), "open": pa.array([state], pa.list_(pa.bool_()))})

    rows = lines.mapInArrow(run, "part bigint, n bigint, ended array<bigint>, open array<boolean>").collect()
    return {r["part"]: Part(tuple(r["ended"]), tuple(r["open"]), r["n"]) for r in rows}


def records(lines: DataFrame, delimiter: str) -> DataFrame:
    """(record, text): lines joined where a quoted cell goes on, each with its number; blank lines count as records.

    A record that begins in one partition and ends in another is put together from its parts; others stay where they are.
    """
    begin, number, inside, crossing = {}, 1, False, False
    for part, p in sorted(line_parts(lines, delimiter).items()):
        begin[part] = (number, inside)
        number += p.ended[inside]
        inside = p.open[inside]
        crossing |= inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, open_now = begin[part]
        held: list[str] = []
        whole = not open_now

        def out(record: list[int], texts: list[str], is_whole: list[bool]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"record": pa.array(record, pa.int64()), "piece": pa.array([part] * len(record), pa.int64()), "text": pa.array(texts, pa.string()), "whole": pa.array(is_whole, pa.bool_())})

        for batch in batches:
            values = batch.column("value").to_pylist()
            rows: tuple[list[int], list[str], list[bool]] = ([], [], [])
            for line in values:
                held.append(line)
                if open_now or '"' in line:
                    open_now = ends_inside(line, open_now, delimiter)
                if not open_now:
                    for column, value in zip(rows, (at, "\n".join(held), whole)):
                        column.append(value)
                    at, held, whole = at + 1, [], True
            yield out(*rows)
        if held:
            yield out([at], ["\n".join(held)], [False])

    pieces = lines.mapInArrow(run, "record bigint, piece bigint, text string, whole boolean")
    if not crossing:
        return pieces.select("record", "text")
    parts = pieces.where("NOT whole").groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return pieces.where("whole").select("record", "text").unionByName(parts)


def breaks_in_cells(spark: SparkSession, path: str, delimiter: str) -> bool:
    """Whether a quoted cell of a UTF-8 file goes on in the next line."""
    inside = False
    for _, p in sorted(line_parts(text_lines(spark, path, "UTF-8"), delimiter).items()):
        if p.ended[inside] != p.lines:
            return True
        inside = p.open[inside]
    return False


def header_names(cells: list[str | None]) -> list[str]:
    """Column names by place: a blank one becomes ``Column n``, and a name that came before, whatever its case, gets a number."""
    out: list[str] = []
    taken: set[str] = {"source_row"}
    for k, c in enumerate(cells, 1):
        name = base = (c or "").lstrip("\ufeff").strip() or f"Column {k}"
        n = 1
        while name.lower() in taken:
            n += 1
            name = f"{base} ({n})"
        taken.add(name.lower())
        out.append(name)
    return out


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, and ``source_row``: the number of the row in its file, where the head line is 1 and blank lines count.

    Rows without any text are left out. Line breaks inside quotes belong to their cell (as one line feed, whatever they
    were); large UTF-8 files are split all the same, as every partition knows with which row it begins.
    """
    head = head_of(spark, path)
    encoding = encoding_of(head)
    delimiter = delimiter_of(head, path)
    rows = records(text_lines(spark, path, encoding), delimiter)
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    first = rows.where("record = 1").first()
    if first is None:
        raise ValueError(f"the file is empty: {path}")
    n = max(1, len(next(csv.reader(io.StringIO(first["text"].lstrip("\ufeff"), newline=""), delimiter=delimiter), [""])))
    schema = ", ".join(f"c{k} string" for k in range(n))
    cells = F.from_csv("text", schema, options)
    heads = spark.createDataFrame([(first["text"].lstrip("\ufeff"),)], "text string").select(cells.alias("c")).select("c.*").first()
    parsed = rows.where("record > 1 AND trim(text) <> ''").select("record", cells.alias("c")).select("record", "c.*")
    some = F.exists(F.array(*[F.col(f"c{k}") for k in range(n)]), lambda x: F.coalesce(x.rlike(r"\S"), F.lit(False)))
    return parsed.where(some).select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(header_names(list(heads)))], F.col("record").alias("source_row"))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Rows of a workbook that are handed on together.
ROWS_AT_ONCE = 5_000


def _text(node: ElementTree.Element | None) -> str:
    return "" if node is None else "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t"))


def _part(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _sheet_parts(book: zipfile.ZipFile, workbook: ElementTree.Element) -> list[tuple[str, str]]:
    """(sheet name, its part) in the workbook's order: by relationship, without relationships by the parts' numbers."""
    sheets = workbook.findall(f"{_MAIN}sheets/{_MAIN}sheet")
    relations = _part(book, "xl/_rels/workbook.xml.rels")
    if relations is None:
        parts = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        return list(zip([s.get("name", "") for s in sheets], parts))
    targets = {r.get("Id"): r.get("Target", "") for r in relations}
    found = [(s.get("name", ""), targets.get(s.get(_RELATION), "")) for s in sheets]
    named = [(name, t[1:] if t.startswith("/") else f"xl/{t}") for name, t in found]
    return [(name, part) for name, part in named if part in book.namelist()]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or a time."""
    styles = _part(book, "xl/styles.xml")
    if styles is None:
        return set()
    own = {int(f.get("numFmtId", "0")): f.get("formatCode", "") for f in styles.findall(f"{_MAIN}numFmts/{_MAIN}numFmt")}
    dated = DATE_FORMATS | {k for k, code in own.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[(?!h+\]|m+\]|s+\])[^]]*\]|\\.|_.|General', "", code), re.IGNORECASE)}
    return {k for k, xf in enumerate(styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf")) if int(xf.get("numFmtId", "0")) in dated}


def serial_text(serial: float, since_1904: bool = False) -> str:
    """A date cell's number of days as text: the date, and the time to the second if it has one."""
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30) if serial >= 60 else datetime(1899, 12, 31)
    at = start + timedelta(seconds=round(serial * 86_400))
    return at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def _cell_text(c: ElementTree.Element, shared: list[str], dated: set[int], since_1904: bool) -> str:
    kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
    raw = (value.text or "") if value is not None else ""
    if kind == "inlineStr":
        return _text(c.find(f"{_MAIN}is"))
    if kind == "s" and raw:
        return shared[int(raw)]
    if kind == "n" and raw and int(c.get("s", "0")) in dated and 0 <= float(raw) < 2_958_466:
        return serial_text(float(raw), since_1904)
    return raw


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells as text) of every sheet; a formula gives its stored result, a date cell its date.

    Sheets are read row by row; only the texts that cells share are held whole.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _part(book, "xl/sharedStrings.xml")
        shared = [] if strings is None else [_text(s) for s in strings.findall(f"{_MAIN}si")]
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        settings = workbook.find(f"{_MAIN}workbookPr")
        since_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        dated = _date_styles(book)
        for sheet, part in _sheet_parts(book, workbook):
            with book.open(part) as stream:
                for _, row in ElementTree.iterparse(stream):
                    if row.tag != f"{_MAIN}row":
                        continue
                    cells: dict[int, str] = {}
                    for c in row.findall(f"{_MAIN}c"):
                        place = 0
                        for letter in re.sub(r"\d", "", c.get("r", "A")):
                            place = place * 26 + ord(letter) - 64
                        cells[place] = _cell_text(c, shared, dated, since_1904)
                    yield sheet, int(row.get("r", "0")), [cells.get(k, "") for k in range(1, max(cells, default=0) + 1)]
                    row.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each non-blank row below the first of each sheet: file, sheet, source_row, cells (header -> text).

    A workbook is read by one task, which holds its compressed bytes and a few thousand rows at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "sheet", "source_row", "cells"]
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows, headers = [], {}
                for sheet, at, cells in sheet_rows(content):
                    if at == 1:
                        headers[sheet] = [h.strip() or f"Column {k}" for k, h in enumerate(cells, 1)]
                    elif any(c.strip() for c in cells):
                        heads = headers.get(sheet, [])
                        rows.append((name, sheet, at, {h: c for h, c in zip(heads, cells) if c.strip()}))
                        if len(rows) == ROWS_AT_ONCE:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, sheet string, source_row bigint, cells map<string,string>")
