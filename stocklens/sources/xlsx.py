"""SRC-06: spreadsheets (.xlsx) as a Spark data source, read and written in parallel.

    register(spark)
    spark.read.format("xlsx").option("columns", "id,name").load("dir-or-file")
    df.write.format("xlsx").mode("append").save("dir")

A workbook is a zip of XML files. The reader makes one partition per file and range of
``rows`` sheet rows; a task inflates the sheet as a stream, passes over the rows before its
range without parsing them, and parses its range only, a stretch of whole rows at a time: as
Arrow columns where rows are written plainly and all columns are text, else as XML elements.
Sheets that do not state their size or number their rows are one partition. ``columns`` keeps only the named columns: other cells are
passed over.

Without a schema every column is text: numbers as the file writes them, cells with a date
format as ``yyyy-MM-dd HH:mm:ss``, booleans as ``true`` or ``false``, error cells null. With a
schema cells are converted to its types; what does not convert is null. The first row is the
header; columns are matched by name, a missing one is null, of equal names the first counts.
Day numbers count from 1899-12-30 (1904-01-01 in workbooks that say so); day 60 of the former
is no date and gives null.

The writer makes files of at most ``rows`` rows (65,536 by default), so a task holds the text of
one file only. Instants are kept to the millisecond, infinities and NaN as text. A sheet's rows are
deflated in stretches that can be inflated on their own; an extra field of the zip entry, which
other programs pass over, tells where they begin, so that a range inflates its own rows only.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
import sys
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 65_536              # sheet rows of a partition, and rows of a written file
CHUNK = 1 << 18            # inflated bytes read at a time
STRETCH = 1_000            # rows deflated so that they can be inflated on their own
MARKS = 0x6C53             # id of the extra field that tells where such rows begin
MOST_MARKS = 4_000         # of a sheet: an extra field holds 64 KB
TASKS = 1_000              # partitions of a read; beyond that neighbouring ranges share one
# Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCH = dt.datetime(1899, 12, 30)
EPOCH_1904 = dt.datetime(1904, 1, 1)
ROW = re.compile(rb'<(?:\w+:)?row(?=[\s/>])(?:[^>]*?\sr="(\d+)")?[^>]*>')
SHEET_DATA = re.compile(rb"<(?:\w+:)?sheetData[^>]*>")
SHEET_END = re.compile(rb"</(?:\w+:)?sheetData\s*>")
# Tags of plainly written rows as letters, and how they follow one another.
TAGS = {"<row>": "R", "</row>": "r", "</c>": "c", "<v>": "v", "</v>": "V", "<is>": "i", "</is>": "I", "<t>": "t", '<t xml:space="preserve">': "t", "</t>": "T"}
PLAIN_CELL = re.compile(r'<c(?: t="(?P<t>\w+)"| s="(?P<s>\d+)")*(?P<empty>/?)>')
PLAIN_ROW = r'^<row r="[0-9]{1,15}"(?: [A-Za-z0-9:]+="[^"]*")*>$'
PLAIN_ROWS = re.compile(rb"(?:R(?:E|C(?:vV|itTI)?c)*r)+")
UNPLAIN = r"[&<>\x00-\x08\x0b\x0c\r\x0e-\x1f\x{FFFE}\x{FFFF}]|_x[0-9A-Fa-f]{4}_"      # texts that ``encoded`` changes


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]+:/", path):
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def workbooks(path: str) -> list[str]:
    """The .xlsx file, or those of a folder."""
    where, at = file_system(path)
    info = where.get_file_info(at)
    if info.type == arrow_fs.FileType.File:
        return [at]
    if info.type == arrow_fs.FileType.NotFound:
        return []
    found = where.get_file_info(arrow_fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == arrow_fs.FileType.File and f.path.endswith(".xlsx")
                  and not f.base_name.startswith((".", "_", "~")))


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def last_row(data: bytes) -> re.Match | None:
    """The last start tag of a row in ``data``."""
    at = len(data)
    while (at := data.rfind(b"row", 0, at)) >= 0:
        if m := ROW.match(data, max(0, data.rfind(b"<", 0, at))):
            return m
    return None


def closing(head: bytes) -> bytes:
    """End tags of the sheet's rows and of the sheet, as ``head`` names them."""
    names = SHEET_DATA.search(head)[0], re.search(rb"<(?![?!])[^>]*>", head)[0]
    return b"".join(b"</" + re.match(rb"<([^\s/>]+)", n)[1] + b">" for n in names)


def decoded(text: str) -> str:
    return text if "_x" not in text else re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def encoded(text: str) -> str:
    """Control characters and what looks like their escape as ``_xHHHH_``."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub(r"[\x00-\x08\x0b\x0c\r\x0e-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text))


def column_of(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


class Workbook:
    """One open file: shared strings, date styles, and the first sheet's rows."""

    def __init__(self, path: str, at: str):
        self.zip = zipfile.ZipFile(file_system(path)[0].open_input_file(at))
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.epoch = EPOCH_1904 if any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter()) else EPOCH
        self.sheet = self._first_sheet(book)
        self.names = names

    @cached_property
    def strings(self) -> list[str]:
        return self._strings() if "xl/sharedStrings.xml" in self.names else []

    @cached_property
    def dates(self) -> set[int]:
        return self._date_styles() if "xl/styles.xml" in self.names else set()

    def _first_sheet(self, book) -> str:
        first = next(e for e in book.iter() if local(e.tag) == "sheet")
        ref = next(v for k, v in first.attrib.items() if local(k) == "id")
        rels = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = next(e.get("Target") for e in rels if e.get("Id") == ref)
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _strings(self) -> list[str]:
        out = []
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if local(e.tag) == "si":
                    out.append(text_of(e))
                    e.clear()
        return out

    def _date_styles(self) -> set[int]:
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(e.get("numFmtId")) for e in root.iter() if local(e.tag) == "numFmt"
               and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|General', "", e.get("formatCode", "")), re.I)}
        xfs = next((e for e in root if local(e.tag) == "cellXfs"), [])
        return {i for i, x in enumerate(xfs) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def head(self, f) -> tuple[bytes, bytes]:
        """The sheet up to its rows, and the beginning of those."""
        data = b""
        while not (m := SHEET_DATA.search(data)) and (more := f.read(min(CHUNK, max(1 << 13, len(data))))):
            data += more
        return (data[:m.end()], data[m.end():]) if m and not m[0].endswith(b"/>") else (data, b"")

    def stretch_before(self, row: int) -> int | None:
        """Where in the file the last stretch begins that starts at or before ``row`` and can be
        inflated on its own; None if the file's writer left no such marks or the sheet was changed."""
        info = self.zip.getinfo(self.sheet)
        extra = info.extra
        while len(extra) >= 4:
            kind, size = struct.unpack_from("<HH", extra)
            if kind == MARKS and size >= 8 and size % 8 == 0 and info.compress_type == zipfile.ZIP_DEFLATED:
                crc, packed, *marks = struct.unpack_from(f"<{size // 4}I", extra, 4)
                known = [k for k in range(0, len(marks), 2) if marks[k] <= row]
                if (crc, packed) != (info.CRC, info.compress_size) or not known:
                    return None
                self.zip.fp.seek(info.header_offset)
                name, own = struct.unpack_from("<HH", self.zip.fp.read(30), 26)
                return info.header_offset + 30 + name + own + marks[known[-1] + 1]
            extra = extra[4 + size:]
        return None

    def ranges(self, rows: int) -> list[tuple[int, int]]:
        """Row numbers [first, end) of the sheet's partitions, without the header's."""
        with self.zip.open(self.sheet) as f:
            head, start = self.head(f)
            while start and not ROW.search(start) and (more := f.read(CHUNK)):
                start += more
        size = re.search(rb'<(?:\w+:)?dimension[^>]*\bref="[A-Z]+\d+:[A-Z]+(\d+)"', head)
        first = ROW.search(start)
        if not size or not first or not first[1]:
            return [(0, sys.maxsize)]
        lo, hi = int(first[1]) + 1, int(size[1]) + 1
        cuts = [*range(lo, hi, rows)]
        return [*zip(cuts, [*cuts[1:], sys.maxsize], strict=True)] if cuts else [(lo, sys.maxsize)]

    def rows(self, first: int = 0, end: int = sys.maxsize) -> Iterator:
        """Row elements with a number in [first, end); rows without numbers all."""
        for stretch in self.stretches(first, end):
            for e in self.elements(stretch):
                if e.get("r") and int(e.get("r")) >= end:
                    return
                yield e

    def elements(self, stretch) -> list:
        if not isinstance(stretch, bytes):
            return [stretch]
        return [e for e in ElementTree.fromstring(self.top + stretch + self.close)[-1] if local(e.tag) == "row"]

    def stretches(self, first: int = 0, end: int = sys.maxsize) -> Iterator:
        """Rows with a number in [first, end) as stretches of whole rows, unparsed; from a comment
        or CDATA on as elements, each cleared after its turn."""
        with self.zip.open(self.sheet) as f:
            head, data = self.head(f)
            if not SHEET_DATA.search(head) or SHEET_DATA.search(head)[0].endswith(b"/>"):
                return
            if first and (at := self.stretch_before(first)) is not None:
                f, data = Inflated(self.zip.fp, at), b""
            while first:                                     # pass over earlier rows unparsed
                last = last_row(data)
                if last and (last[1] is None or int(last[1]) >= first):
                    data = data[next(r.start() for r in ROW.finditer(data) if r[1] is None or int(r[1]) >= first):]
                    break
                more = f.read(CHUNK)
                if not more:
                    return
                data = data[last.start() if last else 0:] + more
            self.top, self.close = head, closing(head)
            while b"<!" not in data:                         # whole rows; comments and CDATA are left to the parser below
                over = SHEET_END.search(data) if b"sheetData" in data else None
                last = None if over else last_row(data)
                cut = over.start() if over else last.start() if last else 0
                ends = over or (last and last[1] and int(last[1]) >= end)
                if ends and end < sys.maxsize:
                    beyond = next((r.start() for r in ROW.finditer(data, 0, cut) if r[1] and int(r[1]) >= end), cut)
                    cut = min(cut, beyond)
                if cut:
                    yield data[:cut]
                if ends:
                    return
                data = data[cut:]
                more = f.read(max(CHUNK, len(data)))
                if not more:
                    break
                data += more
            parser = ElementTree.XMLPullParser(["start", "end"])
            parser.feed(head)
            held = None
            while data:
                parser.feed(data)
                for event, e in parser.read_events():
                    name = local(e.tag)
                    if event == "start" and name == "sheetData":
                        held = e
                    elif event == "end" and name == "row":
                        yield e
                        held.clear()
                    elif event == "end" and name == "sheetData":
                        return
                data = f.read(CHUNK)

    def cells(self, row, wanted: dict[int, int] | None = None) -> Iterator[tuple[int, object]]:
        """(column, value) of a row: text, float text as ``Number``, datetime or bool."""
        at = -1
        for c in row:
            ref = c.get("r")
            at = column_of(ref) if ref else at + 1
            if wanted is not None and at not in wanted:
                continue
            kind, v = c.get("t", "n"), None
            for x in c:
                if local(x.tag) == "v":
                    v = x.text
                    break
            if kind == "inlineStr":
                yield at, "".join(text_of(x) for x in c if local(x.tag) == "is")
            elif v is None or kind == "e":
                continue
            elif kind == "s":
                yield at, self.strings[int(v)]
            elif kind == "b":
                yield at, v.strip() in ("1", "true")
            elif kind in ("str", "d"):
                yield at, decoded(v)
            elif int(c.get("s", 0)) in self.dates:
                yield at, instant(float(v), self.epoch)
            else:
                yield at, Number(v.strip())


    def columns(self, stretch, end: int, wanted: dict[int, int], n_columns: int) -> list[pa.Array] | None:
        """The wanted columns of whole rows as text, without an object per cell; None unless the rows
        are plain: ASCII without references, escapes, control characters and ``>`` in texts, rows with
        and cells without own numbers, no shared strings."""
        if not isinstance(stretch, bytes) or not stretch.isascii() or b"&" in stretch or b"_x" in stretch:
            return None
        a = np.frombuffer(stretch, np.uint8)
        opens, closes = np.flatnonzero(a == ord("<")), np.flatnonzero(a == ord(">"))
        n = len(opens)
        if not n or n != len(closes) or opens[0] or a.min() < 32 or (closes < opens).any() or (opens[1:] < closes[:-1]).any():
            return None
        bounds = np.empty(2 * n + 1, np.int32)               # tag, text, tag, text ...
        bounds[0:-1:2], bounds[1::2], bounds[-1] = opens, closes + 1, len(stretch)
        pieces = pa.Array.from_buffers(pa.string(), 2 * n, [None, pa.py_buffer(bounds), pa.py_buffer(stretch)])
        tags = pieces.take(pa.array(np.arange(0, 2 * n, 2)))
        is_row = pc.starts_with(tags, "<row")
        own = tags.filter(is_row)
        if not pc.all(pc.match_substring_regex(own, PLAIN_ROW)).as_py():
            return None
        if pc.max(pc.cast(pc.replace_substring_regex(own, r'^<row r="([0-9]+)".*$', r"\1"), pa.int64())).as_py() >= end:
            return None
        coded = pc.if_else(is_row, "<row>", tags).dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        cell_tags = [None if t in TAGS else PLAIN_CELL.fullmatch(t) for t in names]
        letters_of = [TAGS.get(t) or (m and ("E" if m["empty"] else "C")) for t, m in zip(names, cell_tags, strict=True)]
        if not all(letters_of) or any(m and m["t"] == "s" for m in cell_tags):
            return None
        letter = np.array([ord(x) for x in letters_of], np.uint8)[codes]
        n_rows, width = len(own), int(np.argmax(letter == ord("r"))) + 1
        alike = n == n_rows * width and bool((letter.reshape(n_rows, width) == letter[:width]).all())
        if not PLAIN_ROWS.fullmatch(letter[:width if alike else n].tobytes()):
            return None
        padded = b"> " in stretch or b" <" in stretch
        empty = bool((bounds[2::2] == bounds[1::2])[letter == ord("v")].any())
        cell = np.flatnonzero((letter == ord("C")) | (letter == ord("E")))
        row = np.cumsum(letter == ord("R"))[cell] - 1
        column = np.arange(len(cell)) - np.searchsorted(row, np.arange(n_rows))[row]
        out = [pa.nulls(n_rows, pa.string())] * n_columns
        for at, k in wanted.items():
            here = column == at
            tag, to = cell[here], row[here]
            inner = letter[tag + 1]
            parts, place, held = [], np.full(n_rows, -1), 0
            kinds = codes[tag]
            for code in np.flatnonzero(np.bincount(kinds, minlength=1)):
                kind, style = cell_tags[code]["t"] or "n", int(cell_tags[code]["s"] or 0)
                if kind == "e":
                    continue
                if kind == "inlineStr":                       # without a text: the empty one
                    mine = kinds == code
                    values = pc.fill_null(pieces.take(pa.array(2 * tag[mine] + 5, mask=inner[mine] != ord("i"))), "")
                else:
                    mine = (kinds == code) & (inner == ord("v"))
                    values = pieces.take(pa.array(2 * tag[mine] + 3))
                    if empty:
                        values = pc.if_else(pc.equal(values, ""), None, values)
                    if kind == "b":
                        values = pc.cast(pc.is_in(pc.ascii_trim(values, " "), pa.array(["1", "true"])), pa.string()) if not values.null_count else None
                    elif kind not in ("str", "d"):
                        if style in self.dates:
                            values = instants(values, self.epoch)
                        elif padded:
                            values = pc.ascii_trim(values, " ")
                    if values is None:
                        return None
                place[to[mine]] = held + np.arange(len(values))
                held += len(values)
                parts.append(values)
            if len(parts) == 1 and held == n_rows:            # in order, one a row
                out[k] = parts[0]
            elif parts:
                out[k] = pa.concat_arrays(parts).take(pa.array(place, mask=place < 0))
        return out


class Inflated:
    """A deflated stretch of a file and what follows it, from its beginning."""

    def __init__(self, f, at: int):
        self.f, self.at, self.unpack = f, at, zlib.decompressobj(-zlib.MAX_WBITS)

    def read(self, n: int) -> bytes:
        out, size = [], 0
        while size < n and not self.unpack.eof:
            packed = self.unpack.unconsumed_tail
            if not packed:
                self.f.seek(self.at)
                packed = self.f.read(1 << 15)
                self.at += len(packed)
            out.append(self.unpack.decompress(packed, n - size))
            size += len(out[-1])
            if not packed:
                break
        return b"".join(out)


class Number(str):
    """A number as the file writes it."""


def text_of(e) -> str:
    """Text of a string item; runs joined, phonetic hints left out."""
    own = "".join(x.text or "" for x in e if local(x.tag) == "t")
    return decoded(own + "".join(text_of(x) for x in e if local(x.tag) == "r"))


def instant(serial: float, epoch: dt.datetime = EPOCH) -> dt.datetime | None:
    if epoch is EPOCH and int(serial) == 60:
        return None
    try:
        return epoch + dt.timedelta(milliseconds=round(serial * 86_400_000))
    except OverflowError:
        return None


def instants(serials: pa.Array, epoch: dt.datetime) -> pa.Array | None:
    """Text of ``instant`` for day numbers as text; None where a number is far from usual dates."""
    try:
        days = pc.cast(serials, pa.float64())
    except pa.ArrowInvalid:
        return None
    x = pc.fill_null(days, 1.0).to_numpy(zero_copy_only=False)
    if not ((x >= 1) & (x < 2_900_000)).all():
        return None
    ms = np.rint(x * 86_400_000).astype(np.int64) + (epoch - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)
    none = pc.is_null(days).to_numpy(zero_copy_only=False) | ((x >= 60) & (x < 61) if epoch is EPOCH else False)
    whole = ms % 1000 == 0
    text = pc.cast(pa.array(ms // 1000, pa.timestamp("s"), mask=none), pa.string())
    if whole.all():
        return text
    return pc.if_else(pa.array(whole), text, pc.cast(pa.array(ms * 1000, pa.timestamp("us"), mask=none), pa.string()))


def as_text(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    return v.isoformat(" ", "auto") if isinstance(v, dt.datetime) else str(v)


def number(v) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def moment(v) -> dt.datetime | None:
    if isinstance(v, dt.datetime):
        return v
    if isinstance(v, Number):
        return instant(float(v))
    try:
        return dt.datetime.fromisoformat(str(v).strip())
    except ValueError:
        return None


def converter(kind: T.DataType):
    if isinstance(kind, T.StringType):
        return as_text
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType)):
        return lambda v: int(x) if (x := number(v)) is not None and math.isfinite(x) and x == int(x) else None
    if isinstance(kind, T.BooleanType):
        return lambda v: v if isinstance(v, bool) else None
    if isinstance(kind, T.DateType):
        return lambda v: m.date() if (m := moment(v)) else None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return moment
    raise ValueError(f"no spreadsheet cell holds {kind.simpleString()}")


class Range(InputPartition):
    """Row ranges, each of one file."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def shared(ranges: list[tuple[str, int, int]]) -> list[Range]:
    """A partition per range, or, as a task costs as much as thousands of rows, about ``TASKS``
    partitions of several. Rows are read as a stream, so a task does not grow in memory; of ranges
    that follow one another in a file one is made."""
    size = -(-len(ranges) // TASKS)
    out = []
    for at in range(0, len(ranges), max(size, 1)):
        joined: list[tuple[str, int, int]] = []
        for path, first, end in ranges[at:at + size]:
            if joined and joined[-1][0] == path and joined[-1][2] == first:
                joined[-1] = (path, joined[-1][1], end)
            else:
                joined.append((path, first, end))
        out.append(Range(joined))
    return out


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, rows: int):
        self.path, self.schema, self.size = path, schema, rows

    def partitions(self) -> list[Range]:
        return shared([(at, *r) for at in workbooks(self.path) for r in Workbook(self.path, at).ranges(self.size)])

    def read(self, partition: Range) -> Iterator:
        text = all(isinstance(f.dataType, T.StringType) for f in self.schema)
        for at, first, end in partition.ranges:
            book = Workbook(self.path, at)
            yield from self.batches(book, first, end) if text else self.tuples(book, first, end)

    def places(self, book: Workbook) -> dict[str, int]:
        """Where the wanted columns are; of equal names the first counts."""
        header = header_of(book)
        return {c: i for i, c in reversed(list(enumerate(header))) if c in self.schema.names}

    def tuples(self, book: Workbook, first: int, end: int) -> Iterator[tuple]:
        place = self.places(book)
        wanted = {place[f.name]: k for k, f in enumerate(self.schema) if f.name in place}
        convert = {place[f.name]: converter(f.dataType) for f in self.schema if f.name in place}
        rows = book.rows(first, end)
        if not first:
            next(rows, None)                                  # the header
        for row in rows:
            out = [None] * len(self.schema)
            for at, v in book.cells(row, wanted):
                out[wanted[at]] = convert[at](v) if v is not None else None
            yield tuple(out)

    def batches(self, book: Workbook, first: int, end: int) -> Iterator[pa.RecordBatch]:
        """Rows as Arrow batches of text; rows that are not plain are parsed one by one."""
        names, kinds = self.schema.names, pa.schema([(n, pa.string()) for n in self.schema.names])
        place = self.places(book)
        wanted = {place[n]: k for k, n in enumerate(names) if n in place}
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=kinds)
                held.clear()

        header = not first                                    # comes first then
        for stretch in book.stretches(first, end):
            if not header and (columns := book.columns(stretch, end, wanted, len(names))) is not None:
                yield from flush()
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)
                continue
            for e in book.elements(stretch):
                if e.get("r") and int(e.get("r")) >= end:
                    yield from flush()
                    return
                if header:
                    header = False
                    continue
                out = [None] * len(names)
                for at, v in book.cells(e, wanted):
                    out[wanted[at]] = as_text(v) if v is not None else None
                held.append(tuple(out))
                if len(held) == STRETCH:
                    yield from flush()
        yield from flush()


def header_of(book: Workbook) -> list[str]:
    row = next(book.rows(), None)
    names = dict(book.cells(row)) if row is not None else {}
    return [as_text(names[i]) if names.get(i) is not None else f"_{i}" for i in range(max(names, default=-1) + 1)]


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class Writer(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, rows: int, overwrite: bool):
        self.path, self.schema, self.rows, self.replaced = path, schema, rows, workbooks(path) if overwrite else []

    def write(self, iterator: Iterator) -> Written:
        files, held = [], []
        for row in iterator:
            held.append(tuple(row))
            if len(held) == self.rows:
                files.append(self.put(len(held), row_stretches(held)))
                held.clear()
        if held or not files:
            files.append(self.put(len(held), row_stretches(held)))
        return Written(files)

    def put(self, n: int, stretches: Iterable[tuple[int, bytes]]) -> str:
        """A file of ``n`` rows; its name."""
        where, at = file_system(self.path)
        where.create_dir(at, recursive=True)
        name = f"{at.rstrip('/')}/part-{uuid.uuid4().hex}.xlsx"
        with where.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            save(z, self.schema.names, n, stretches)
        return name

    def commit(self, messages: list) -> None:
        where, _ = file_system(self.path)
        for old in self.replaced:
            where.delete_file(old)

    def abort(self, messages: list) -> None:
        where, _ = file_system(self.path)
        for m in messages:
            for f in m.files if m else []:
                where.delete_file(f)


class BatchWriter(Writer, DataSourceArrowWriter):
    """Arrow batches written column by column, without an object per cell."""

    KINDS = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.TimestampNTZType)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, held, n = [], [], 0
        for batch in iterator:
            while batch.num_rows:
                held.append(batch.slice(0, self.rows - n))
                n, batch = n + held[-1].num_rows, batch.slice(held[-1].num_rows)
                if n == self.rows:
                    files.append(self.put(n, batch_stretches(held)))
                    held, n = [], 0
        if n or not files:
            files.append(self.put(n, batch_stretches(held)))
        return Written(files)


def row_stretches(rows: list[tuple]) -> Iterator[tuple[int, bytes]]:
    """(number of the first row, XML) of stretches of rows; the header is row 1."""
    for at in range(0, len(rows), STRETCH):
        yield at + 2, "".join(f'<row r="{r}">{"".join(map(cell, row))}</row>' for r, row in enumerate(rows[at:at + STRETCH], at + 2)).encode("utf-8", "replace")


def batch_stretches(batches: list[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    r = 2
    for batch in batches:
        numbers = pc.cast(pa.array(np.arange(r, r + batch.num_rows)), pa.string())
        cells = [numbers, *map(cells_of, batch.columns)]
        for at in range(0, batch.num_rows, STRETCH):
            number, *own = (c.slice(at, STRETCH) for c in cells)
            rows = pc.binary_join_element_wise('<row r="', number, '">', *own, "</row>", "")
            yield r + at, "".join(rows.to_pylist()).encode()
        r += batch.num_rows


def cells_of(column: pa.Array) -> pa.Array:
    """``cell`` of every value."""
    kind, around, text = column.type, ("<c><v>", "</v></c>"), None
    if pa.types.is_boolean(kind):
        around, text = ('<c t="b"><v>', "</v></c>"), pc.if_else(column, "1", "0")
    elif pa.types.is_integer(kind):
        text = pc.cast(column, pa.string())
    elif pa.types.is_floating(kind):
        text = decimals(pc.cast(column, pa.float64()))
    elif pa.types.is_string(kind) or pa.types.is_large_string(kind):
        around = ('<c t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>")
        text = None if pc.any(pc.match_substring_regex(column, UNPLAIN)).as_py() else pc.cast(column, pa.string())
    elif pa.types.is_date32(kind) or (pa.types.is_timestamp(kind) and kind.unit == "us" and kind.tz is None):
        around, day = ('<c s="1"><v>', "</v></c>"), 1 if pa.types.is_date32(kind) else 86_400_000_000
        since = pc.add(pc.cast(pc.cast(column, pa.int32()) if day == 1 else column, pa.int64()), (dt.datetime(1970, 1, 1) - EPOCH).days * day)
        if not pc.any(pc.greater_equal(pc.abs(since), 1 << 53)).as_py():
            text = decimals(pc.divide(pc.cast(since, pa.float64()), float(day)))
    if text is None:
        return pa.array([cell(v) for v in column.to_pylist()], pa.string())
    return pc.fill_null(pc.binary_join_element_wise(around[0], text, around[1], ""), "<c/>")


def decimals(numbers: pa.Array) -> pa.Array | None:
    """``repr`` of floats; None if one is not finite or its text has an exponent."""
    size = np.abs(pc.fill_null(numbers, 0.0).to_numpy(zero_copy_only=False))
    if not (((size >= 1e-4) & (size < 1e10)) | (size == 0)).all():
        return None
    text = pc.cast(numbers, pa.string())
    return pc.if_else(pc.match_substring(text, "."), text, pc.binary_join_element_wise(text, ".0", ""))


def cell(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int):
        return f"<c><v>{v}</v></c>"
    if isinstance(v, float) and math.isfinite(v):
        return f"<c><v>{v!r}</v></c>"
    if isinstance(v, dt.date):
        v = v if isinstance(v, dt.datetime) else dt.datetime.combine(v, dt.time())
        return f'<c s="1"><v>{(v.replace(tzinfo=None) - EPOCH) / dt.timedelta(days=1)!r}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{encoded(str(v))}</t></is></c>'


def save(z: zipfile.ZipFile, names: list[str], n: int, stretches: Iterable[tuple[int, bytes]]) -> None:
    """A workbook of one sheet: header, then ``n`` rows."""
    kind, main = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    package = "http://schemas.openxmlformats.org/package/2006"
    part = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
               f'<Override PartName="/xl/workbook.xml" ContentType="{part}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{part}.styles+xml"/>'
               f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{part}.worksheet+xml"/></Types>')
    z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{kind}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
    z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kind}/worksheet" Target="worksheets/sheet1.xml"/>'
               f'<Relationship Id="rId2" Type="{kind}/styles" Target="styles.xml"/></Relationships>')
    z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd\\ hh:mm:ss"/></numFmts><fonts count="1"><font/></fonts>'
               '<fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
               '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>')
    top = (f'<worksheet xmlns="{main}"><dimension ref="A1:{letters(max(len(names), 1))}{n + 1}"/><sheetData>'
           f'<row r="1">{"".join(map(cell, names))}</row>').encode("utf-8", "replace")
    put_sheet(z, "xl/worksheets/sheet1.xml", top, stretches, b"</sheetData></worksheet>")


def put_sheet(z: zipfile.ZipFile, name: str, top: bytes, stretches: Iterable[tuple[int, bytes]], bottom: bytes) -> None:
    """A deflated entry whose stretches can be inflated on their own, with marks of where they begin."""
    pack = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -zlib.MAX_WBITS)
    info = zipfile.ZipInfo(name, time.localtime()[:6])
    out, marks = bytearray(pack.compress(top)), []
    crc, size = zlib.crc32(top), len(top) + len(bottom)
    for row, data in stretches:
        out += pack.flush(zlib.Z_FULL_FLUSH)
        marks.append((row, len(out)))
        out += pack.compress(data)
        crc, size = zlib.crc32(data, crc), size + len(data)
    out += pack.compress(bottom) + pack.flush()
    info.CRC, info.file_size, info.compress_size, info.compress_type = zlib.crc32(bottom, crc), size, len(out), zipfile.ZIP_DEFLATED
    info.external_attr = 0o600 << 16
    if marks and len(out) < 1 << 32:
        kept = [x for m in marks[::-(-len(marks) // MOST_MARKS)] for x in m]
        info.extra = struct.pack(f"<HHII{len(kept)}I", MARKS, 8 + 4 * len(kept), info.CRC, len(out), *kept)
    info.header_offset = z.fp.tell()
    z.fp.write(info.FileHeader())
    z.fp.write(out)
    z.filelist.append(info)
    z.NameToInfo[name] = info
    z.start_dir = z.fp.tell()


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _path(self) -> str:
        return self.options.get("path", "")

    def _rows(self) -> int:
        return int(self.options.get("rows", ROWS))

    def schema(self) -> T.StructType:
        files = workbooks(self._path())
        if not files:
            raise FileNotFoundError(f"no .xlsx file at {self._path()}")
        names = list(dict.fromkeys(header_of(Workbook(self._path(), files[0]))))
        if "columns" in self.options:
            keep = [c.strip() for c in self.options["columns"].split(",")]
            names = [c for c in names if c in keep]
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self._path(), schema, self._rows())

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        kind = BatchWriter if all(isinstance(f.dataType, BatchWriter.KINDS) for f in schema) else Writer
        return kind(self._path(), schema, self._rows(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)
