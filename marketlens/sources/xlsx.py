"""Spreadsheets as a data source: spark.read.format("xlsx") and df.write.format("xlsx")."""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from io import BytesIO
from itertools import islice
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

# The parts of a workbook and their namespaces.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PARTS = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: The place of a row in its file, and the file, beside the sheet's own columns.
PLACE = (StructField("_file", StringType()), StructField("_row", LongType()))
#: A sheet has at most so many rows, by its format.
MOST_ROWS = 1_048_576
#: Rows go to Spark in batches of so many.
BATCH_ROWS = 4096
_ROW, _CELL, _VALUE, _INLINE, _TEXT, _RUN = (f"{{{_MAIN}}}{tag}" for tag in ("row", "c", "v", "is", "t", "r"))


def _fs(path: str) -> tuple[Any, str]:
    """The file system of a path, local or by its scheme."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The workbooks of a folder, or the one file, with the scheme that the path has."""
    fs, inner = _fs(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type != pafs.FileType.Directory:
        return [path]
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(inner)) if f.base_name.lower().endswith(".xlsx") and not f.base_name.startswith((".", "_", "~"))]
    return sorted(f"{path.rstrip('/')}/{f.rsplit('/', 1)[-1]}" for f in found)


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference.upper()).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic ones."""
    if len(node) == 1 and node[0].tag == _TEXT and not len(node[0]):
        return node[0].text or ""
    runs = [t for child in node if child.tag in (_TEXT, _RUN) for t in child.iter(_TEXT)]
    return "".join(t.text or "" for t in runs)


def _number(text: str) -> str:
    try:
        x = float(text)
    except ValueError:
        return text
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _sheet_name(book: zipfile.ZipFile) -> str:
    """The part of the first sheet, as the workbook lists them."""
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{{{_MAIN}}}sheets/{{{_MAIN}}}sheet")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[sheet.get(f"{{{_OFFICE}}}id")]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def cells(data: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet as texts, one at a time; cells that are left out are empty, rows that are left out or empty are passed over."""
    with zipfile.ZipFile(BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{{{_MAIN}}}si")]
        with book.open(_sheet_name(book)) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != _ROW:
                    continue
                out: list[str] = []
                for cell in row.iter(_CELL):
                    reference, kind = cell.get("r"), cell.get("t", "n")
                    at = _column(reference) if reference else len(out)
                    if kind == "inlineStr":
                        inline = cell.find(_INLINE)
                        text = _text(inline) if inline is not None else ""
                    elif (value := cell.findtext(_VALUE)) is None or kind == "e":
                        text = ""
                    else:
                        text = shared[int(value)] if kind == "s" else {"0": "FALSE", "1": "TRUE"}.get(value, value) if kind == "b" else value if kind == "str" else _number(value)
                    if at > len(out):
                        out += [""] * (at - len(out))
                    out.append(text)
                row.clear()
                if any(out):
                    yield out


def header(data: bytes) -> list[str]:
    """Column names: the first row, repeated ones with a number, empty ones by their place."""
    names: list[str] = []
    for i, name in enumerate(next(cells(data), [])):
        name = name or f"_c{i}"
        k, new = 1, name
        while new.lower() in {n.lower() for n in names}:
            new, k = f"{name}_{k}", k + 1
        names.append(new)
    return names


def _read(path: str) -> bytes:
    fs, inner = _fs(path)
    with fs.open_input_stream(inner) as f:
        return f.read()


class _Reader(DataSourceReader):
    """A partition for each workbook, which an upload's limit keeps small."""

    def __init__(self, path: str, names: Sequence[str]) -> None:
        self.path, self.names = path, list(names)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        data = _read(partition.value)
        place = {n: i for i, n in enumerate(header(data))}
        at = [place.get(n) for n in self.names]
        rows = cells(data)
        next(rows, None)
        name = partition.value.rsplit("/", 1)[-1]
        columns, k = [f.name for f in PLACE] + self.names, 0
        while some := list(islice(rows, BATCH_ROWS)):
            texts = [[row[i] if i is not None and i < len(row) else "" for row in some] for i in at]
            place_of = [pa.array([name] * len(some), pa.string()), pa.array(range(k, k + len(some)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*place_of, *[pa.array(t, pa.string()) for t in texts]], columns)
            k += len(some)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Books:
    """A workbook for each partition, under a name of its own, in a folder of the run until all are there; tasks that didn't count leave none.

    The folder is made before the tasks start and taken away with the run, so that a task which is still at work then has no place to write to.
    """

    def __init__(self, path: str, names: Sequence[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite, self.run = path, list(names), overwrite, uuid.uuid4().hex
        fs, inner = _fs(path)
        fs.create_dir(f"{inner}/_{self.run}", recursive=True)

    def _save(self, rows: Iterable[tuple[int, bytes]]) -> _Written:
        """A workbook of rows as XML, each part of them with the number of its last row."""
        fs, inner = _fs(self.path)
        name = f"part-{self.run}-{uuid.uuid4().hex}.xlsx"
        out = BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for part, text in _PARTS.items():
                book.writestr(part, text)
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                sheet.write(_row(0, self.names))
                for k, xml in rows:
                    if k >= MOST_ROWS:
                        raise ValueError(f"a sheet has at most {MOST_ROWS} rows; write more partitions")
                    sheet.write(xml)
                sheet.write(b"</sheetData></worksheet>")
        with fs.open_output_stream(f"{inner}/_{self.run}/{name}") as f:
            f.write(out.getbuffer())
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, inner = _fs(self.path)
        names = {m.path for m in messages if isinstance(m, _Written)}
        for name in names:
            fs.move(f"{inner}/_{self.run}/{name}", f"{inner}/{name}")
        fs.delete_dir(f"{inner}/_{self.run}")
        for f in fs.get_file_info(pafs.FileSelector(inner)) if self.overwrite else []:
            if f.type == pafs.FileType.File and f.base_name not in names and f.base_name.endswith(".xlsx"):
                fs.delete_file(f.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, inner = _fs(self.path)
        if fs.get_file_info(f"{inner}/_{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{inner}/_{self.run}")


class _Writer(_Books, DataSourceWriter):
    def write(self, iterator: Iterator[Any]) -> _Written:
        return self._save((k, _row(k, row)) for k, row in enumerate(iterator, 1))


class _TextWriter(_Books, DataSourceArrowWriter):
    """The same workbooks where all columns are text, a batch at a time."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return self._save(_text_rows(iterator))


_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _row(k: int, values: Sequence[Any]) -> bytes:
    out = [f'<row r="{k + 1}">']
    for v in values:
        if v is None:
            out.append("<c/>")
        elif isinstance(v, bool):
            out.append(f'<c t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, (int, float)):
            out.append(f"<c><v>{v!r}</v></c>")
        else:
            out.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", str(v)))}</t></is></c>')
    return ("".join(out) + "</row>").encode()


def _joined(*parts: str | pa.Array) -> pa.Array:
    """Texts one behind the other, null where one is null."""
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in [*parts, ""]])


def _text_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """What _row gives for each row, joined by batch, with the number of the last one."""
    k = 0
    for whole in batches:
        for start in range(0, len(whole), BATCH_ROWS):
            batch = whole.slice(start, BATCH_ROWS)
            written = []
            for column in batch.columns:
                text = pc.replace_substring_regex(column.cast(pa.large_string()), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]", "")
                for plain, safe in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
                    text = pc.replace_substring(text, plain, safe)
                written.append(pc.fill_null(_joined('<c t="inlineStr"><is><t xml:space="preserve">', text, "</t></is></c>"), "<c/>"))
            number = pa.array(range(k + 2, k + len(batch) + 2), pa.int64()).cast(pa.large_string())
            k += len(batch)
            yield k, "".join(_joined('<row r="', number, '">', *written, "</row>").to_pylist()).encode()


class XlsxSource(DataSource):
    """The first sheet of each workbook under `path`: the header's columns as text, empty where a cell is, with file and row. Writing takes any flat columns."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        found = files(self.options["path"])
        return StructType([*PLACE, *[StructField(n, StringType()) for n in (header(_read(found[0])) if found else [])]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], [f.name for f in schema.fields[len(PLACE) :]])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        kind = _TextWriter if all(isinstance(f.dataType, StringType) for f in schema.fields) else _Writer
        return kind(self.options["path"], [f.name for f in schema.fields], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)
