"""Workbooks (xlsx) as a data source: one partition for each file when reading, one file for each task when writing.

    spark.dataSource.register(Workbooks)
    df.write.format("workbook").mode("append").save(folder)
    spark.read.format("workbook").load(folder)

Reading gives cells: ``file, sheet, row, col, value, truncated``, from streamed XML, so that a sheet of any length is read in constant memory; what a file
holds in memory are its shared strings. With the option ``maxRows`` a sheet's further rows are left out, and its last cell says so in
``truncated``. Writing streams rows into inline strings; a sheet that is full (1,048,576 rows) goes on in the next one. Tasks write into a
staging folder; ``commit`` moves the files of tasks that succeeded, ``abort`` leaves nothing, and a task that runs twice leaves its file once.

Null values are empty cells and come back as none; empty strings are cells. Characters that XML can't hold are left out. A folder without
workbooks has no rows. The folder has to be one that pyarrow can open on all executors (``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a sheet, by the format.
FULL = 1_048_576
CELLS = "file string, sheet string, row int, col int, value string, truncated boolean"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: What XML 1.0 can't hold.
FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def file_system(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def column_number(reference: str) -> int:
    """0 for A1, 27 for AB7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """The runs of a string, without phonetic notes."""
    return "".join(t.text or "" for run in (node, *node.findall(f"{MAIN}r")) for t in run.findall(f"{MAIN}t"))


def read_cells(file: object, most: int | None = None) -> Iterator[tuple[str, int, int, str, bool]]:
    """``sheet, row, col, value, truncated`` of a workbook, sheet by sheet; rows and columns count from 0."""
    with zipfile.ZipFile(file) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as xml:
                for _, node in ElementTree.iterparse(xml):
                    if node.tag == f"{MAIN}si":
                        shared.append(_text(node))
                        node.clear()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets[sheet.get(RELATION)].lstrip("/")
            before, rows, cut = None, 0, False
            with book.open(target if target.startswith("xl/") else f"xl/{target}") as xml:
                at = -1
                for event, node in ElementTree.iterparse(xml, ("start", "end")):
                    if event == "start" and node.tag == f"{MAIN}row":
                        at = int(node.get("r", at + 2)) - 1
                        rows += 1
                        if most is not None and rows > most:
                            cut = True
                            break
                    elif event == "end" and node.tag == f"{MAIN}row":
                        for nth, cell in enumerate(node.findall(f"{MAIN}c")):
                            value = cell.find(f"{MAIN}v")
                            kind, inline = cell.get("t"), cell.find(f"{MAIN}is")
                            said = _text(inline) if inline is not None else None if value is None else shared[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[value.text] if kind == "b" else value.text or ""
                            if said is not None:
                                if before is not None:
                                    yield (*before, False)
                                before = sheet.get("name"), at, column_number(cell.get("r")) if cell.get("r") else nth, said
                        node.clear()
            if before is not None:
                yield (*before, cut)


class BookWriter:
    """A workbook that grows row by row, in constant memory."""

    RULES = (
        ("[Content_Types].xml", "<Types xmlns='http://schemas.openxmlformats.org/package/2006/content-types'><Default Extension='rels' ContentType='application/vnd.openxmlformats-package.relationships+xml'/><Default Extension='xml' ContentType='application/xml'/><Override PartName='/xl/workbook.xml' ContentType='application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml'/>{types}</Types>"),
        ("_rels/.rels", "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='rId1' Type='http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument' Target='xl/workbook.xml'/></Relationships>"),
        ("xl/workbook.xml", "<workbook xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'><sheets>{sheets}</sheets></workbook>"),
        ("xl/_rels/workbook.xml.rels", "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>{links}</Relationships>"),
    )

    def __init__(self, out: object, header: list[str], full: int = FULL):
        self.book, self.header, self.full, self.count = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), header, full, 0
        self.sheet, self.row = None, 0

    def _open(self) -> None:
        self._close()
        self.count += 1
        self.sheet, self.row = self.book.open(f"xl/worksheets/sheet{self.count}.xml", "w", force_zip64=True), 0
        self.sheet.write(b"<worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><sheetData>")
        self._line(self.header)

    def _close(self) -> None:
        if self.sheet is not None:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()

    def _line(self, values: list) -> None:
        self.row += 1
        cells = "".join(self._cell(n, v) for n, v in enumerate(values) if v is not None)
        self.sheet.write(f"<row r='{self.row}'>{cells}</row>".encode())

    def _cell(self, n: int, value: object) -> str:
        at, rest = "", n
        while rest >= 0:
            at, rest = chr(65 + rest % 26) + at, rest // 26 - 1
        if isinstance(value, bool):
            return f"<c r='{at}{self.row}' t='b'><v>{int(value)}</v></c>"
        if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
            return f"<c r='{at}{self.row}'><v>{value!r}</v></c>"
        said = FORBIDDEN.sub("", value.isoformat() if hasattr(value, "isoformat") else str(value))
        return f"<c r='{at}{self.row}' t='inlineStr'><is><t xml:space='preserve'>{escape(said)}</t></is></c>"

    def write(self, values: list) -> None:
        if self.sheet is None or self.row >= self.full:
            self._open()
        self._line(values)

    def close(self) -> None:
        if self.sheet is None:
            self._open()
        self._close()
        numbers = range(1, self.count + 1)
        filled = {
            "types": "".join(f"<Override PartName='/xl/worksheets/sheet{n}.xml' ContentType='application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml'/>" for n in numbers),
            "sheets": "".join(f"<sheet name={quoteattr(f'Sheet{n}')} sheetId='{n}' r:id='rId{n}'/>" for n in numbers),
            "links": "".join(f"<Relationship Id='rId{n}' Type='http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet' Target='worksheets/sheet{n}.xml'/>" for n in numbers),
        }
        for name, text in self.RULES:
            for key, value in filled.items():
                text = text.replace("{" + key + "}", value)
            self.book.writestr(name, "<?xml version='1.0' encoding='UTF-8'?>" + text)
        self.book.close()


class Workbooks(DataSource):
    """The source ``workbook``; options: ``path``, and ``maxRows`` of a sheet for reading."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, [f.name for f in schema.fields], overwrite)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options["maxRows"]) if "maxRows" in options else None

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".xlsx")] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as file:
            for sheet, row, col, value, truncated in read_cells(file, self.most):
                yield partition.path.rsplit("/", 1)[-1], sheet, row, col, value, truncated


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.run = options["path"], names, overwrite, uuid.uuid4().hex
        self.full = int(options.get("sheetRows", FULL))
        # made here once: a task that still runs when the others are aborted finds no folder to write to
        file_system(self.path)[0].create_dir(self._staging(), recursive=True)

    def _staging(self) -> str:
        return f"{file_system(self.path)[1].rstrip('/')}/_writing-{self.run}"

    def write(self, iterator: Iterator[Row]) -> _Written:
        from pyspark import TaskContext

        system, _ = file_system(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.run[:8]}.xlsx"
        rows = 0
        with system.open_output_stream(f"{self._staging()}/{name}") as out:
            book = BookWriter(_Stream(out), self.names, self.full)
            for row in iterator:
                book.write(list(row))
                rows += 1
            book.close()
        return _Written(name, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = file_system(self.path)
        if self.overwrite:
            for old in self._books(system, path):
                system.delete_file(old)
        for message in messages:
            if message is not None and message.rows:
                system.move(f"{self._staging()}/{message.name}", f"{path.rstrip('/')}/{message.name}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, _ = file_system(self.path)
        if system.get_file_info(self._staging()).type != fs.FileType.NotFound:
            system.delete_dir(self._staging())

    @staticmethod
    def _books(system: object, path: str) -> list[str]:
        from pyarrow import fs

        if system.get_file_info(path).type == fs.FileType.NotFound:
            return []
        return [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(".xlsx")]


class _Stream(io.RawIOBase):
    """An output stream that can't seek, as object stores have them; zip entries then carry their sizes behind."""

    def __init__(self, out: object):
        self.out = out

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data: bytes) -> int:
        self.out.write(bytes(data))
        return len(data)
