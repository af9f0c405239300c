"""Python data sources: rows of XLSX sheets, and members of ZIP archives."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Namespaces of the sheet format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class _Files(DataSourceReader):
    """One partition a file."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        from glob import glob

        return [InputPartition(p) for p in sorted(glob(self.options["path"]))] or [InputPartition(None)]


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, row number, column letters -> text) of one sheet or of all."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for entry in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            name = entry.get("name")
            if sheet not in (None, name):
                continue
            place = targets[entry.get(f"{_REL}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(place if place.startswith("xl/") else f"xl/{place}"))
            for row in root.iter(f"{_MAIN}row"):
                cells = {}
                for cell in row.iter(f"{_MAIN}c"):
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        content = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        content = shared[int(value.text)] if kind == "s" else value.text
                    cells[re.match("[A-Z]+", cell.get("r"))[0]] = content
                yield name, int(row.get("r")), cells


class XlsxRows(DataSource):
    """spark.read.format("xlsx_rows").option("sheet", name).load(pattern)"""

    @classmethod
    def name(cls) -> str:
        return "xlsx_rows"

    def schema(self) -> str:
        return "path string, sheet string, row int, cells map<string, string>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _XlsxReader(self.options)


class _XlsxReader(_Files):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            for name, row, cells in sheet_rows(partition.value, self.options.get("sheet")):
                yield partition.value, name, row, cells


class ZipMembers(DataSource):
    """spark.read.format("zip_members").option("content", "true").load(pattern): the directory of each archive, with the
    members' bytes on request. partial marks unfinished downloads."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "path string, member string, size_bytes bigint, crc32 bigint, partial boolean, content binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _ZipReader(self.options)


class _ZipReader(_Files):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            wanted = self.options.get("content", "false").lower() == "true"
            with zipfile.ZipFile(partition.value) as z:
                for info in sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename):
                    part = info.filename.endswith(".drivedownload")
                    yield partition.value, info.filename, info.file_size, info.CRC, part, z.read(info) if wanted and not part else None


def register(spark: SparkSession) -> None:
    for source in (XlsxRows, ZipMembers):
        spark.dataSource.register(source)
