"""Resumable paged sources: a batch reader and a stream reader over numbered pages.

Pages are JSON lines in <folder>/<year>/<page>.jsonl, on any file system that pyarrow knows; a collector puts them there. Each
page is a task of its own. The stream's offset is, for each year, the last page up to which all pages are there: a page that
comes later than its successors holds its year back, so none is lost or read twice, and a restart goes on from there."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "year int, page int, record string"


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else Path(folder).absolute().as_uri())


def pages_of(folder: str) -> list[tuple[int, int, str]]:
    """(year, page, file), in order."""
    system, root = _system(folder)
    found = []
    for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = f.path.removeprefix(root).strip("/").split("/")
        if f.is_file and len(parts) == 2 and parts[0].isdigit() and parts[1].endswith(".jsonl") and parts[1][:-6].isdigit():
            found.append((int(parts[0]), int(parts[1][:-6]), f.path))
    return sorted(found)


def rows_of(folder: str, year: int, page: int, path: str) -> Iterator[tuple[int, int, str]]:
    """Lines that are JSON objects; others are left out."""
    with _system(folder)[0].open_input_stream(path) as f:
        for line in f.read().decode("utf-8").splitlines():  # a page is short
            try:
                if isinstance(json.loads(line), dict):
                    yield year, page, line.strip()
            except ValueError:
                continue


def reached(pages: list[tuple[int, int, str]]) -> dict[str, int]:
    """For each year the last page of the unbroken run from its first possible page, 0 or 1."""
    out: dict[str, int] = {}
    for year, page, _ in pages:
        last = out.get(str(year))
        if page == (0 if last is None else last + 1) or (last is None and page == 1):
            out[str(year)] = page
    return out


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(page) for page in pages_of(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is not None:  # as it is where there are no pages
            yield from rows_of(self.folder, *partition.value)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return reached(pages_of(self.folder))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((y, n, p)) for y, n, p in pages_of(self.folder) if start.get(str(y), -1) < n <= end.get(str(y), -1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is not None:  # as it is where there are no pages
            yield from rows_of(self.folder, *partition.value)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """spark.read.format("paged_records").load(folder), and readStream."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
