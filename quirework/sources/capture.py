"""A data source of captured pages: folders of HTML files, read, followed as a stream, and written.

    spark.dataSource.register(CaptureSource)
    spark.read.format("capture").load("/captures")
    pages.write.format("capture").mode("append").save("/captures")
    spark.readStream.format("capture").load("/captures")

Folders are such that driver and executors share. A file's name is its quoted address, with a number behind an `@` where one address was captured again. A task reads a group of files.
A write goes to a folder of its own, which readers pass over, and moves into place file by file when all tasks are done: what fails before leaves nothing behind, and
a page is never seen in part. A stream's offset is the place of the last file by time and name; files must not get times before those of files already seen.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote, unquote

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

_HIDDEN = ".writing-"


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


def _listed(path: str) -> list[tuple[int, str]]:
    """(time, path) of all files in the order of both."""
    found = (p for p in Path(path).rglob("*.html") if not any(part.startswith(_HIDDEN) for part in p.parts))
    return sorted((p.stat().st_mtime_ns, str(p)) for p in found)


def _groups(paths: list[str], size: int) -> list[Files]:
    return [Files(paths[i : i + size]) for i in range(0, len(paths), size)] or [Files([])]


def _pages(paths: list[str]) -> Iterator[tuple[str, str]]:
    for p in map(Path, paths):
        yield unquote(p.stem.split("@")[0]), p.read_text(errors="replace")


class CaptureSource(DataSource):
    """Rows (url, html) of the *.html files below a folder. The option files_per_task (1,000) says how many a task reads."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return "url string, html string"

    def _size(self) -> int:
        return int(self.options.get("files_per_task", "1000"))

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options["path"], self._size())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptureStream(self.options["path"], self._size())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("captures are only appended")
        return CaptureWriter(self.options["path"])


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Files]:
        return _groups([p for _, p in _listed(self.path)], self.size)

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        return _pages(partition.paths)


class CaptureStream(DataSourceStreamReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        time, path = max(_listed(self.path), default=(0, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return _groups([p for time, p in _listed(self.path) if low < (time, p) <= high], self.size)

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        return _pages(partition.paths)

    def commit(self, end: dict) -> None:
        """Nothing to let go: files stay."""


class CaptureWriter(DataSourceWriter):
    """Rows without an address are left out; a null page is an empty one."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.draft = f"{path}/{_HIDDEN}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = Path(self.draft, uuid.uuid4().hex)  # an attempt's own: what a failed one leaves is never moved
        folder.mkdir(parents=True)
        paths = []
        for n, row in enumerate(iterator):
            if row.url is not None:
                name = quote(row.url, safe="").replace("@", "%40")
                path = folder / f"{name}@{n}.html"
                path.write_text(row.html or "")
                paths.append(str(path))
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        for message in messages:
            for path in message.paths if message else ():
                stem = Path(path).name.rpartition("@")[0]
                os.replace(path, Path(self.path, f"{stem}@{uuid.uuid4().hex[:16]}.html"))
        shutil.rmtree(self.draft, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.draft, ignore_errors=True)
