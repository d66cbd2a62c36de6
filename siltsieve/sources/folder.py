"""A batch data source that lists a folder: every file, empty ones too, with its first and last bytes.

The built-in file sources leave out empty files. Names that begin with a dot, symbolic links and excluded paths are skipped;
the walk is dealt to tasks by top-level entry. Register with `spark.dataSource.register(FolderSource)` and read with
`spark.read.format("folder").load(root)`; options: excluded (comma-separated paths), head, tail (bytes).
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, name string, path string, size_bytes long, modified timestamp, origin string, head binary, tail binary, issue string"


class Entry(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", "")
        self.excluded = {x for x in options.get("excluded", "").split(",") if x}
        self.head, self.tail = int(options.get("head", 4096)), int(options.get("tail", 65_536))

    def partitions(self) -> list[Entry]:
        try:
            names = sorted(os.listdir(self.root))
        except OSError:
            return [Entry(self.root)]
        return [Entry(os.path.join(self.root, n)) for n in names if not n.startswith(".")] or [Entry("")]

    def read(self, partition: Entry) -> Iterator[tuple]:
        if partition.path:
            yield from self._walk(partition.path)

    def _walk(self, path: str) -> Iterator[tuple]:
        name = os.path.basename(path)
        if path in self.excluded or os.path.islink(path) or (name.startswith(".") and path != self.root):
            return
        try:
            if os.path.isdir(path):
                for n in sorted(os.listdir(path)):
                    yield from self._walk(os.path.join(path, n))
                return
            at = os.stat(path)
            with open(path, "rb") as f:
                head = f.read(self.head)
                f.seek(max(0, at.st_size - self.tail))
                tail = f.read(self.tail)
            yield (path, name, path, at.st_size, dt.datetime.fromtimestamp(at.st_mtime, dt.UTC).replace(tzinfo=None), "fileSystem", head, tail, None)
        except OSError as e:
            yield (path, name, path, None, None, "fileSystem", None, None, f"can't be read: {e.strerror}")


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)
