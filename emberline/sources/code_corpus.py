"""A corpus of code as a data source, after register(spark): spark.read.format("code_corpus").option("max_files", "1000").load(path).

path is a folder, whose .py files are read in order of their paths, or a JSON lines file with a `content` in each row. Any address that pyarrow.fs opens will do. Rows are (path, content); bytes that aren't
UTF-8 are dropped. max_files counts files, or lines that aren't blank; 0: all. A partition is a range of `files_per_partition` files, or of `bytes_per_partition` bytes of lines; a line belongs to the range in
which it begins. With max_files the lines are read up to that many by one task. Conditions on `path` (equal to, in, starts with) are pushed down, so other files aren't opened;
they never change which files max_files counts.

Results in special cases: files that can't be read are passed over; a row without content has ''; a malformed line raises; an empty folder or file gives no row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Lines(InputPartition):
    path: str
    start: int
    end: int
    most: int


#: There must be a partition.
NOTHING = Files([])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, which must allow pushdown into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CodeCorpus)


class CodeCorpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "code_corpus"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CodeCorpusReader(self.options)


class CodeCorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.most = options["path"], int(options.get("max_files", 0))
        self.files, self.bytes = int(options.get("files_per_partition", 100)), int(options.get("bytes_per_partition", 64 << 20))
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and tuple(f.attribute) == ("path",):
                self.wanted.append(("starts", f.value) if isinstance(f, StringStartsWith) else ("in", [f.value] if isinstance(f, EqualTo) else list(f.value)))
            else:
                yield f

    def passes(self, path: str) -> bool:
        return all(path.startswith(v) if kind == "starts" else path in v for kind, v in self.wanted)

    def opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self.opened()
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            if not self.passes(root):
                return [NOTHING]
            if self.most:
                return [Lines(root, 0, info.size, self.most)]
            return [Lines(root, at, min(at + self.bytes, info.size), 0) for at in range(0, info.size, self.bytes)] or [NOTHING]
        found = sorted((f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".py")), key=lambda p: p.split("/"))
        found = [p for p in (found[: self.most] if self.most else found) if self.passes(p)]
        return [Files(found[k : k + self.files]) for k in range(0, len(found), self.files)] or [NOTHING]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = self.opened()
        yield from self._files(store, partition.paths) if isinstance(partition, Files) else self._lines(store.open_input_file, partition)

    def _files(self, store, paths: list[str]) -> Iterator[tuple]:
        for path in paths:
            try:
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
            except OSError:
                continue
            # as a text file: ends of lines become \n
            yield path, data.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")

    def _lines(self, opened: Callable, part: Lines) -> Iterator[tuple]:
        import io

        seen = 0
        with io.BufferedReader(opened(part.path)) as f:
            if part.start:
                # the line that is under way belongs to the range before
                f.seek(part.start - 1)
                f.readline()
            while f.tell() < part.end and (line := f.readline()):
                if line.strip():
                    yield part.path, json.loads(line).get("content", "")
                    seen += 1
                    if part.most and seen >= part.most:
                        return
