"""JSON lines as a data source of byte ranges, for batches and for streams.

A range of bytes stands for the lines that begin in it, so ranges may be cut anywhere and files of any size are read in parallel. A stream's
offset is, for each file, the byte behind its last whole line: a file may grow, a line that is still being written waits, and a query that
starts again goes on where it stood. Ranges give texts of lines; Spark parses them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "json_lines"
#: Bytes of a range, of a read, and of the lines that a batch holds.
RANGE, CHUNK = 64 << 20, 1 << 20


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, whole: bool) -> None:
        """whole: the last line counts though no line feed ends it."""
        self.path, self.begin, self.end, self.whole = path, begin, end, whole


def lines_of(file: BinaryIO, begin: int, end: int, *, whole: bool = True, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in begin to end - 1, without their line feeds."""
    file.seek(max(begin - 1, 0))
    held, at, skip = b"", max(begin - 1, 0), begin > 0  # what stands before the first line feed began in an earlier range
    while True:
        more = file.read(chunk)
        held += more
        from_ = 0
        while (feed := held.find(b"\n", from_)) >= 0:
            if not skip:
                if at >= end:
                    return
                yield at, held[from_:feed]
            skip = False
            at += feed + 1 - from_
            from_ = feed + 1
        held = held[from_:]
        if not more:
            if whole and held and not skip and at < end:
                yield at, held
            return
        if skip:
            at, held = at + len(held), b""
        elif at >= end:
            return


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> dict[str, int]:
    """Files of a folder, or a file, with their sizes; names that begin with a dot or an underscore are left out."""
    system, at = opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    return {x.path: x.size for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name[0] not in "._"}


def last_feed(path: str, file: str, size: int, chunk: int = CHUNK) -> int:
    """The byte behind a file's last line feed."""
    with opened(path)[0].open_input_file(file) as f:
        end = size
        while end > 0:
            begin = max(0, end - chunk)
            f.seek(begin)
            if (found := f.read(end - begin).rfind(b"\n")) >= 0:
                return begin + found + 1
            end = begin
    return 0


class _Ranges:
    """What batches and streams share: ranges to lines."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE))

    def cut(self, file: str, begin: int, end: int, whole: bool) -> list[Range]:
        return [Range(file, a, min(a + self.size, end), whole) for a in range(begin, end, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with opened(self.path)[0].open_input_file(partition.path) as f:
            paths, places, texts, held = [], [], [], 0
            for place, line in lines_of(f, partition.begin, partition.end, whole=partition.whole):
                if line.strip():
                    paths.append(partition.path)
                    places.append(place)
                    texts.append(line.decode("utf-8", "replace"))
                    held += len(line)
                if held > CHUNK:
                    yield _batch(paths, places, texts)
                    paths, places, texts, held = [], [], [], 0
            yield _batch(paths, places, texts)


def _batch(paths: list[str], places: list[int], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=["path", "place", "value"])


class BatchReader(_Ranges, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for file, size in listed(self.path).items() for r in self.cut(file, 0, size, True)] or [Range("", 0, 0, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter([_batch([], [], [])])


class StreamReader(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {file: last_feed(self.path, file, size) for file, size in listed(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for file, to in end.items() for r in self.cut(file, start.get(file, 0), to, False)]

    def commit(self, end: dict) -> None:
        pass


class JsonLines(DataSource):
    """Options: path, a folder or a file on any file system that pyarrow opens; rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, place long, value string"

    def reader(self, schema: object) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema: object) -> StreamReader:
        return StreamReader(dict(self.options))


def json_lines(spark: SparkSession, path: str, schema: str, *, stream: bool = False, places: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """The rows of a folder's or file's JSON lines; blank lines are none, a line that is no JSON object fails the query. With places, each row
    has its file and the byte at which its line begins."""
    spark.dataSource.register(JsonLines)
    reader = spark.readStream if stream else spark.read
    lines = reader.format(NAME).option("path", path).option("rangeBytes", range_bytes).load()
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(*(["path", "place"] if places else []), row.alias("row")).select(*(["path", "place"] if places else []), "row.*")


def written(rows: list[dict]) -> bytes:
    return b"".join(json.dumps(r).encode() + b"\n" for r in rows)
