"""A source of log lines: byte ranges of many files, the last lines of all of them, and new lines as a stream.

Files are ordered by their time of change and name (or by name alone), lines by file and offset. For the last lines the
driver reads backwards from the end of the last file until it has counted enough line breaks, a bounded tail, and plans
only the ranges that hold these lines. A line belongs to the range in which it begins, so ranges are read apart from each
other on the executors. A stream's offset is the place behind the last whole line of each file; a line that is still
being written waits for its break.

Files are read through Arrow's file systems, so a path may be local or in a store that Arrow knows (file, s3, gs, hdfs).
Names that begin with a dot or an underscore are passed over. An empty line is a line; a missing folder has none."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file string, at long"
ARROW = pa.schema([("value", pa.string()), ("file", pa.string()), ("at", pa.int64())])
#: Bytes of a range, of a step backwards, and lines of a batch.
SPLIT, STEP, LINES = 64 << 20, 1 << 16, 4_096


class Range(InputPartition):
    """The lines of a file that begin in [start, end); whole says that a line begins at start."""

    def __init__(self, file: str, start: int, end: int, whole: bool):
        self.file, self.start, self.end, self.whole = file, start, end, whole


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str, order: str) -> list[tuple[str, int]]:
    """Path and size of all files at or below path, in order."""
    system, place = _system(path)
    found = system.get_file_info(place)
    if found.type == fs.FileType.NotFound:
        return []
    below = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    hidden = lambda f: any(p[:1] in "._" for p in posixpath.relpath(f.path, place).split("/") if p != ".")
    files = [f for f in below if f.type == fs.FileType.File and (f is found or not hidden(f))]
    if order not in ("time", "name"):
        raise ValueError("order must be time or name")
    return [(f.path, f.size) for f in sorted(files, key=lambda f: (f.mtime_ns if order == "time" else 0, f.path))]


def _last_lines(system: fs.FileSystem, file: str, size: int, n: int) -> tuple[int, int]:
    """Where the last n lines of a file begin, and how many they are (fewer in a shorter file)."""
    found, place = 0, size
    with system.open_input_file(file) as f:
        while place:
            lo = max(0, place - STEP)
            f.seek(lo)
            data = f.read(place - lo)
            i = data.rfind(b"\n")
            while i >= 0:
                if lo + i != size - 1:  # the last break ends a line, others begin one
                    found += 1
                    if found == n:
                        return lo + i + 1, n
                i = data.rfind(b"\n", 0, i)
            place = lo
    return 0, found + (size > 0)


def _whole_end(system: fs.FileSystem, file: str, start: int, size: int) -> int:
    """The place behind the last line break in [start, size), or start."""
    with system.open_input_file(file) as f:
        place = size
        while place > start:
            lo = max(start, place - STEP)
            f.seek(lo)
            at = f.read(place - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            place = lo
    return start


def _ranges(file: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(file, i, min(i + split, end), i == start) for i in range(start, end, split)]


def _read(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    system, _ = _system(path)
    rows: list[tuple[str, int]] = []

    def batch() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([part.file] * len(rows)), pa.array([r[1] for r in rows], pa.int64())], schema=ARROW)
        rows.clear()
        return out

    with system.open_input_file(part.file) as f:
        place = part.start if part.whole else part.start - 1  # a line begins behind the break in front of it
        f.seek(place)
        rest, skip = b"", not part.whole
        while place < part.end or rest:
            data = f.read(1 << 20)
            if not data:
                if rest and not skip:
                    rows.append((rest.removesuffix(b"\r").decode("utf-8", "replace"), place - len(rest)))
                break
            lines = (rest + data).split(b"\n")
            at = place - len(rest)
            place += len(data)
            rest = lines.pop()
            for line in lines:
                if skip:
                    skip = False
                elif at >= part.end:
                    rest, place = b"", part.end
                    break
                else:
                    rows.append((line.removesuffix(b"\r").decode("utf-8", "replace"), at))
                    if len(rows) >= LINES:
                        yield batch()
                at += len(line) + 1
            if place - len(rest) >= part.end:  # what is left begins behind the range
                break
    if rows:
        yield batch()


class LogSource(DataSource):
    """Options: path; lines (the last lines only); order (time, name); split (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStream(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.order, self.split = options["path"], options.get("order", "time"), int(options.get("split", SPLIT))
        self.lines = int(options["lines"]) if "lines" in options else None

    def partitions(self) -> list[Range]:
        files = _files(self.path, self.order)
        if self.lines is None:
            return [r for file, size in files for r in _ranges(file, 0, size, self.split)] or [Range("", 0, 0, True)]
        system, left, out = _system(self.path)[0], self.lines, []
        for file, size in reversed(files):
            if left <= 0:
                break
            start, n = _last_lines(system, file, size, left)
            left -= n
            out += _ranges(file, start, size, self.split)
        return out or [Range("", 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from _read(self.path, partition)


class LogStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.order, self.split = options["path"], options.get("order", "time"), int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system = _system(self.path)[0]
        return {"files": json.dumps({file: _whole_end(system, file, 0, size) for file, size in _files(self.path, self.order)}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for file, to in after.items():
            since = before.get(file, 0)
            out += _ranges(file, since if since <= to else 0, to, self.split)  # a file that became shorter began again
        return out or [Range("", 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


def log_lines(spark: SparkSession, path: str, lines: int | None = None, **options) -> DataFrame:
    """value, file, at (byte offset) of the lines of all files at or below path, or of the last ones."""
    spark.dataSource.register(LogSource)
    r = spark.read.format("log_lines").options(path=path, **options)
    return (r if lines is None else r.option("lines", lines)).load()


def log_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """value, file, at of whole lines as they are appended to files at or below path."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("log_lines").options(path=path, **options).load()
