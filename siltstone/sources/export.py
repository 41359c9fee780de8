"""Exports of conversations as a Python data source: reader with pushed filters, stream reader, and writer.

A file holds whole conversations one after another: a line of `#` and identifier, then a line for each
turn with its number, role and text, divided by tabs, in which backslash, tab and line ends are escaped. Its name
holds the least and the largest identifier, so that filters on them skip files. Files are read in pieces of a bounded
number of bytes: a piece begins at the first conversation that starts in it and ends with the last one that does.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

NAME, SCHEMA = "conversation_export", "conv_id bigint, turn bigint, role string, text string"

#: Bytes of a piece.
PIECE = 32 << 20

FILE = re.compile(r"part-(-?\d+)_(-?\d+)-[0-9a-f]{32}\.export$")
ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}
BACK = {v[1]: k for k, v in ESCAPES.items()}


def _escaped(value: str | None) -> str:
    return "\\0" if value is None else re.sub(r"[\\\t\n\r]", lambda m: ESCAPES[m[0]], value)


def _plain(value: str) -> str | None:
    return None if value == "\\0" else re.sub(r"\\(.)", lambda m: BACK[m[1]], value)


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    path: str | None


def _files(path: str) -> list[tuple[str, int, int, int]]:
    """path, size, least and largest identifier of the files of an export, in the order of their names' arrival."""
    store, folder = fs.FileSystem.from_uri(path)
    found = []
    for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        m = FILE.match(f.base_name)
        if m:
            found.append((f.mtime_ns or 0, f.base_name, f.path, f.size, int(m[1]), int(m[2])))
    return [x[2:] for x in sorted(found)]


def _pieces(files: list[tuple[str, int, int, int]]) -> list[Piece]:
    return [Piece(name, at, min(at + PIECE, size)) for name, size, _, _ in files for at in range(0, size, PIECE)]


def _turns(root: str, piece: Piece) -> Iterator[tuple]:
    """The turns of the conversations that start in a piece."""
    store, _ = fs.FileSystem.from_uri(root)
    with store.open_input_file(piece.path) as file:
        at = max(0, piece.start - 1)  # a line starts in the piece if the byte before it ends one
        file.seek(at)
        held, conv, first = b"", None, piece.start > 0
        while True:
            more = file.read(1 << 20)
            lines = (held + more).split(b"\n")
            held = lines.pop()
            for line in lines:
                began, at = at, at + len(line) + 1
                if first:  # the rest of a line that started before
                    first = False
                    continue
                if line.startswith(b"#"):
                    if began >= piece.end:
                        return
                    name = line[1:].decode()
                    conv = (None if name == "-" else int(name),)
                elif conv is not None:
                    turn, role, text = line.decode().split("\t")
                    yield (*conv, None if turn == "-" else int(turn), _plain(role), _plain(text))
            if not more:
                return


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.low, self.high = path, None, None

    def partitions(self) -> list[Piece]:
        files = [f for f in _files(self.path) if (self.low is None or f[3] >= self.low) and (self.high is None or f[2] <= self.high)]
        return _pieces(files) or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _turns(self.path, partition) if partition.path else iter(())


class PushedReader(Reader):
    """For sessions with spark.sql.python.filterPushdown.enabled, which is off by default."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the identifier skip files; rows are filtered by Spark all the same."""
        for f in filters:
            if getattr(f, "attribute", None) == ("conv_id",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(x for x in (self.low, f.value) if x is not None)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(x for x in (self.high, f.value) if x is not None)
            yield f


class StreamReader(DataSourceStreamReader):
    """The offset is the number of files, which arrive in the order of their times; an export only grows."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return _pieces(_files(self.path)[start["files"] : end["files"]])

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _turns(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class Writer(DataSourceWriter):
    """Each task writes a file of its own under a hidden name, which it gets rid of when all have been written. Rows
    come with a conversation's turns together: see export()."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder)
        hidden = f"{folder}/_{uuid.uuid4().hex}"
        ids: list[int] = []
        rows = 0
        with store.open_output_stream(hidden) as out:
            last = object()
            for row in iterator:
                if row.conv_id != last:
                    last = row.conv_id
                    ids += [] if last is None else [last]
                    ids = [min(ids), max(ids)] if ids else ids
                    out.write(f"#{'-' if last is None else last}\n".encode())
                out.write(f"{'-' if row.turn is None else row.turn}\t{_escaped(row.role)}\t{_escaped(row.text)}\n".encode())
                rows += 1
        if not rows:
            store.delete_file(hidden)
            return Written(None)
        low, high = (ids[0], ids[-1]) if ids else (0, 0)
        named = f"{folder}/_part-{low}_{high}-{uuid.uuid4().hex}.export"
        store.move(hidden, named)
        return Written(named)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.path:
                folder, name = m.path.rsplit("/", 1)
                store.move(m.path, f"{folder}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.path:
                store.delete_file(m.path)


class Conversations(DataSource):
    """An export below the option `path`."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return (PushedReader if self.options.get("pushed") == "true" else Reader)(self.options["path"])

    def streamReader(self, schema) -> StreamReader:  # noqa: ANN001, N802
        return StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
        return Writer(self.options["path"])


def export(conversations: DataFrame, path: str) -> None:
    """Write conversations (conv_id, turn, role, text; others are left out) as an export, or more files of one. Turns of
    a conversation come together, by number; those without an identifier are one conversation. Any text, null or empty
    too, comes back as it was. A conversation is written by one task."""
    spark: SparkSession = conversations.sparkSession
    spark.dataSource.register(Conversations)
    rows = conversations.selectExpr("cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn", "role", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(tasks, "conv_id").sortWithinPartitions("conv_id", "turn")
    ranged.write.format(NAME).option("path", path).mode("append").save()


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An export as a table. Where the session pushes filters to Python data sources, those on identifiers skip files."""
    spark.dataSource.register(Conversations)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).option("path", path).option("pushed", pushed).load()


def stream_export(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Conversations)
    return spark.readStream.format(NAME).option("path", path).load()
