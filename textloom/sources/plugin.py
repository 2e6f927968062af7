"""Parsers of a user's own as Spark data sources.

A parser is a function from the lines of a file to rows. Registered under a name it
reads with ``spark.read.format(name)`` and ``spark.readStream.format(name)``. Files
are dealt out in byte ranges, and a line belongs to the range it starts in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: A file, the offset of a line in it, and the line without its end.
Line = tuple[str, int, str]
Parser = Callable[[Iterable[Line]], Iterable[tuple]]

SPLIT_BYTES = 128 << 20
_CHUNK = 1 << 20


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


def _files(path: str, glob: str) -> list[tuple[int, str, int]]:
    """(time of change, path, bytes) of the files below a folder, or of one file."""
    from fnmatch import fnmatch

    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    store, place = fs.FileSystem.from_uri(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        found = store.get_file_info(fs.FileSelector(place, recursive=True))
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    return sorted(
        (f.mtime_ns, scheme + f.path, f.size)
        for f in found
        if f.type == fs.FileType.File and fnmatch(f.base_name, glob) and not f.base_name.startswith((".", "_"))
    )


def lines(part: ByteRange) -> Iterator[Line]:
    """The lines that start in a byte range."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(part.path)
    with store.open_input_file(place) as f:
        # A line starts behind a line end: look for one from the byte before.
        at = max(part.start - 1, 0)
        f.seek(at)
        rest, skip = b"", part.start > 0
        while part.start < part.end:
            chunk = f.read(_CHUNK)
            if not chunk:
                break
            pieces = chunk.split(b"\n")
            pieces[0] = rest + pieces[0] if len(pieces) > 1 or not rest else pieces[0]
            if len(pieces) == 1:
                rest = rest + pieces[0] if rest else pieces[0]
                continue
            *whole, rest = pieces
            for piece in whole:
                if skip:
                    skip = False
                elif at >= part.end:
                    return
                else:
                    yield part.path, at, piece.decode("utf-8", "replace").removesuffix("\r")
                at += len(piece) + 1
        if rest and not skip and at < part.end:
            yield part.path, at, rest.decode("utf-8", "replace").removesuffix("\r")


def _ranges(files: Iterable[tuple[int, str, int]], size: int) -> list[ByteRange]:
    return [ByteRange(p, i, min(i + size, n)) for _, p, n in files for i in range(0, n, size)]


def parser_source(name: str, schema: str, parse: Parser) -> type[DataSource]:
    """A data source class for a parser.

    Options: ``path``, ``glob`` (default: all files) and ``splitBytes``. A stream
    takes files in the order of their time of change and path; its offset is the
    last file taken, so a file that appears later with an earlier time is not seen.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.path, self.glob = options["path"], options.get("glob", "*")
            self.size = int(options.get("splitBytes", SPLIT_BYTES))

        def partitions(self) -> list[ByteRange]:
            return _ranges(_files(self.path, self.glob), self.size)

        def read(self, partition: ByteRange) -> Iterator[tuple]:
            yield from parse(lines(partition))

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.path, self.glob = options["path"], options.get("glob", "*")
            self.size = int(options.get("splitBytes", SPLIT_BYTES))

        def initialOffset(self) -> dict:
            return {"time": -1, "path": ""}

        def latestOffset(self) -> dict:
            files = _files(self.path, self.glob)
            return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

        def partitions(self, start: dict, end: dict) -> list[ByteRange]:
            after, upto = (start["time"], start["path"]), (end["time"], end["path"])
            return _ranges([f for f in _files(self.path, self.glob) if after < f[:2] <= upto], self.size)

        def read(self, partition: ByteRange) -> Iterator[tuple]:
            yield from parse(lines(partition))

    class ParserSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(self.options)

    return ParserSource


def register_parser(spark: SparkSession, name: str, schema: str, parse: Parser) -> None:
    """Makes a parser readable as ``spark.read.format(name)``; a name that was
    registered before now means this parser."""
    spark.dataSource.register(parser_source(name, schema, parse))


CRAWL = (
    "file string, _block bigint, _row bigint, content string, "
    "metadata struct<quality_warnings:array<string>,"
    "sentence_identifications:array<struct<label:string,prob:double>>>"
)


def parse_crawl(found: Iterable[Line]) -> Iterator[tuple]:
    """Crawl records, one a line, in the columns that ``crawl_sentences`` takes."""
    import json

    for file, at, line in found:
        if line.strip():
            record = json.loads(line)
            meta = record.get("metadata") or {}
            idents = meta.get("sentence_identifications")
            if idents is not None:
                idents = [None if i is None else (i.get("label"), i.get("prob")) for i in idents]
            # Blocks only bound the rows that are ranked together.
            yield file, at >> 20, at, record.get("content"), (meta.get("quality_warnings"), idents)
