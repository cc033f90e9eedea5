"""Text lines with their exact place, read by byte ranges.

Spark's text reader tells neither where in a file a line begins nor whether the
last one ends. This source cuts files into ranges; each range is read by one task,
which gives the lines that begin in it. A line's place is its byte offset in the
file (in the unpacked bytes of a gzip file), the same however the file is cut.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE = 32 << 20
# Lines of a batch, and bytes read at a time to find the end of the last line.
BATCH, MORE = 8192, 1 << 16

SCHEMA = "file string, start long, value string, torn boolean"


@dataclass
class Range(InputPartition):
    uri: str
    start: int
    end: int
    packed: bool


def _listed(path: str, glob: str) -> list[tuple[str, int]]:
    """(URI, size) of the files at a path: one file, or those of a folder and its folders, without hidden ones."""
    import fnmatch

    files, place = fs.FileSystem.from_uri(path)
    root = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = files.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(place, recursive=True))
    below = lambda f: f.path[len(place) :].split("/")
    shown = [f for f in found if f.type == fs.FileType.File and (f.path == place or not any(p.startswith(("_", ".")) for p in below(f)))]
    return [(root + f.path, f.size) for f in shown if fnmatch.fnmatch(f.base_name, glob)]


class RangedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.glob = options["paths"].split("\n"), options.get("glob", "*")
        self.size = int(options.get("range", RANGE))

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            for uri, size in _listed(path, self.glob):
                if uri.endswith(".gz"):
                    out.append(Range(uri, 0, size, True))
                else:
                    out += [Range(uri, at, min(at + self.size, size), False) for at in range(0, size, self.size)]
        return out or [Range("", 0, 0, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        data, start, last = _bytes_of(partition)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        firsts = np.concatenate([[0], ends + 1])
        torn = last and len(data) > firsts[-1]
        stops = np.concatenate([ends, [len(data)]]) if torn else ends
        firsts = firsts[: len(stops)]
        if not partition.packed:
            kept = firsts + start < partition.end
            firsts, stops = firsts[kept], stops[kept]
        for at in range(0, len(firsts), BATCH):
            part = slice(at, at + BATCH)
            values = [data[a:b].removesuffix(b"\r").decode("utf-8", "replace") for a, b in zip(firsts[part], stops[part], strict=True)]
            here = np.zeros(len(values), bool)
            here[-1] = torn and at + BATCH >= len(firsts) and stops[-1] == len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.uri] * len(values)), pa.array(firsts[part] + start), pa.array(values, pa.string()), pa.array(here)],
                ["file", "start", "value", "torn"],
            )


def _bytes_of(partition: Range) -> tuple[bytes, int, bool]:
    """The bytes from the first line that begins in a range to the end of its last one, their offset, and whether the file ends there."""
    files, place = fs.FileSystem.from_uri(partition.uri)
    with files.open_input_file(place) as stream:
        if partition.packed:
            return gzip.decompress(stream.read()), 0, True
        # The byte before tells whether a line begins with the range.
        begin = max(0, partition.start - 1)
        stream.seek(begin)
        data, size = stream.read(partition.end - begin), stream.size()
        # The last line goes on until its line feed, in this range or beyond.
        more = [data]
        while begin + sum(map(len, more)) < size and not more[-1].endswith(b"\n"):
            piece = stream.read(MORE)
            cut = piece.find(b"\n")
            more.append(piece if cut < 0 else piece[: cut + 1])
        data = b"".join(more)
    last = begin + len(data) >= size
    if partition.start:
        cut = data.find(b"\n")
        if cut < 0:
            return b"", begin + len(data), False  # the middle of one long line
        data, begin = data[cut + 1 :], begin + cut + 1
    return data, begin, last


class RangedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ranged_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RangedReader(self.options)


def ranged_lines(spark: SparkSession, paths: str | list[str], glob: str = "*", size: int = RANGE) -> DataFrame:
    """(file, start, value, torn) of every line; ``torn`` marks the last line of a file that does not end with a line feed.

    A carriage return before the line feed is not part of the line; bytes that are
    not UTF-8 are replaced. Folders are read with the folders in them, hidden files
    left out. A gzip file is read by one task.
    """
    spark.dataSource.register(RangedLines)
    listed = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("ranged_lines").option("paths", "\n".join(listed)).option("glob", glob).option("range", str(size)).load()
