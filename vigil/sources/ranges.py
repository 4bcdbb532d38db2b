"""Files of any size as byte ranges.

A cell of Spark's binary source holds a whole file, 2 GB at most, in one task. This source cuts files at byte offsets: each
range is read by a task of its own, together with some bytes that follow it, so that what begins in a range can be read to
its end. Small files share a task. Nothing is opened to plan the ranges; a file that can't be read ends the query."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "vigil_ranges"
SCHEMA = "path string, offset long, own long, size long, content binary"
#: Bytes of a range.
RANGE = 16 << 20
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("own", pa.int64()), ("size", pa.int64()), ("content", pa.binary())])


class Ranges(InputPartition):
    def __init__(self, parts: list[tuple[str, int, int, int]]):
        #: (path, offset, own, size of the file)
        self.parts = parts


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range, self.overlap = options["path"], int(options.get("range", RANGE)), int(options.get("overlap", 0))

    def partitions(self) -> list[Ranges]:
        """Ranges of about one size, in the order of paths. Names that end in .gz are refused: a range of one can't be read."""
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        out: list[list[tuple[str, int, int, int]]] = [[]]
        room = self.range
        for f in sorted(files, key=lambda f: f.path):
            if f.path.endswith(".gz"):
                raise ValueError(f"{f.path} is compressed: read it whole")
            for offset in range(0, f.size, self.range):
                own = min(self.range, f.size - offset)
                if own > room:
                    out.append([])
                    room = self.range
                out[-1].append((f.path, offset, own, f.size))
                room -= own
        return [Ranges(parts) for parts in out if parts]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path, offset, own, size in partition.parts:
            with store.open_input_file(path) as file:
                content = file.read_at(min(own + self.overlap, size - offset), offset)
            if len(content) < own:
                raise OSError(f"{path} has become shorter while it was read")
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((path, offset, own, size, content), _ARROW.types, strict=True)], schema=_ARROW)


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def read_ranges(spark: SparkSession, path: str, overlap: int = 0, size: int = RANGE) -> DataFrame:
    """(path, offset, own, size, content): the files below `path`, a local or shared folder or a URI that Arrow's file systems
    know, as ranges of `size` bytes. `content` starts at `offset`; its first `own` bytes are the range, up to `overlap` more
    follow, and `size` is that of the file. Empty files have no range."""
    spark.dataSource.register(RangeSource)
    if "://" not in path:  # file:/x is Hadoop's form of a local name
        path = path.removeprefix("file:")
    return spark.read.format(NAME).option("path", path).option("overlap", str(overlap)).option("range", str(size)).load()
