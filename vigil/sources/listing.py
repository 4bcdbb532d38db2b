"""Files of the folders that rules name, listed by tasks as a data source: no file is opened, no other folder is listed.

The folders reach the source as a pushed filter, so a listing without one is an error and not a walk over a whole store. Names
that begin with a dot or an underscore are listed like others."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators import audit

NAME = "vigil_listing"
SCHEMA = "folder string, path string, size long, modified timestamp, entries long"
_ARROW = pa.schema([("folder", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("entries", pa.int64())])
#: Folders that one task lists, and rows of a batch.
FOLDERS, ROWS = 16, 10_000


class Folders(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.folders: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("folder",):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.folders = named if self.folders is None else self.folders & named
            else:
                yield f

    def partitions(self) -> list[Folders]:
        if self.folders is None:
            raise ValueError("a listing needs the folders to list: filter by folder")
        names = sorted(f for f in self.folders if f is not None)
        return [Folders(names[i : i + FOLDERS]) for i in range(0, len(names), FOLDERS)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.root) if self.root else (fs.LocalFileSystem(), "")
        for folder in partition.names:
            try:
                found = store.get_file_info(fs.FileSelector(f"{root}{folder}" or "/", recursive=False))
            except OSError:  # not there, no folder, or not ours to look at: out of sight
                found = None
            rows = [(folder, None, None, None, None if found is None else len(found))]
            rows += [(folder, f"{folder}/{f.base_name}", f.size, f.mtime, None) for f in found or () if f.type == fs.FileType.File]
            for i in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + ROWS], strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def read_listing(spark: SparkSession, root: str = "") -> DataFrame:
    """(folder, path, size, modified, entries): to be filtered by `folder`, a name below `root` that begins with a slash. Each
    folder has a row without a path, with the number of its entries, or null if it couldn't be looked at, and a row for each
    file directly in it. `root` is a local or shared folder or a URI that Arrow's file systems know; paths don't repeat it.
    Turns on `spark.sql.python.filterPushdown.enabled`, without which Spark pushes nothing to a source in Python."""
    spark.dataSource.register(ListingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    root = root if "://" in root else root.removeprefix("file:")
    return spark.read.format(NAME).option("path", root).load()


def listed(rules: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """rules (ord, kind, pattern) -> (matched: ord, kind, pattern, path, size, modified), (folders: path), those that could be
    looked at and aren't empty, as `audit.uncovered` takes them. Folders are gathered from the rules, the few lines of a rule
    file. Several rules of one folder list it once; one folder is one task, however many files it has, as a store gives them
    in one sequence."""
    folder = F.regexp_extract("pattern", r"^(.*)/[^/]*$", 1)
    names = [r.folder for r in rules.filter(F.col("pattern").contains("/")).select(folder.alias("folder")).distinct().collect()]
    rows = read_listing(rules.sparkSession, root).filter(F.col("folder").isin(names) if names else F.col("folder").isNull() & F.col("folder").isin("/"))
    files = rows.filter("path is not null")
    matched = audit.match_sources(rules, files).join(files.select("path", "size", "modified"), "path")
    return matched.select("ord", "kind", "pattern", "path", "size", "modified"), rows.filter("path is null and entries > 0").select(F.col("folder").alias("path"))
