"""Redacted copies as files: one for each file that changed, all of them or none.

Tasks write below a folder of their own attempt. Only when every task has ended are the files moved to their names, so a task
that fails, or one that runs twice, leaves nothing behind; a rerun puts the same files in the same places."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "vigil_files"


@dataclass
class Written(WriterCommitMessage):
    #: (where a file lies now, its name below the target)
    files: list[tuple[str, str]]
    attempt: str


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.target, self.run = options["path"].rstrip("/"), options["run"]

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.target)

    def write(self, rows: Iterator) -> Written:
        store, root = self._store()
        attempt, files = f"{root}/_staged-{self.run}/{uuid.uuid4().hex}", []
        for n, row in enumerate(rows):
            if n == 0:  # not recursively: a task that goes on after the write was given up fails here or at its next file
                store.create_dir(attempt, recursive=False)
            with store.open_output_stream(f"{attempt}/{n}") as out:
                out.write(bytes(row["content"]))
            files.append((f"{attempt}/{n}", row["name"]))
        return Written(files, attempt)

    def commit(self, messages: list[Written]) -> None:
        store, root = self._store()
        for m in messages:
            for staged, name in m.files if m else ():
                store.create_dir(os.path.dirname(f"{root}/{name}"))
                store.move(staged, f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/_staged-{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_staged-{self.run}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        out = FileWriter(self.options)
        store, root = out._store()
        store.create_dir(f"{root}/_staged-{out.run}")
        return out


def write_files(redacted: DataFrame, target: str, root: str = "") -> None:
    """redacted (path, content, n_redacted): the rows with a redaction as files below `target`, under their path less `root`.
    Files without one are left out. Compressed files, standard input and names that lead out of the target are refused, changed
    or not, and so are two changed rows of one path, before anything is written; the files themselves never are."""
    name = F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(//[^/]*)?", ""), r"^/+", "")
    below = root.split(":", 1)[-1].strip("/")
    if below:
        name = F.when(name.startswith(f"{below}/"), F.substring(name, F.lit(len(below) + 2), F.length(name))).otherwise(name)
    rows = redacted.select("path", name.alias("name"), "content", "n_redacted")
    odd = F.col("path").isNull() | F.col("path").rlike(r"(?i)\.gz$") | F.col("path").isin("-", "") | F.col("name").rlike(r"(^|/)\.\.(/|$)")
    bad = rows.filter(odd).select("path").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].path} can't be rewritten: it is compressed, no file, or outside of the target")
    changed = rows.filter("n_redacted > 0").select("name", "content")
    twice = changed.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].name} is there twice")
    spark = redacted.sparkSession
    spark.dataSource.register(FileSink)
    target = target if "://" in target else os.path.abspath(target.removeprefix("file:"))
    changed.write.format(NAME).mode("append").option("path", target).option("run", uuid.uuid4().hex).save()
