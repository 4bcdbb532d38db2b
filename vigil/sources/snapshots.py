"""Rotation state in a folder: a snapshot for each scan, in buckets of locations, that counts once it is marked complete.

Snapshots are written in buckets, so a scan that is merged with the last one is shuffled by itself: the state is read where it
lies, each bucket by one task. A marker is written after the snapshot; a scan that breaks off leaves none and is never read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import audit
from .readers import STATE

BUCKETS = 64
_MARKS = "scan_id string, buckets int"


class Snapshots:
    """All snapshots of one folder; scans are ordered by their ids."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _scans(self) -> DataFrame:
        """The complete scans, a row each. A folder without one has no marks yet."""
        spark, path = self.spark, f"{self.folder}/complete"
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return spark.createDataFrame([], _MARKS)
        return spark.read.schema(_MARKS).parquet(path)

    def latest(self) -> DataFrame:
        """The state (location, fp, since, exact) of the greatest complete scan; empty if there is none."""
        last = self._scans().orderBy(F.desc("scan_id")).limit(1).collect()
        if not last:
            return self.spark.createDataFrame([], STATE)
        return self._table(last[0].scan_id, last[0].buckets)

    def _table(self, scan_id: str, buckets: int) -> DataFrame:
        """A snapshot as a table that Spark knows the buckets of. The name lives as long as the session; the files stay."""
        name = f"vigil_state_{uuid.uuid4().hex}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(STATE))
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (location) SORTED BY (location) INTO {buckets} BUCKETS LOCATION '{self.folder}/state/{scan_id}'")
        return self.spark.table(name)

    def save(self, state: DataFrame, scan_id: str, complete: bool = True) -> None:
        """Write a snapshot, one file for each bucket, and then its mark. A scan that is saved again replaces itself."""
        rows = state.select("location", "fp", "since", "exact").repartition(self.buckets, "location")
        name = f"vigil_state_{uuid.uuid4().hex}"
        rows.write.format("parquet").mode("overwrite").option("path", f"{self.folder}/state/{scan_id}").bucketBy(self.buckets, "location").sortBy("location").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files are external and stay
        if complete:
            marked = self._scans().filter(F.col("scan_id") == scan_id).isEmpty()
            if marked:
                self.spark.createDataFrame([(scan_id, self.buckets)], _MARKS).coalesce(1).write.mode("append").parquet(f"{self.folder}/complete")

    def observe(self, now: DataFrame, at: Column, unseen: DataFrame | None = None) -> DataFrame:
        """The state after a scan that sees `now` (location, fp) at `at`: what is there, as `audit.observe` has it, and, if
        `unseen` (ord, kind, pattern) is given, what lies under a source that couldn't be looked at. Only the scan is
        shuffled."""
        before = self.latest()
        after = audit.observe(before, now.select("location", "fp").repartition(self.buckets, "location"), at)
        if unseen is None:
            return after
        kept = audit.prune_state(before, now, unseen).join(now.select("location"), "location", "left_anti")
        return after.unionByName(kept.select(*after.columns))
