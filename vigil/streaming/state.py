"""Streams: rotation state per location, redaction of appended lines, roll-ups of the access log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import known

OUT = "location string, fp string, since long, exact boolean"
KEPT = "fp string, since long, exact boolean, seen long"


def _observe(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Scans in order of time; a scan older than the last one seen is ignored."""
    fp, since, exact, seen = state.get if state.exists else (None, 0, False, -1)
    rows = pd.concat(list(batches)).sort_values(["at", "fp"])
    for row in rows.itertuples():
        if row.at < seen:
            continue
        if row.fp != fp:
            since, exact, fp = row.at, fp is not None, row.fp
        seen = row.at
    if fp is not None:
        state.update((fp, int(since), bool(exact), int(seen)))
        yield pd.DataFrame([(key[0], fp, int(since), bool(exact))], columns=["location", "fp", "since", "exact"])


def observe_stream(scans: DataFrame) -> DataFrame:
    """A stream of scans (location, fp, at long) -> the state of each location that a batch touched."""
    return scans.groupBy("location").applyInPandasWithState(_observe, OUT, KEPT, "update", GroupStateTimeout.NoTimeout)


def access_counts(log: DataFrame) -> DataFrame:
    """A stream of parsed log rows -> counts and last access by name and verb."""
    return log.groupBy("name", "verb").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def redact_appended(rows: DataFrame, needles: DataFrame) -> DataFrame:
    """A stream of appended rows (path, content) -> the same rows without known credentials. It keeps no state, so rows
    that arrive while older ones are rewritten are redacted and carried over like any other. The dictionary has to fit one
    broadcast; `run_redacted` takes any."""
    return known.redact_rows(rows, needles)


def run_redacted(rows: DataFrame, needles: DataFrame, folder: str) -> DataFrame:
    """The rows (path, content) that a stream has now, redacted batch by batch with a dictionary of any size, as
    `run_available` returns them."""
    needles.write.mode("ignore").parquet(f"{folder}/needles")
    needles = needles.sparkSession.read.schema(needles.schema).parquet(f"{folder}/needles")
    kind = rows.schema["path"].dataType.simpleString()
    return run_available(rows, folder, each=lambda batch: known.redact_rows(batch, needles), schema=f"path {kind}, content binary, n_redacted long")


def run_available(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None, schema: str | None = None) -> DataFrame:
    """Process what a stream has now, exactly once per `folder`, and return all its output with the batch it came from.
    The output is written by batch number, so a batch that is run again replaces itself. `each` makes a batch rows of
    `schema` before they are written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    schema = (StructType.fromDDL(schema) if schema else stream.schema).add("batch", "long")
    return spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def latest_per_location(updates: DataFrame) -> DataFrame:
    """Updates (location, ..., batch) -> the state that the last batch left."""
    kept = [c for c in updates.columns if c not in ("location", "batch")]
    last = updates.groupBy("location").agg(F.max_by(F.struct(*kept), "batch").alias("last"))
    return last.select("location", "last.*")
