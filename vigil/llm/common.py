"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that separate words.
WS = r"[\x20\x09-\x0D]+"
#: One word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the filters that are broadcast.
FILTER = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Where it is unset, a local session (tests) takes a new
    temporary one, and a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="vigil-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str, session: SparkSession | None = None) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back, in `session` if it is given; this cuts the lineage and
    survives lost executors."""
    session = session or df.sparkSession
    path = os.path.join(shared_dir(session), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for an equi-join whose sides grow with the corpus: it is sorted and merged, never broadcast, so nothing of it
    passes through the driver, which would keep a thread and a hash table for each small one."""
    return df.hint("merge")


def small_batches(spark: SparkSession, rows: int) -> SparkSession:
    """A session like `spark` that hands at most so many rows to Python at a time, for rows that are large themselves."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max(1, rows)))
    return session


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as array<string>; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def most_frequent(counted: DataFrame, n_col: str, at_most: int) -> DataFrame:
    """The rows with the largest counts, `at_most` of them or fewer: all from a threshold on that a histogram of the counts
    gives, so that no sorting gathers more on the driver than is asked for. Rows within one step of the histogram (a ninth
    root of two) stay or go together."""
    step = F.floor(F.log2(F.col(n_col)) * 9).cast("int")
    seen, least = 0, None
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r.step):
        seen += r.rows
        if seen > at_most:
            break
        least = r.step
    return counted.filter(step >= least if least is not None else F.lit(False))


def bitmap(values: DataFrame) -> np.ndarray:
    """A bit for each remainder modulo FILTER that occurs in the one long column: a filter of a fixed size."""
    at = F.pmod(F.col(values.columns[0]), F.lit(FILTER))
    words = values.groupBy(F.floor(at / 32).cast("int").alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(FILTER // 32, np.int64)
    bits[words["k"].to_numpy()] = words["bits"].to_numpy()
    return bits & 0xFFFFFFFF


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % FILTER
    return (bits[at >> 5] >> (at & 31) & 1).astype(bool)
