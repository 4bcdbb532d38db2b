"""Readers and writers of the audit's inputs and outputs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

KINDS = ("env", "file", "ini", "wg")
STATE = "location string, fp string, since long, exact boolean"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`, which all executors share. Where that is unset, a local session takes a
    temporary folder, and a cluster, whose executors wouldn't share one, is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the file as one row, so that line numbers are those of the file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "value")).select((F.col("at") + 1).alias("line"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))


def source_rules(spark: SparkSession, path: str, default_days: int = 180) -> tuple[DataFrame, DataFrame, int, str | None]:
    """A rule file -> (rules: ord, kind, pattern), (same: group_id, location), stale days, path of the accounts' file or
    None. A bad line is an error that names its number; blank lines and # comments are skipped."""
    lines = _numbered(spark, path).filter("value <> '' and not value like '#%'").withColumn("part", F.split("value", r"\s+")).withColumn("n", F.size("part"))
    kind = F.col("part")[0]
    good = F.when(kind.isin(*KINDS), F.col("n") == 2).when(kind == "stale-days", (F.col("n") == 2) & F.col("part")[1].rlike("^[0-9]{1,9}$")).when(kind == "same", F.col("n") >= 3).when(kind == "shadow", F.col("n") == 2).otherwise(F.lit(False))
    bad = lines.filter(~good).agg(F.min("line")).first()[0]
    if bad is not None:
        raise ValueError(f"line {bad} can't be read")
    rules = lines.filter(kind.isin(*KINDS)).select(F.col("line").alias("ord"), kind.alias("kind"), F.col("part")[1].alias("pattern"))
    same = lines.filter(kind == "same").select(F.col("line").alias("group_id"), F.explode(F.slice("part", 2, 1 << 20)).alias("location"))
    days = lines.filter(kind == "stale-days").agg(F.max_by(F.col("part")[1].cast("int"), "line")).first()[0]
    shadow = lines.filter(kind == "shadow").agg(F.max_by(F.col("part")[1], "line")).first()[0]
    return rules, same, default_days if days is None else days, shadow


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, content binary) of all files below `path`. Files named .gz are decompressed by Spark's text
    source; a file that can't be read or decompressed is an error."""
    # Glob alternatives that together mean: any name that doesn't end in .gz.
    other = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*[!z],*[!g]z,*[!.]gz,z,gz}").load(path)
    packed = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path, wholetext=True)
    packed = packed.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").cast("binary").alias("content"))
    return other.select("path", F.col("modificationTime").alias("modified"), "content").unionByName(packed)


def config_lines(files: DataFrame) -> DataFrame:
    """(path, content) -> (path, line, text); a file that isn't valid UTF-8 yields nothing."""
    ok = files.filter(F.is_valid_utf8(F.col("content").cast("string")))
    return ok.select("path", F.posexplode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("line", "text"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated location, fp, since, exact; bad rows are dropped, of a location given twice the last row counts."""
    rows = _numbered(spark, path).withColumn("part", F.split("value", "\t")).filter("size(part) = 4 and length(part[1]) = 64")
    rows = rows.select("line", F.col("part")[0].alias("location"), F.col("part")[1].alias("fp"), F.expr("try_cast(part[2] as bigint)").alias("since"), F.expr("try_cast(part[3] as boolean)").alias("exact"))
    last = F.row_number().over(W.partitionBy("location").orderBy(F.desc("line")))
    return rows.filter("since is not null and exact is not null").withColumn("nth", last).filter("nth = 1").select("location", "fp", "since", "exact")


def write_state(state: DataFrame, folder: str, scan_id: str) -> None:
    """A snapshot per scan; readers take the greatest scan_id, so a scan that fails leaves the last one in force."""
    state.select("location", "fp", "since", "exact").write.mode("error").parquet(f"{folder}/scan_id={scan_id}")


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(T.StructType.fromDDL(STATE + ", scan_id string")).parquet(folder)
    newest = rows.agg(F.max("scan_id")).first()[0]
    return rows.filter(F.col("scan_id") == newest).drop("scan_id")


def read_denylist(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """label and regex, tab-separated; the list is a small file of rules, so it is read whole."""
    rows = _numbered(spark, path).withColumn("part", F.split("value", "\t", 2)).filter("size(part) = 2 and part[0] <> '' and not part[0] like '#%'")
    return [(r.label, r.regex) for r in rows.select("line", F.col("part")[0].alias("label"), F.col("part")[1].alias("regex")).orderBy("line").collect()]


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    value = F.lower(F.regexp_replace(F.regexp_replace("value", "#.*", ""), r"^\s+|\s+$", ""))
    return spark.read.text(path).select(value.alias("repo")).filter("repo <> ''").distinct()


def read_tool_calls(lines: DataFrame) -> DataFrame:
    """JSON events -> (command, file_path)."""
    event = F.from_json("value", "struct<tool_input:struct<command:string,file_path:string>>")
    return lines.select(event.alias("e")).select("e.tool_input.command", "e.tool_input.file_path")


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def write_redacted(redacted: DataFrame, path: str) -> None:
    """Redacted copies in a new place; the files themselves are never written."""
    redacted.write.mode("error").parquet(path)
