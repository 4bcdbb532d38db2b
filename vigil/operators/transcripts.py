"""Access logs and transcripts: handles, pasted and echoed secrets, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERBS = ("init", "put", "get", "list", "rm")
LOG_LINE = r"^(\S+) (init|put|get|list|rm) (\S+) pid=(\d+) uid=(\d+)$"
HANDLE = r"\$\{SECRET:([A-Za-z0-9._-]+)\}"


def parse_access_log(lines: DataFrame) -> DataFrame:
    """value -> ts, verb, name (null for -), pid, uid; lines of another form are dropped."""
    g = lambda k: F.regexp_extract("value", LOG_LINE, k)
    rows = lines.filter(F.col("value").rlike(LOG_LINE))
    return rows.select(F.try_to_timestamp(g(1)).alias("ts"), g(2).alias("verb"), F.nullif(g(3), F.lit("-")).alias("name"), g(4).cast("long").alias("pid"), g(5).cast("long").alias("uid"))


def access_rollup(log: DataFrame) -> DataFrame:
    """Counts and last access by name and verb, by name, and in all."""
    return log.rollup("name", "verb").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.grouping_id().alias("level"))


def unused_verbs(log: DataFrame) -> DataFrame:
    known = log.sparkSession.createDataFrame([(v,) for v in VERBS], "verb string")
    return known.join(log.select("verb").distinct(), "verb", "left_anti")


def vault_inventory(log: DataFrame, order: str = "line") -> DataFrame:
    """Names whose last put or rm is a put, with its time. Events of one time follow each other in the order of the log's
    lines, as the column `order` numbers them."""
    last = log.filter(F.col("verb").isin("put", "rm")).groupBy("name").agg(F.max(F.struct("ts", order, "verb")).alias("last"))
    return last.filter("last.verb = 'put'").select("name", F.col("last.ts").alias("ts"))


def secret_handles(turns: DataFrame) -> DataFrame:
    """${SECRET:name} references: (conv_id, turn, name)."""
    return turns.select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(HANDLE), 1))).alias("name"))


def unknown_handles(handles: DataFrame, inventory: DataFrame) -> DataFrame:
    return handles.join(inventory.select("name"), "name", "left_anti")


def valid_name(name):
    return name.rlike("^[A-Za-z0-9._-]+$") & ~F.contains(name, F.lit(".."))


def kebab_name(name):
    return name.rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def echoed_secrets(hits: DataFrame) -> DataFrame:
    """hits (conv_id, turn, role, label) -> assistant turns that repeat what a user turn before pasted."""
    pasted = hits.filter("role = 'user'").groupBy("conv_id", "label").agg(F.min("turn").alias("pasted_turn"))
    said = hits.filter("role = 'assistant'").select("conv_id", "label", "turn").distinct()
    return said.join(pasted, ["conv_id", "label"]).filter("turn > pasted_turn").select("conv_id", "label", "pasted_turn", F.col("turn").alias("echoed_turn"))
