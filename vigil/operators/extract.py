"""Credentials out of config lines (path, line, text) -> (location, secret). Drop `secret` in the same stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import running


def extract_env(lines: DataFrame) -> DataFrame:
    """KEY=value files. A password in a URL wins over the rule for names, and either must be a real value; of a key given
    twice, the last such value counts."""
    rows = lines.filter(~F.regexp_like("text", F.lit(r"^\s*#"))).select("path", "line", T.env_key(F.col("text")).alias("key"), T.env_value(F.col("text")).alias("value"))
    in_url = T.url_password(F.col("value"))
    secret = F.when(in_url != "", in_url).when(T.is_secret_key(F.col("key")), F.col("value"))
    found = rows.filter("key <> ''").withColumn("secret", secret).filter(T.is_real_value(F.col("secret")))
    last = found.groupBy("path", "key").agg(F.max_by("secret", "line").alias("secret"))
    return last.select(F.concat(F.lit("env:"), "path", F.lit("#"), "key").alias("location"), "secret")


def extract_ini(lines: DataFrame) -> DataFrame:
    """[section] files: password and secret keys, = or =>; comments start with ; or #. Duplicates stay."""
    t = T.trimmed(F.col("text"))
    rows = lines.withColumn("t", t).filter(~F.col("t").rlike("^[;#]"))
    section = F.when(F.col("t").rlike(r"^\[.*\]$"), F.regexp_extract("t", r"^\[(.*)\]$", 1))
    rows = running(rows, ["path"], "line", ["line"], section=("last", section))
    key, value = F.lower(F.regexp_extract("t", r"^([^=\[]*?)\s*=>?\s*(.*)$", 1)), F.regexp_extract("t", r"^([^=\[]*?)\s*=>?\s*(.*)$", 2)
    found = rows.select("path", "line", F.coalesce("section", F.lit("")).alias("section"), key.alias("key"), T.strip_quotes(value).alias("secret"))
    found = found.filter(F.col("key").isin("password", "secret") & T.is_real_value(F.col("secret")))
    return found.select(F.concat(F.lit("ini:"), "path", F.lit("#["), "section", F.lit("]")).alias("location"), "line", "secret")


def extract_wg(lines: DataFrame) -> DataFrame:
    """Interface and peer sections: PrivateKey and PresharedKey; a peer is named by the first entry of its last
    AllowedIPs line, or by its number."""
    head = F.col("t").rlike(r"^\[.*\]$")
    rows = lines.withColumn("t", T.trimmed(F.col("text"))).filter(~F.col("t").rlike("^[;#]"))
    rows = running(rows, ["path"], "line", ["line"], sec=("sum", head.cast("int")), peer_no=("sum", (F.lower("t") == "[peer]").cast("int")))
    key, value = T.trimmed(F.substring_index("t", "=", 1)), T.trimmed(F.regexp_replace("t", "^[^=]*=", ""))
    rows = rows.withColumns({"key": F.when(F.contains("t", F.lit("=")), key), "value": value})
    section = rows.groupBy("path", "sec").agg(F.max((F.lower("t") == "[peer]").cast("int")).alias("is_peer"), F.max("peer_no").alias("peer_no"), F.max_by(F.when(F.col("key") == "AllowedIPs", F.col("value")), F.when(F.col("key") == "AllowedIPs", F.col("line"))).alias("allowed"))
    found = rows.filter(F.col("key").isin("PrivateKey", "PresharedKey") & (F.col("value") != "")).drop("peer_no").join(section, ["path", "sec"])
    name = F.coalesce(F.nullif(T.trimmed(F.substring_index("allowed", ",", 1)), F.lit("")), F.concat(F.lit("#"), F.col("peer_no").cast("string")))
    prefix = F.when(F.col("is_peer") == 1, F.concat(F.lit("Peer("), name, F.lit(")."))).otherwise("")
    return found.select(F.concat(F.lit("wg:"), "path", F.lit("#"), prefix, "key").alias("location"), F.col("value").alias("secret"))


def extract_file(files: DataFrame) -> DataFrame:
    """A whole file is one secret, ASCII white space trimmed; empty files have none."""
    t = F.regexp_replace("content", r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")
    return files.select(F.concat(F.lit("file:"), "path").alias("location"), t.alias("secret")).filter("secret <> ''")
