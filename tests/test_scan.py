"""Blocked scans against plain windows, and the operators that use them on one long document."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigil.operators import commits, extract, known, scan


@pytest.mark.parametrize("before", [False, True])
def test_equals_the_plain_window(spark, before):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, rnd.randint(0, 99)])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc string, line int, v int").repartition(7)
    w = W.partitionBy("doc").orderBy("line").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    want = df.select("doc", "line", "v", F.max("v").over(w), F.sum("v").over(w), F.last("v", ignorenulls=True).over(w))
    for block in (1, 7, 5000):
        got = scan.running(df, ["doc"], "line", ["line"], before=before, block=block, top=("max", F.col("v")), all=("sum", F.col("v")), near=("last", F.col("v")))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_spans_of_one_long_document(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 50)
    rnd = random.Random(2)
    hits = sorted((rnd.choice(["p", "q"]), rnd.randint(0, 6000), rnd.choice([8, 9, 30, 700]), f"c{i}") for i in range(400))
    want, open_ = [], {}
    for path, start, n, label in hits:
        at = open_.get(path)
        if at and start < at[2]:
            at[2] = max(at[2], start + n)
        else:
            open_[path] = [path, start, start + n, label]
            want.append(open_[path])
    got = known.merge_hits(spark.createDataFrame(hits, "path string, start long, len long, label string"))
    assert sorted(map(tuple, got.collect())) == sorted((p, s, e - s, x) for p, s, e, x in want)


def test_sections_headers_and_files_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 3)
    ini = [("[a]" if i == 0 else "[b]" if i == 31 else f"password = secret-{i}") for i in range(50)]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(ini)], "path string, line int, text string")
    assert {(r.location, r.line) for r in extract.extract_ini(lines).collect()} == {(f"ini:f#[{'a' if i < 31 else 'b'}]", i) for i in range(50) if i not in (0, 31)}
    wg = ["[Interface]", "PrivateKey=k0", *["# x"] * 9, "[Peer]", "PresharedKey=k1", *["# x"] * 9, "AllowedIPs=10.0.0.2/32, ::1", "[Peer]", *["# y"] * 7, "PresharedKey=k2"]
    lines = spark.createDataFrame([("w", i, t) for i, t in enumerate(wg)], "path string, line int, text string")
    assert {r.location for r in extract.extract_wg(lines).collect()} == {"wg:w#PrivateKey", "wg:w#Peer(10.0.0.2/32).PresharedKey", "wg:w#Peer(#2).PresharedKey"}
    log = [("d", i, "commit ab" if i == 1 else "tag cd" if i == 20 else "x", i % 5 == 0) for i in range(40)]
    got = commits.attribute_hits(spark.createDataFrame(log, "doc string, line int, text string, hit boolean"))
    assert {(r.line, r.sha) for r in got.collect()} == {(i, None if i < 1 else "ab" if i < 20 else "cd") for i in range(0, 40, 5) if i != 20} | {(20, "cd")}
    patch = "\n".join(["subject", "diff --git a/x b/x", "+++ b/x", *["+one"] * 10, "+++ b/y", "+two"])
    tags = spark.createDataFrame([("t1", "release\nnotes")], "sha string, message string")
    got = commits.added_lines(spark.createDataFrame([("c", patch)], "commit string, patch string"), tags).collect()
    assert sorted((r.commit, r.file, r.text) for r in got) == sorted([("c", "(commit message)", "subject"), *[("c", "x", "one")] * 10, ("c", "y", "two"), ("t1", "(tag message)", "release"), ("t1", "(tag message)", "notes")])


def test_one_document_is_many_tasks(spark):
    """Every window is over one block, or over the blocks of a document."""
    hits = spark.range(1 << 18).select(F.concat(F.lit("p"), F.col("id") % 2).alias("path"), (F.col("id") * 10).alias("start"), F.lit(22).cast("long").alias("len"), F.lit("c").alias("label"))
    merged = known.merge_hits(hits)
    assert merged.count() == 2
    windows = [x for x in merged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all(re.search(r"windowspecdefinition\(path#\d+, _block#", x) for x in windows)
