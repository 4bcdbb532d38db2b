"""Many rules against each tried alone; reports, pruning and coverage; files that are written all or not at all."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.operators import audit, commits, known, rules
from vigil.plans import queries
from vigil.sources import redacted


@pytest.mark.parametrize(("pattern", "want"), [("abc", "abc"), (r"\bAb[0-9]+cde", "cde"), ("a|b", ""), ("(?i)Token = x*y", "token = "), ("ab(cd)e?f", "abcd"), ("[", ""), ("(ab|cd)efg", "efg"), ("é+abc", "abc"), ("a{3}bc", "bc"), ("(?:key)-\\d", "key-"), ("^$", "")])
def test_literals_of_patterns(pattern, want):
    assert rules.literal(pattern) == want


def test_many_rules_equal_each_alone(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    table = [(f"r{i}", rnd.choice([rf"\b{w}\b", rf"(?i){w.upper()} [a-z]", rf"{w}|{w}x", rf"^{w} w\d"])) for i, w in enumerate(words)] + [("any", "w[0-9]{3} w1"), ("same", "w1"), ("same", "w2")]
    lines = [(i, rnd.choice([None, "", " ".join(rnd.choice([str, str.upper])(rnd.choice(words)) for _ in range(rnd.randint(1, 12)))])) for i in range(300)]
    df = spark.createDataFrame(lines, "line int, text string")
    want = sorted((i, label) for i, t in lines if t is not None for label, p in table if re.search(p, t))
    assert sorted((r.line, r.label) for r in rules.rule_hits(df, table).collect()) == want and len(want) > 300
    assert sorted((r.line, r.label) for r in rules.rule_hits(df, table, few=1000).collect()) == want
    assert rules.rule_hits(df, []).count() == 0


def test_work_hardly_depends_on_the_number_of_rules(spark):
    """Of twenty thousand rules a line is tried against one."""
    table = [(f"r{i}", rf"\bname{i:06d}\b") for i in range(20_000)]
    lines = spark.range(2000).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("commit"), F.lit("f").alias("file"), F.lit(0).alias("line"), F.concat(F.lit("of name"), F.lpad((F.col("id") * 7).cast("string"), 6, "0"), F.lit(" only")).alias("text"))
    assert commits.denylist_hits(lines, table).count() == 2000


def test_only_public_repositories_are_held_against_the_list(spark):
    lines = spark.createDataFrame([("a", "c1", "f", 1, "the word"), ("b", "c2", "f", 1, "the word"), ("a", "t1", "(tag message)", 1, "a word too")], "repo string, commit string, file string, line int, text string")
    public = spark.createDataFrame([("a",), ("a",), ("z",)], "repo string")
    assert [tuple(r) for r in commits.denylist_hits(lines, [("w", "word")], public=public).collect()] == [("a", "w", 2, "c1 f;t1 (tag message)")]


def test_the_lines_of_every_repository_are_held_against_the_list(spark, tmp_path):
    docs = [(i, "call +1 (555) 555-0100\nnothing\nmail a.b@mail1.example") for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i,) for i in range(25)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    # An even repository may hold phones, an odd one addresses.
    want = {(f"acme/r{r}", ("phone", "email")[r % 2 == 0], 2, f"{r} f{r % 3};{r + 4} f{(r + 4) % 3}") for r in range(4)}
    assert set(map(tuple, queries.denylist_hits(spark, str(tmp_path)).collect())) == want


def test_pruning_goes_by_kind_and_pattern(spark):
    state = spark.createDataFrame([(x, "1", 5, True) for x in ("env:/a/x.env#K", "ini:/a/x.env#[s]", "env:/a/x.txt#K", "env:/b/y.env#K", "env:/c/z#K")], "location string, fp string, since long, exact boolean")
    now = spark.createDataFrame([("env:/c/z#K",), ("env:/c/z#K",)], "location string")
    unseen = spark.createDataFrame([(1, "env", "/a/*.env"), (2, "ini", "/b/*.env")], "ord int, kind string, pattern string")
    assert sorted(r.location for r in audit.prune_state(state, now, unseen).collect()) == ["env:/a/x.env#K", "env:/c/z#K"]


def test_accounts_are_covered_or_a_finding(spark):
    matched, found = spark.createDataFrame([(1, "/a/x")], "ord int, path string"), spark.createDataFrame([(1, "/a/x", "env:/a/x#K")], "ord int, path string, location string")
    shadow = spark.createDataFrame([("u:$y$h:19000:0",), ("v:*:1:0",), ("w:$y$h::",)], "value string")
    assert sorted(map(tuple, audit.coverage(matched, found, (9, shadow)).collect())) == [(1, 1, 1, ""), (9, 1, 2, "")]
    assert [r.subject for r in audit.findings(uncovered=audit.unreadable(spark, "/etc/shadow")).collect()] == ["shadow /etc/shadow"]


def test_reports_are_compared_by_their_digests(spark, tmp_path):
    rows = [("stale", "a", None, None, 400, True), ("stale", "b", None, None, 500, False), ("reused", "c", None, "p", None, None), ("reused", "c", None, "q", None, None)]
    report = lambda r: audit.finding_identity(spark.createDataFrame(r, "type string, subject string, label string, place string, days long, exact boolean"))
    reports = audit.Reports(spark, str(tmp_path))
    older = [(*r[:4], r[4] and r[4] + 9, r[5]) for r in reversed(rows)]
    for name, r in (("1", rows), ("2", older + older[:1]), ("3", rows[:1] + rows[2:]), ("4", rows[:3] + [("drift", "d", "x", "y", None, None)]), ("5", [])):
        reports.keep(report(r), name)
    assert reports.changed_kinds("1", "2") == [] and reports.changed("1", "2").count() == 0
    assert reports.changed_kinds("1", "3") == ["stale"] and [tuple(r)[1:] for r in reports.changed("1", "3").collect()] == [("stale", "b", "gone")]
    assert reports.changed_kinds("1", "4") == ["drift", "reused"] and sorted(r.change for r in reports.changed("1", "4").collect()) == ["gone", "new"]
    assert reports.changed("1", "5").count() == 4


def files_below(folder):
    return sorted(os.path.relpath(os.path.join(d, x), folder) for d, _, names in os.walk(folder) for x in names if not x.endswith(".crc"))


def test_changed_files_are_written_once(spark, tmp_path):
    rows = [("/in/a/x.txt", b"has secret-0123456", 1), ("/in/b.txt", b"plain", 0), ("file:/in/c/d/e", b"\x00\xff secret-0123456", 2)]
    needles = spark.createDataFrame([(b"secret-0123456", "cred-1")], "needle binary, label string")
    out = known.redact_rows(spark.createDataFrame([r[:2] for r in rows], "path string, content binary"), needles)
    for _ in range(2):  # a rerun puts the same files in the same places
        redacted.write_files(out, str(tmp_path / "out"), "/in")
        assert files_below(tmp_path / "out") == ["a/x.txt", "c/d/e"]
    assert (tmp_path / "out/c/d/e").read_bytes() == b"\x00\xff [REDACTED:cred-1]"


@pytest.mark.parametrize("path", ["/in/x.gz", "-", None, "/in/../../x"])
def test_what_is_no_plain_file_is_refused(spark, tmp_path, path):
    rows = spark.createDataFrame([(path, b"x", 0), ("/in/y", b"y", 1)], "path string, content binary, n_redacted long")
    with pytest.raises(ValueError, match="can't be rewritten"):
        redacted.write_files(rows, str(tmp_path / "out"), "/in")
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError, match="twice"):
        redacted.write_files(rows.filter("path = '/in/y'").union(rows.filter("path = '/in/y'")), str(tmp_path / "out"))


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    fails = F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.lit(b"x"))
    rows = spark.range(0, 8, 1, 4).select(F.concat(F.lit("/f"), F.col("id").cast("string")).alias("path"), fails.cast("binary").alias("content"), F.lit(1).cast("long").alias("n_redacted"))
    with pytest.raises(Exception, match="broken"):
        redacted.write_files(rows, str(tmp_path / "out"))
    assert files_below(tmp_path / "out") == []
