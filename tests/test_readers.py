"""Readers and writers on small files, and tables that are folders."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from vigil.plans import queries
from vigil.sources import readers
from vigil.streaming import state

#: The smallest tables hold no known token.
SF = "/root/testdata/sf0.01"


def test_source_rules(spark, tmp_path):
    path = tmp_path / "rules"
    path.write_text("# places\n\nenv /srv/*/app.env\n  ini /etc/pbx.conf \nsame a b c\nstale-days 30\nshadow /etc/shadow\nstale-days 90\n")
    rules, same, days, shadow = readers.source_rules(spark, str(path))
    assert [tuple(r) for r in rules.orderBy("ord").collect()] == [(3, "env", "/srv/*/app.env"), (4, "ini", "/etc/pbx.conf")]
    assert sorted(map(tuple, same.collect())) == [(5, "a"), (5, "b"), (5, "c")]
    assert (days, shadow) == (90, "/etc/shadow")


@pytest.mark.parametrize("bad", ["env", "env a b", "stale-days x", "same a", "shadow", "other /x"])
def test_a_bad_rule_is_an_error_with_its_line(spark, tmp_path, bad):
    path = tmp_path / "rules"
    path.write_text(f"env /a\n\n{bad}\nalso bad\n")
    with pytest.raises(ValueError, match="line 3"):
        readers.source_rules(spark, str(path))


def test_rules_have_defaults(spark, tmp_path):
    (tmp_path / "rules").write_text("# nothing\n")
    rules, same, days, shadow = readers.source_rules(spark, str(tmp_path / "rules"))
    assert (rules.count(), same.count(), days, shadow) == (0, 0, 180, None)


def test_state_file(spark, tmp_path):
    fp, other = "a" * 64, "b" * 64
    (tmp_path / "state").write_text(f"x\t{fp}\t5\ttrue\nx\t{other}\t6\tfalse\nshort\tabc\t5\ttrue\ny\t{fp}\tno\ttrue\nz\t{fp}\t7\tmaybe\nw\t{fp}\t8\ttrue\n")
    assert sorted(map(tuple, readers.read_state(spark, str(tmp_path / "state")).collect())) == [("w", fp, 8, True), ("x", other, 6, False)]


def test_the_last_snapshot_of_the_state_counts(spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    for scan, fp in (("2024-01-01", "old"), ("2024-01-02", "new")):
        readers.write_state(spark.createDataFrame([("x", fp, 5, True, "more")], readers.STATE + ", more string"), folder, scan)
    assert [tuple(r) for r in readers.latest_state(spark, folder).collect()] == [("x", "new", 5, True)]


def test_lists(spark, tmp_path):
    (tmp_path / "deny").write_text("# label\tregex\nname\tJane .*\tDoe\nbroken\n\tnolabel\nhost\tdb[0-9]+\n")
    assert readers.read_denylist(spark, str(tmp_path / "deny")) == [("name", "Jane .*\tDoe"), ("host", "db[0-9]+")]
    (tmp_path / "allow").write_text("Acme/Site # public\n\n# none\nacme/site\nacme/docs\n")
    assert sorted(r.repo for r in readers.read_allowlist(spark, str(tmp_path / "allow")).collect()) == ["acme/docs", "acme/site"]


def test_lines_of_valid_files_only(spark):
    files = spark.createDataFrame([("a", b"one\r\ntwo"), ("b", b"\xff\xfe")], "path string, content binary")
    assert sorted(map(tuple, readers.config_lines(files).collect())) == [("a", 0, "one"), ("a", 1, "two")]


def test_outputs_are_written(spark, tmp_path):
    readers.write_findings(spark.createDataFrame([("reused", "cred-1")], "type string, subject string"), str(tmp_path / "f"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "f")).select("type", "subject").collect()] == [("reused", "cred-1")]
    copy = spark.createDataFrame([("a", b"clean")], "path string, content binary")
    readers.write_redacted(copy, str(tmp_path / "r"))
    assert [r.path for r in spark.read.parquet(str(tmp_path / "r")).collect()] == ["a"]
    with pytest.raises(Exception, match="(?i)exists"):
        readers.write_redacted(copy, str(tmp_path / "r"))


def test_access_counts_of_a_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    rows = [("get", "a", 1), ("get", "a", 5), ("put", "a", 2)]
    (tmp_path / "log" / "1.json").write_text("".join(json.dumps(dict(zip(("verb", "name", "ts"), r, strict=True))) + "\n" for r in rows))
    log = spark.readStream.schema("verb string, name string, ts long").json(str(tmp_path / "log"))
    out = state.run_available(state.access_counts(log), str(tmp_path / "out"), "update")
    assert sorted(map(tuple, out.select("name", "verb", "n", "last").collect())) == [("a", "get", 2, 5), ("a", "put", 1, 2)]


def test_streams_of_tables_that_are_folders(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.redact_appended(spark, str(tmp_path)).select("path", "n_redacted", "n_bytes")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT path, n_redacted, n_bytes FROM ({queries.ORACLE_SQL['redact_appended']})").fetchall())
    assert got.filter(F.col("n_redacted") > 0).count() > 0
