"""Every registered query with SQL against an independent engine, and fixtures of the operators' finer rules."""

import hashlib
import hmac
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vigil.functions import text as T
from vigil.functions.fingerprint import Fingerprinter
from vigil.operators import audit, commands, commits, extract, known, transcripts
from vigil.plans import queries
from vigil.sources import readers
from vigil.streaming import state

SF = "/root/testdata/sf0.001"
PEPPER = b"p" * 32


def normal(rows):
    return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "nation customer supplier orders lineitem events documents pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {quoted} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert normal(tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == normal(want)


def test_fingerprints_are_keyed(spark):
    p = Fingerprinter(spark, PEPPER)
    row = spark.createDataFrame([("hunter-two",)], "s string").select(p.fp(F.col("s")).alias("fp")).withColumn("label", p.label(F.col("fp"))).first()
    assert row.fp == hmac.new(PEPPER, b"fp\0hunter-two", hashlib.sha256).hexdigest()
    assert row.label == "cred-" + hmac.new(PEPPER, b"label\0" + row.fp.encode(), hashlib.sha256).hexdigest()[:6]
    with pytest.raises(ValueError):
        Fingerprinter(spark, b"short")


ENV = ["# TOKEN=abcdefghij", "APP_USER=somebodyelse", 'DB_PASSWORD="quoted value"', "export API_TOKEN=exported-1", "PORT_KEY=123", "S_KEY=${OTHER}", "EMAIL: a@b.c", "PASSWORD: colon-value", "TIGHT_TOKEN:abcdefghijk", "text PASSWORD=abcdefghi", "= abcdefghij", "URL=https://u:p@ss/word@h/x", "API_TOKEN=last-value", "export =abcdefghi", "AT_URL=https://u:longpass@x@h/y", "MY_URL=https://user:secret9!@host/"]


def test_env_lines(spark):
    got = {r.location: r.secret for r in extract.extract_env(spark.createDataFrame([("f", i, t) for i, t in enumerate(ENV)], "path string, line int, text string")).collect()}
    assert got == {"env:f#DB_PASSWORD": "quoted value", "env:f#API_TOKEN": "last-value", "env:f#PASSWORD": "colon-value", "env:f#AT_URL": "longpass@x", "env:f#MY_URL": "secret9!"}


def test_wg_sections(spark):
    body = "[Interface]\nPrivateKey = aaaa=\n[Peer]\nPresharedKey = b\nAllowedIPs = 10.0.0.9/32\nAllowedIPs = 10.0.0.2/32, ::1\n[Peer]\nPresharedKey=c"
    lines = spark.createDataFrame([("w", i, t) for i, t in enumerate(body.split("\n"))], "path string, line int, text string")
    assert {(r.location, r.secret) for r in extract.extract_wg(lines).collect()} == {("wg:w#PrivateKey", "aaaa="), ("wg:w#Peer(10.0.0.2/32).PresharedKey", "b"), ("wg:w#Peer(#2).PresharedKey", "c")}


def test_known_forms_are_found_and_redacted(spark):
    import base64
    from urllib.parse import quote

    secret = 'p&ss/"word\\ 9x!'
    needles = known.dictionary(spark.createDataFrame([(secret, "cred-1"), ("1234567", "short"), ("operation", "weak")], "secret string, label string"))
    hay = [(0, f"x {secret} y"), (1, "k " + quote(secret, safe="")), (2, '"' + secret.replace("\\", "\\\\").replace('"', '\\"') + '"'), (3, "operation 1234567"), (4, None), (5, f"{secret} and {secret}")]
    hay += [(6 + n, base64.b64encode(b"user:1234"[:n] + secret.encode() + b"zz").decode()) for n in range(3)]
    files = spark.createDataFrame(hay, "path long, content string")
    for part in (100_000, 3):
        spans = known.merge_hits(known.find_known(files, needles, part))
        assert {(r.path, r.n) for r in known.count_known(spans).collect()} == {(0, 1), (1, 1), (2, 1), (5, 2), (6, 1), (7, 1), (8, 1)}
    out = {r.path: bytes(r.content).decode() for r in known.redact(files, spans).collect()}
    assert out[5] == "[REDACTED:cred-1] and [REDACTED:cred-1]" and 3 not in out
    assert known.find_known(known.redact(files, spans), needles).count() == 0


def test_matcher_equals_brute_force():
    rnd = random.Random(3)
    needles = [(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(8, 12))), str(i)) for i in range(40)]
    data = bytes(rnd.choice(b"ab") for _ in range(3000))
    longest = {}
    for i in range(len(data)):
        fits = [n for n, _ in needles if data.startswith(n, i)]
        if fits:
            longest[i] = max(map(len, fits))
    assert {i: n for i, n, _ in known.Matcher(needles).find(data)} == longest


def test_added_lines(spark):
    patch = "subject\n\nbody\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+one\n-gone\n+++ b/y\n+two"
    got = [(r.file, r.text) for r in commits.added_lines(spark.createDataFrame([("c1", patch)], "commit string, patch string")).orderBy("line").collect()]
    assert got == [("(commit message)", "subject"), ("(commit message)", ""), ("(commit message)", "body"), ("x", "one"), ("y", "two")]


def test_observe_and_prune(spark):
    old = spark.createDataFrame([("a", "1", 1000, False), ("b", "1", 1000, False), ("env:gone#K", "9", 5, True)], "location string, fp string, since long, exact boolean")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "location string, fp string")
    got = {r.location: (r.since, r.exact) for r in audit.observe(old, now, F.lit(5000).cast("long")).collect()}
    assert got == {"a": (1000, False), "b": (5000, True), "c": (5000, False)}
    unseen = spark.createDataFrame([(1, "env", "gone")], "ord int, kind string, pattern string")
    assert audit.prune_state(old, now, unseen).count() == 3 and audit.prune_state(old, now, unseen.limit(0)).count() == 2


def test_observe_stream_equals_batch(spark, tmp_path):
    scans = [("a", "1", 10), ("a", "1", 20), ("a", "2", 30), ("b", "1", 10)]
    spark.createDataFrame(scans, "location string, fp string, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("location string, fp string, at long").parquet(str(tmp_path / "in"))
    run = state.observe_stream(stream).writeStream.format("memory").queryName("seen").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.location, r.fp, r.since, r.exact) for r in spark.table("seen").collect()} == {("a", "2", 30, True), ("b", "1", 10, False)}


def test_echoed_after_pasted(spark):
    hits = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "x"), (2, 1, "assistant", "x"), (2, 2, "user", "x")], "conv_id long, turn long, role string, label string")
    assert [tuple(r) for r in transcripts.echoed_secrets(hits).collect()] == [(1, "x", 0, 1)]


def test_word_like(spark):
    words = ["sunshine", "12345678901", "qzxkvbnmtrw", "Mixed", "operation"]
    got = spark.createDataFrame([(w,) for w in words], "s string").select(T.word_like(F.col("s"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, True]


DENIED = ["rm ~/.git?onfig", "cp x /root/.config/git/con[f]ig", "cp x sub/.git/c*", "tee /etc/vigil/allow", "dd if=a of=.git/config", "perl -pi -e 1 .git/config", "install new/gitconfig /etc/", "cp config .git", "git config --unset core.hooksPath", "git config --get --unset core.hooksPath", "GIT_CONFIG_KEY_0=core.hooksPath git push", "gh api -X PATCH repos/a/b -f private=false", "gh api user/repos -f name=x", "gh api -X PATCH repos/a/b --input f", "git push --no-ver$X"]
ALLOWED = ["rm 'a*b'", "sed -n s/.git*/x/p f", "ls /etc/git*", "cp .git/config backup", "rm /etc/git*/x", "rm ~/*", "git config --file x --get core.hooksPath", "gh api user/repos -f private=true", "gh api -X GET repos/a/b/contents/x -f ref=1", "rm [z-a", "echo > [", "git log --since=$D"]


def test_verdicts_of_writes(spark):
    rows = [*((c, "deny") for c in DENIED), *((c, "allow") for c in ALLOWED), (None, "allow"), ("", "allow")]
    table = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(rows)], "cmd_id int, command string")
    got = {r.cmd_id: r.verdict for r in commands.command_verdict(table, spark.createDataFrame([("a/b",)], "repo string")).collect()}
    assert [(c, got[i]) for i, (c, _) in enumerate(rows)] == rows


def test_guarded_edits(spark):
    lines = spark.createDataFrame([('{"tool_input": {"file_path": "/etc/vigil/allow"}}',), ('{"tool_input": {"file_path": "/etc/vigilant"}}',), ("no json",), ('{"tool_input": {"command": "ls"}}',)], "value string")
    assert [r.file_path for r in commands.guarded_edits(readers.read_tool_calls(lines)).collect()] == ["/etc/vigil/allow"]


def test_corpus_with_gz(spark, tmp_path):
    import gzip

    (tmp_path / "in" / "deep").mkdir(parents=True)
    whole = b"one\r\ntwo\xff\n"
    for name in ("a.txt", "z", "gz", "agz", "a.z"):
        (tmp_path / "in" / name).write_bytes(whole)
    (tmp_path / "in" / "deep" / "b.txt.gz").write_bytes(gzip.compress(whole) + gzip.compress(b"more"))
    got = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in readers.read_corpus(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": whole, "z": whole, "gz": whole, "agz": whole, "a.z": whole, "b.txt.gz": whole + b"more"}


def test_rows_redacted_in_one_pass(spark):
    needles = known.dictionary(spark.createDataFrame([("abcd1234efgh", "cred-1"), ("efgh5678ijkl", "cred-2")], "secret string, label string"))
    rows = spark.createDataFrame([(0, "x abcd1234efgh5678ijkl y"), (1, "abcd1234efghabcd1234efgh"), (2, None), (3, ""), (4, "plain")], "path int, content string")
    got = {r.path: (r.content if r.content is None else bytes(r.content).decode(), r.n_redacted) for r in known.redact_rows(rows, needles).collect()}
    assert got == {0: ("x [REDACTED:cred-1] y", 1), 1: ("[REDACTED:cred-1][REDACTED:cred-1]", 2), 2: (None, 0), 3: ("", 0), 4: ("plain", 0)}
    assert known.leaks(rows, needles).count() == 3 and known.leaks(known.redact_rows(rows, needles), needles).count() == 0


def test_search_waits_for_its_sources(spark):
    rules = spark.createDataFrame([(1, "env", "/a/*.env"), (2, "env", "/b/x.env")], "ord int, kind string, pattern string")
    files = spark.createDataFrame([("/a/one.env",)], "path string")
    with pytest.raises(ValueError, match="1 of 2"):
        audit.require_covered(rules, audit.match_sources(rules, files))
    audit.require_covered(rules.filter("ord = 1"), audit.match_sources(rules, files))


def test_age_leaves_a_finding_the_same(spark):
    rows = [("a", 200, True), ("a", 201, True), ("a", 201, False)]
    stale = audit.findings(stale=spark.createDataFrame(rows, "subject string, days int, exact boolean"))
    got = {(r.days, r.exact): r.identity for r in audit.finding_identity(stale).collect()}
    assert got[200, True] == got[201, True] != got[201, False]
    assert {r.line for r in audit.report_lines(stale, 180).collect()} == {"a rotated 200 days ago (limit 180)", "a rotated 201 days ago (limit 180)", "a unchanged for 201 days or more (limit 180)"}


def test_tags_and_head_licence(spark):
    tags = spark.createDataFrame([(1, "a1", None, "tag", "h\n\nm\n\nn"), (1, "a2", "a2", "tag", "h\n\nm"), (1, "0000", "a3", "tag", "h\n\nm"), (1, "a4", "b", "commit", "h\n\nm"), (1, "a5", "b", "tag", "no blank")], "push_id int, sha string, remote_sha string, kind string, body string")
    assert {(r.sha, r.message) for r in commits.outgoing_tags(tags).collect()} == {("a1", "m\n\nn"), ("a5", "")}
    files = spark.createDataFrame([("r", "LICENSE", "permissive"), ("r", "b/COPYING", "x\n  11. Patents."), ("r", "c/LICENCE", "Grant of Patent License"), ("s", "README", "Grant of Patent License"), ("t", "LICENSE", None)], "repo string, path string, text string")
    assert [tuple(r) for r in commits.head_licence_grant(files).collect()] == [("r", "b/COPYING", "GPL/AGPL-3.0 section 11")]


def test_dates(spark):
    got = spark.createDataFrame([(0,), (951782400,), (1790208000,), (-1,)], "t long").select(T.utc_date(F.col("t"))).collect()
    assert [r[0] for r in got] == ["1970-01-01", "2000-02-29", "2026-09-24", "1969-12-31"]


def test_declared_copies_are_not_reused_and_all_places_are_listed(spark):
    found = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x2"), ("b", "y"), ("b", "z"), ("c", "w")], "fp string, location string")
    same = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x2"), (2, "y")], "group_id long, location string")
    assert [(r.fp, r.n_locations, r.first_location) for r in audit.reused(found, same).collect()] == [("b", 3, "x2")]
    assert sorted((r.fp, r.location) for r in audit.reused_places(found, same).collect()) == [("b", "x2"), ("b", "y"), ("b", "z")]
    assert [tuple(r) for r in audit.declared(found, same).collect()] == [("a", 1)]


def test_places_under_an_unseen_source_are_not_missing(spark):
    found = spark.createDataFrame([("env:/a/x.env#K",)], "location string")
    same = spark.createDataFrame([(1, "env:/a/x.env#K"), (1, "env:/b/y.env#K"), (1, "ini:/b/y.env#K"), (1, "file:/c")], "group_id long, location string")
    unseen = spark.createDataFrame([(1, "env", "/b/*.env")], "ord int, kind string, pattern string")
    assert sorted(r.location for r in audit.missing(found, same, unseen).collect()) == ["file:/c", "ini:/b/y.env#K"]


@pytest.mark.parametrize(("url", "slug", "visibility"), [("../mirror", "../mirror", "private"), ("file:///srv/x", "file:///srv/x", "private"), ("https://user@github.com/A/b", "a/b", "public"), ("git@github.com:a/b.git/", "a/b", "public"), ("https://github.com/a/unknown", "a/unknown", None), ("https://git.example/a", "https://git.example/a", "public"), ("./pub", "./pub", "public")])
def test_destinations(spark, url, slug, visibility):
    vis = spark.createDataFrame([("a/b", "public")], "slug string, visibility string")
    got = commits.classify_destination(spark.createDataFrame([(1, url)], "push_id int, url string"), vis, ("./pub",)).first()
    assert (got.slug, got.visibility) == (slug, visibility)


def test_control_characters_in_json_form(spark):
    import json

    values = ["plain secret", 'a"b\\c\n\t\r', "x\x00\x01\x1f\x0b y", "é/ok"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(T.form_json(F.col("v"))).collect()]
    assert got == [json.dumps(v, ensure_ascii=False)[1:-1].replace("\\b", "\\u0008").replace("\\f", "\\u000c") for v in values]
