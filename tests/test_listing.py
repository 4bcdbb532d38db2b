"""Listing of the folders that rules name, and of no other."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from vigil.operators import audit
from vigil.sources import listing


@pytest.fixture()
def tree(tmp_path):
    for name in ("a/x.env", "a/y.env", "a/.env", "a/_z.env", "a/sub/x.env", "b/app.env", "b/other.txt", "c/x.env", "d e/ü*.env"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").mkdir()
    (tmp_path / "onlydir/x.env").mkdir(parents=True)
    os.symlink(tmp_path / "b/app.env", tmp_path / "a/link.env")
    return str(tmp_path)


def _rules(spark, *patterns):
    return spark.createDataFrame([(i, "env", p) for i, p in enumerate(patterns)], "ord int, kind string, pattern string")


def test_rules_match_what_is_listed(spark, tree):
    rules = _rules(spark, "/a/*.env", "/b/app.env", "/b/*", "/a/none*", "/empty/*", "/absent/*", "/onlydir/*", "/b/app.env/*", "/d e/*.env", "noslash")
    matched, folders = listing.listed(rules, tree)
    got = {}
    for r in matched.collect():
        got.setdefault(r.ord, set()).add((r.path, r.size))
    assert got[0] == {("/a/x.env", 7), ("/a/y.env", 7), ("/a/.env", 6), ("/a/_z.env", 8), ("/a/link.env", 9)}
    assert got[1] == {("/b/app.env", 9)} and got[2] == {("/b/app.env", 9), ("/b/other.txt", 11)} and {p for p, _ in got[8]} == {"/d e/ü*.env"}
    assert set(got) == {0, 1, 2, 8}
    # Empty, absent, or a file: out of sight. A folder with other things in it could be looked at.
    assert {r.path for r in folders.collect()} == {"/a", "/b", "/onlydir", "/d e"}
    assert {r.ord: r.could_look for r in audit.uncovered(rules, matched, folders).collect()} == {3: True, 4: False, 5: False, 6: True, 7: False, 9: False}


def test_no_rules(spark, tree):
    matched, folders = listing.listed(_rules(spark, "/a/*").limit(0), tree)
    assert matched.count() == 0 and folders.count() == 0


def test_only_named_folders_are_listed(spark, tree, monkeypatch):
    reader = listing.ListingReader({"path": tree})
    left = list(reader.pushFilters([In(("folder",), ("/a", "/b", None)), GreaterThan(("size",), 3), EqualTo(("folder",), "/a")]))
    assert left == [GreaterThan(("size",), 3)] and [p.names for p in reader.partitions()] == [["/a"]]
    asked = []
    real = listing.fs.FileSelector
    monkeypatch.setattr(listing.fs, "FileSelector", lambda name, **kw: asked.append(name) or real(name, **kw))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert asked == [f"{tree}/a"] and {r["path"] for r in rows} == {None, "/a/x.env", "/a/y.env", "/a/.env", "/a/_z.env", "/a/link.env"}


def test_a_listing_without_folders_is_an_error(spark, tree):
    with pytest.raises(Exception, match="filter by folder"):
        listing.read_listing(spark, tree).count()


def test_folders_are_spread_and_long_ones_come_in_batches(spark, tree, monkeypatch):
    reader = listing.ListingReader({"path": tree})
    assert list(reader.pushFilters([In(("folder",), tuple(f"/{i}" for i in range(100)))])) == [] and len(reader.partitions()) == 7
    monkeypatch.setattr(listing, "ROWS", 2)
    batches = list(reader.read(listing.Folders(["/a"])))
    assert [b.num_rows for b in batches] == [2, 2, 2]
    plan = listing.read_listing(spark, tree).filter(F.col("folder").isin("/a", "/b"))
    assert plan.rdd.getNumPartitions() == 1 and plan.filter("path is not null").count() == 7
