"""State kept by a stream, pruned at the end of each scan, against the batch operator and a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import audit
from vigil.streaming import pruned, state


def _run(spark, tmp_path, batches, buckets=4):
    """Each batch arrives as one file and is processed by a run of its own, from the checkpoint of the last one."""
    updates = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, pruned.SCANS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
        with pruned.rocksdb(spark):
            updates = state.run_available(pruned.pruned_stream(stream, buckets), str(tmp_path / "run"), "update")
    return updates


def _end(began, at, *unseen):
    return (None, None, at, began, list(unseen))


def _final(updates):
    return {r.location: (r.fp, r.since, r.exact) for r in state.latest_per_location(updates).filter("not gone").collect()}


def test_three_scans_with_a_source_gone_and_one_unseen(spark, tmp_path):
    rnd = random.Random(7)
    unseen = [("env", "/u/*.env"), ("ini", "/g/*.env"), ("env", "/h/1*.env")]
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(unseen)], "ord int, kind string, pattern string")
    want, batch, before = [], [], spark.createDataFrame([], "location string, fp string, since long, exact boolean")
    for scan in range(3):
        at = 1000 * (scan + 1)
        places = [f"env:/{d}/{i}.env#K" for d in "abguh" for i in range(12) if not (d in "uh" and scan >= 1) and not (d == "g" and scan == 1)]
        seen = [(p, f"fp{rnd.randrange(3)}") for p in places]
        rows = [(p, fp, at, None, None) for p, fp in seen]
        rnd.shuffle(rows)
        batch.append([*rows, _end(at, at + 5, *unseen)])
        now = spark.createDataFrame(seen, "location string, fp string")
        after = audit.observe(before, now, F.lit(at).cast("long"))
        lost = audit.prune_state(before, now, rules).join(now.select("location"), "location", "left_anti")
        want = {r.location: (r.fp, r.since, r.exact) for r in after.unionByName(lost).collect()}
        before = spark.createDataFrame([(k, *v) for k, v in want.items()], before.schema)
    updates = _run(spark, tmp_path, batch)
    assert _final(updates) == want
    assert {r.location: (r.fp, r.since, r.exact) for r in pruned.kept(spark, str(tmp_path / "run/checkpoint")).collect()} == want
    # Unseen by kind and pattern: of /h only names that begin with 1, of /g (wrong kind) nothing older than its return.
    assert sum(p.startswith("env:/u/") for p in want) == 12 and {p[7] for p in want if p.startswith("env:/h/")} == {"1"}
    assert all(not v[2] and v[1] == 3000 for p, v in want.items() if p.startswith("env:/g/"))


def test_odd_rows(spark, tmp_path):
    batches = [
        # An end before its scan's rows in the file, two fingerprints at one place, a row twice, nulls.
        [_end(1, 10, ("env", None), (None, "/*")), ("env:/a#K", "1", 5, None, None), ("env:/a#K", "1", 5, None, None), ("env:/a#K", "2", 6, None, None), ("env:/b#K", None, 5, None, None), ("env:/c#K", "1", None, None, None), (None, None, 7, None, None), ("", "9", 8, None, None)],
        # Late rows and an end that comes again change nothing; the next scan has begun without an end.
        [("env:/d#K", "1", 9, None, None), ("env:/a#K", "3", 10, None, None), _end(11, 10, (None, "/x"), ("env", None)), ("env:/e#K", "1", 12, None, None)],
        # The end of a scan that saw nothing more, with null for no rules.
        [(None, None, 20, 11, None)],
    ]
    updates = _run(spark, tmp_path, batches, 2)
    assert {(r.location, r.batch): (r.fp, r.since, r.exact, r.gone) for r in updates.collect()} == {
        ("env:/a#K", 0): ("2", 6, True, False), ("", 0): ("9", 8, False, False), ("env:/e#K", 1): ("1", 12, False, False), ("env:/a#K", 2): ("2", 6, True, True), ("", 2): ("9", 8, False, True),
    }
    assert _final(updates) == {"env:/e#K": ("1", 12, False)}


@pytest.mark.parametrize("pattern", ["/d/*.env", "/d/a*.env", "/d/a.env", "/d/ab*ab.env", "/d/*", "/e/*.env", "/d/.env*x"])
def test_rules_as_the_batch_operator_reads_them(spark, pattern):
    places = [f"{k}:/d/{n}#K" for k in ("env", "ini") for n in ("a.env", "ab.env", "abab.env", ".env", "a#b.env")] + ["env:/d/sub/a.env#K", "x", ""]
    rules = spark.createDataFrame([(1, "env", pattern)], "ord int, kind string, pattern string")
    got = audit.under_unseen(spark.createDataFrame([(p,) for p in places], "location string"), rules)
    assert sorted(r.location for r in got.collect()) == sorted(p for p in places if pruned.Unseen([("env", pattern)]).holds(p))
