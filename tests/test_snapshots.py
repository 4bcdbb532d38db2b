"""Snapshots of the state: buckets, marks, and several scans against a plain walk."""

import random

from pyspark.sql import functions as F

from vigil.sources.snapshots import Snapshots


def test_scans_with_a_source_gone_and_one_unseen(spark, tmp_path):
    rnd = random.Random(4)
    store = Snapshots(spark, str(tmp_path), 4)
    assert store.latest().count() == 0
    unseen = spark.createDataFrame([(1, "env", "/u/*.env"), (2, "ini", "/g/*.env")], "ord int, kind string, pattern string")
    want = {}
    for scan in range(4):
        at = 1000 * (scan + 1)
        places = [f"env:/{d}/{i}.env#K" for d in "abgu" for i in range(12) if not (d == "u" and scan >= 2) and not (d == "g" and scan >= 1)]
        seen = {p: f"fp{rnd.randrange(3)}" for p in places}
        before, want = want, {}
        for p, fp in seen.items():
            old = before.get(p)
            want[p] = (fp, at, False) if old is None else old if old[0] == fp else (fp, at, True)
        want |= {p: v for p, v in before.items() if p not in seen and p.startswith("env:/u/")}
        now = spark.createDataFrame(list(seen.items()), "location string, fp string")
        store.save(store.observe(now, F.lit(at).cast("long"), unseen), f"{scan:04d}")
        assert {r.location: (r.fp, r.since, r.exact) for r in store.latest().collect()} == want
    assert any(p.startswith("env:/u/") for p in want) and not any(p.startswith("env:/g/") for p in want)


def test_a_scan_that_broke_off_is_not_taken(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), 4)
    one = spark.createDataFrame([("env:/a#K", "1", 5, False)], "location string, fp string, since long, exact boolean")
    store.save(one, "0001")
    store.save(one.withColumn("fp", F.lit("2")), "0002", complete=False)
    assert [r.fp for r in store.latest().collect()] == ["1"]
    store.save(one.withColumn("fp", F.lit("3")), "0002")
    store.save(one.withColumn("fp", F.lit("3")), "0002")
    assert [r.fp for r in Snapshots(spark, str(tmp_path)).latest().collect()] == ["3"]


def test_only_the_scan_is_shuffled(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), 4)
    many = spark.range(5000).select(F.concat(F.lit("env:/a/"), F.col("id").cast("string"), F.lit("#K")).alias("location"), F.lit("1").alias("fp"), F.col("id").alias("since"), F.lit(True).alias("exact"))
    store.save(many, "1")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = store.observe(many.select("location", F.when(F.col("since") < 9, "2").otherwise("1").alias("fp")), F.lit(7).cast("long"))
        assert after.filter("since = 7 and exact").count() == 9
        plan = after._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(location") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
