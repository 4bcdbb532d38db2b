"""Search with large dictionaries and in huge files, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import known, needle_filter
from vigil.sources.ranges import read_ranges


def brute(texts, needles):
    """At every place the longest needle, found by a table for each length."""
    lengths, out = sorted({len(n) for n, _ in needles}), {}
    by = {n: label for n, label in sorted(needles, reverse=True)}
    for path, data in texts:
        for i in range(len(data) - 7):
            for n in lengths:
                if i + n <= len(data) and data[i : i + n] in by:
                    out[path, i] = (n, by[data[i : i + n]])
    return {(p, i, *v) for (p, i), v in out.items()}


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("most_bits", [needle_filter.MOST_BITS, 1 << 10])
def test_very_many_needles_of_one_prefix(spark, most_bits):
    """The small filter lets nearly everything through; the result stays."""
    rnd = random.Random(5)
    n = 40_000 if most_bits > 1 << 10 else 2000
    needles = [(f"sameprefix{i:x}".encode(), f"c{i}") for i in range(n)] + [(f"{i:08x}tail".encode(), f"d{i}") for i in range(500)] + [(bytes(rnd.randrange(256) for _ in range(rnd.choice([8, 9, 40]))), f"b{i}") for i in range(200)]
    needles = list({a: b for a, b in needles}.items())
    texts = [("t1", b" ".join(rnd.choice([f"sameprefix{rnd.randrange(n * 2):x}".encode(), rnd.choice(needles)[0], b"same", b"x" * 30]) for _ in range(500))), ("t2", b"sameprefi"), ("t3", needles[-1][0]), ("t4", b""), ("t5", b"short")]
    texts += [(f"u{i}", rnd.choice(needles)[0][1:] + rnd.choice(needles)[0]) for i in range(60)]
    files = spark.createDataFrame([*texts, ("null", None)], "path string, content binary").repartition(3)
    got = found(known.find_known(files, spark.createDataFrame(needles, "needle binary, label string"), most_bits))
    assert got == brute(texts, needles) and len(got) > 300


def test_the_filter_lets_little_else_through():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 1 << 63, 5000).astype(np.uint64)
    bits = np.zeros(1 << 11, np.uint64)
    for at in needle_filter.Filter.slots(words, len(bits)):
        np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    f = needle_filter.Filter(bits, np.array([8]), b"k" * 32)
    assert len(f.may_hold(words)) == len(words) and len(f.may_hold(rnd.integers(0, 1 << 63, 100_000).astype(np.uint64))) < 1500


def test_ranges_of_huge_files_equal_whole_ones(spark, tmp_path):
    rnd = random.Random(6)
    needles = [(f"needle-{i}-{'z' * (i % 40)}".encode(), f"c{i}") for i in range(50)] + [(b"two\nlines of one secret", "m")]
    body = {}
    for k, size in enumerate((0, 5, 1000, 4096, 30_000)):
        data = b""
        while len(data) < size:
            data += rnd.choice([rnd.choice(needles)[0], b"-" * rnd.randint(1, 30)])
        body[f"{tmp_path}/in/d{k % 2}/f{k}"] = data[:size]
    for path, data in body.items():
        (tmp_path / "in" / path.split("/")[-2]).mkdir(parents=True, exist_ok=True)
        open(path, "wb").write(data)
    table = spark.createDataFrame(needles, "needle binary, label string")
    want = brute(list(body.items()), needles)
    longest = max(len(n) for n, _ in needles)
    for size in (64, 1000, 1 << 20):
        ranges = read_ranges(spark, f"{tmp_path}/in", longest - 1, size)
        assert {(r.path, r.size) for r in ranges.collect()} == {(p, len(d)) for p, d in body.items() if d}
        assert found(known.find_known(ranges, table)) == want
    assert ranges.rdd.getNumPartitions() == 1 and read_ranges(spark, f"{tmp_path}/in", 9, 1000).rdd.getNumPartitions() > 30
    with pytest.raises(Exception, match="longest needle less one"):
        known.find_known(read_ranges(spark, f"{tmp_path}/in", 3, 64), table).count()


def test_lines_of_a_multi_line_secret(spark):
    """Each long line of it is looked for on its own, but for the ones that frame it."""
    lines = ["-----BEGIN SOMETHING-----", "q" * 10 + "0123456789" * 3, "short line", "  " + "w" * 25, "-----END SOMETHING-----"]
    needles = known.dictionary(spark.createDataFrame([("\n".join(lines), "k")], "secret string, label string"))
    hay = [(0, f"x {lines[1]} y"), (1, lines[3].strip()), (2, lines[0]), (3, lines[2]), (4, "\n".join(lines)), (5, "\r\n".join(lines))]
    hits = known.merge_hits(known.find_known(spark.createDataFrame(hay, "path int, content string"), needles)).collect()
    assert sorted((r.path, r.len) for r in hits) == sorted([(0, 40), (1, 25), (4, len("\n".join(lines))), (5, 40), (5, 25)])


def test_compressed_and_missing_files_are_errors(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(b"x")
    with pytest.raises(Exception, match="compressed"):
        read_ranges(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="none"):
        read_ranges(spark, str(tmp_path / "none")).count()


def test_nothing_to_find(spark):
    files = spark.createDataFrame([("a", b"some text of it")], "path string, content binary")
    empty = spark.createDataFrame([], "needle binary, label string")
    assert known.find_known(files, empty).count() == 0
    assert known.find_known(files.filter("false"), spark.createDataFrame([(b"some text", "c")], "needle binary, label string")).count() == 0


def test_redaction_by_hits_equals_redaction_by_broadcast(spark, monkeypatch):
    rnd = random.Random(7)
    needles = spark.createDataFrame([(f"secret-{i}", f"c{i}") for i in range(300)], "secret string, label string").select(F.col("secret").cast("binary").alias("needle"), "label")
    rows = spark.createDataFrame([(rnd.choice(["p", "q", None]), rnd.choice([None, "", "plain text of it", f"a secret-{rnd.randrange(400)} secret-{rnd.randrange(400)}"])) for _ in range(80)], "path string, content string")
    listed = lambda df: sorted((str(r.path), str(r.content and bytes(r.content)), r.n_redacted) for r in df.collect())
    want = listed(known.redact_rows(rows, needles))
    monkeypatch.setattr(known, "PART_BYTES", 100)
    assert listed(known.redact_rows(rows, needles)) == want and sum(x[2] for x in want) > 10
