"""Op 13 against a walk through every order, and its SQL on odd rows."""

import random
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from vigil.llm import interactions, queries

SCHEMA = "doc_id long, text string, source string, mask int, print string, n int"
LABELS = "doc_id long, quality int, toxic int, part string"


def given(seed=0):
    rnd = random.Random(seed)
    words = ["the", "Cat", "of", "DOGS", "x#", "a|b", "é", "日本", " ", "one", "two", "three"] + [f"w{i}" for i in range(60)]
    texts = [None, "", "", " \n", "A", "#"] + ["".join(rnd.choice(words[: rnd.choice([3, 12, 72])]) + rnd.choice([" ", "\n", "\t\x0b", "\r\n"]) for _ in range(rnd.choice([3, 49, 50, 51, 200]))) for _ in range(40)]
    texts += ["lower case words only and nothing else " * 4000, "a b c " * 30] + [" ".join(f"u{i}" for i in range(60))] * 9
    docs = [(i // 2 if i < 6 else i, t, rnd.choice(["a", "b", None, ""]), 1, "p", 2) for i, t in enumerate(texts)]
    docs += [(None, texts[-1], "a", 1, "p", 2), (None, "only once here", "b", 1, "p", 2), docs[-1], docs[10], docs[10]]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1]), "z") for i in range(0, 60, 2)] + [(8, 1, 0, "z"), (8, 0, 1, "z"), (None, 1, 1, "z")]
    return docs, labels


def walked(docs, labels):
    """Every document through every order."""
    import re

    said = {}
    for i, q, t, _ in labels:
        if i is not None:
            a = said.setdefault(i, [0, 0])
            a[0], a[1] = a[0] | (q == 1), a[1] | (t == 1)
    rows = []
    for i, text, source, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(j is not None and (i is None or j < i) and (u or "") == t for j, u, *_ in docs)
        fails = {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller), strict=True) if x}
        rows.append((source or "", fails, *said.get(i, (0, 0))))
    out = {}
    for order in permutations("ABCDE"):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                mine = [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), k] = [len(left), len(gone), len(mine) - len(gone), sum(len(r[1]) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    for part, order, k in list(out):
        out[part, order, k].append(sum(v[1] for (p, o, j), v in out.items() if p == part and o[j - 1] == order[k - 1]))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = given()
    return spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS)


def test_every_count_equals_a_walk(tables):
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in interactions.audit(*tables).collect()}
    assert got == walked(*given())


def test_sql_on_odd_rows(spark, tables, tmp_path):
    for name, df in zip(("documents", "labels"), tables, strict=True):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = queries.op13_filter_interactions(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP13_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 3 * 600


def test_nothing_and_nulls(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert interactions.audit(docs, labels).count() == 0
    rows = interactions.audit(spark.createDataFrame([(None, None, None, 1, "", 1)], SCHEMA), labels).filter("step = 1").groupBy("part").agg(F.sum("removed")).collect()
    assert [tuple(r) for r in rows] == [("", 24)]


def test_weights_are_those_of_the_average_over_orders():
    from math import factorial

    for n in (2, 3, 5):
        weights = interactions.shapley_weights(n)
        for i in range(n):
            for s in range(1, 1 << n):
                k = s.bit_count()
                want = factorial(k - 1) * factorial(n - k) if s >> i & 1 else -factorial(k) * factorial(n - k - 1)
                assert weights[i][s] == want
