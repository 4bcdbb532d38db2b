"""Op 11 against brute force, with clusters, odd rows, and a tree deep enough to leave branches out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import hard_negatives as hn
from vigil.llm.hyperplane_tree import Tree, to_query

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, v int, leaf string"


def brute(rows, n_positive=5, n_negative=3):
    some = []
    for i, v, label, *_ in rows:
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            some.append((i, [max(-hn.LIMIT, min(hn.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(some):
        if i is None or i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, u, strict=False)), j is None, j or 0, m) for b, (j, u, m) in enumerate(some) if a != b]
        scored.sort()
        for s, none, j, m in [x for x in scored if x[3] == label][:n_positive]:
            fit = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_negative]
            out += [(i, None if none else j, k, None if x[1] else x[2], -s, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()), key=repr)


def clusters(n, width, seed, spread):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, width))
    x = centres[rnd.integers(0, 12, n)] + spread * rnd.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_clusters_with_a_small_tree(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 40)
    monkeypatch.setattr(hn, "BLOCK", 16)
    v = clusters(1500, 8, 1, 0.3)
    rows = [(i, [float(x) for x in v[i]], i * 7 % 5, "r", 1, "l") for i in range(1500)]
    rows += [(i + 1500, rows[100][1], 3, "r", 1, "l") for i in range(400)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rnd = random.Random(3)
    any_ = lambda n=3: [rnd.uniform(-1, 1) for _ in range(n)]
    rows = [(rnd.choice([0, 50, 100, 7, None, *range(200, 260)]), any_(), rnd.choice([1, 1, 2, None]), "r", 1, "l") for _ in range(150)]
    rows += [(0, None, 1), (50, [1.0, None, 0.0], 1), (100, [math.nan, 0.0, 0.0], 1), (150, [math.inf, 0.0, 0.0], 2), (150, [], 1), (200, [0.5], 1), (250, any_(5), 2), (300, [3e38, 1.0, -3e38], 1), (350, [0.0, 0.0, 0.0], 2)]
    rows = [(*r[:3], "r", 1, "l") for r in rows]
    rows += rows[:30]
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(0, [], 1), (50, [], 2), (1, [], 1)], [(None, [1.0], 1), (None, [1.0], 2)]])
def test_hardly_any_rows(spark, rows):
    rows = [(*r, "r", 1, "l") for r in rows]
    assert mined(spark, rows) == brute(rows)


def test_the_tree_leaves_out_only_what_holds_no_answer():
    v = np.floor(256 * clusters(4000, 6, 5, 0.05).astype(float))
    radius2 = float(np.einsum("ij,ij->i", v, v).max())
    tree = Tree(v[:800], len(v), radius2, 100)
    leaf = tree.leaf_of(v)
    tree.set_ranges({x: tree.reach(x, v[leaf == x]) for x in np.unique(leaf).tolist()})
    q = v[::40]
    scores = q @ v.T
    best = np.sort(scores, axis=1)[:, -20:]
    lows, highs = np.stack([best[:, 0], best[:, 5]], 1), np.stack([best[:, 3], best[:, 9]], 1)
    alive = tree.visits(q, to_query(q, highs, radius2), to_query(q, lows, radius2))
    inside = ((scores[:, :, None] >= lows[:, None]) & (scores[:, :, None] <= highs[:, None])).any(axis=2)
    for i in range(len(q)):
        assert set(leaf[inside[i]].tolist()) <= set(np.flatnonzero(alive[i]).tolist())
    assert tree.leaves > 60 and alive.mean() < 0.5


def test_rows_and_groups_stay_small(spark, monkeypatch):
    """No stored row holds many vectors, a query is sent once to a part of several leaves, and a hot leaf is several parts."""
    tables, real, width = [], hn.stored, 8
    monkeypatch.setattr(hn, "LEAF", 40)
    monkeypatch.setattr(hn, "PART", 150, raising=False)
    monkeypatch.setattr(hn, "SLOT", 8, raising=False)
    monkeypatch.setattr(hn, "stored", lambda df, *a: (tables.append(real(df, *a)), tables[-1])[1])
    v = clusters(900, width, 4, 0.2)
    rows = [(i, [float(x) for x in v[0 if i % 3 == 0 else i]], i * 7 % 5, "r", 1, "l") for i in range(900)]
    assert mined(spark, rows) == brute(rows)
    for t in tables:
        if own := [F.max(F.octet_length(c)) for c, kind in t.dtypes if kind == "binary"]:
            assert max(t.agg(*own).first()) <= 8 * width
    index = hn.Index(real(hn.vectors(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, "vec_id", "embedding", "label"), "vectors"))
    _, parts = index.shared.value
    assert index.rows.groupBy("part").count().agg(F.max("count")).first()[0] < 300
    assert max(parts.pieces) > 1 and max(map(len, parts.leaves)) > 1 and sorted({x for p in parts.leaves for x in p}) == list(range(index.tree.leaves))
