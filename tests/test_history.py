"""Outgoing commits by the commit index against a plain walk, and how much it touches."""

import os
import random

from vigil.operators import commits, history


def reach(parents, shas):
    seen, todo = set(), [s for s in shas if s]
    while todo:
        s = todo.pop()
        if s not in seen:
            seen.add(s)
            todo += parents.get(s, [])
    return seen


def walked(edges, tips, refs):
    parents = {}
    for s, p in edges:
        parents.setdefault(s, [])
        if p:
            parents[s].append(p)
    known = set(parents) | {p for _, p in edges if p}
    out = {}
    for push, sha, old, remote in tips:
        own, cut = out.setdefault(push, ([], []))
        if sha and set(sha) != {"0"}:
            own.append(sha)
            cut += [old] if old in known else [s for r, s in refs if r == remote]
    return {(push, s) for push, (own, cut) in out.items() for s in reach(parents, own) - reach(parents, cut)}


def given(seed, n=160):
    """Several roots, side branches, merges of two and three, and lines that cross each other again and again."""
    rnd = random.Random(seed)
    edges = [("c0", None), ("c1", None)]
    for i in range(2, n):
        if i % 40 == 7:
            edges.append((f"c{i}", None))
            continue
        near = lambda: f"c{max(0, i - rnd.choice([1, 1, 1, 2, 3, 9, 40]))}"  # noqa: B023, E731
        edges += [(f"c{i}", p) for p in dict.fromkeys(near() for _ in range(rnd.choice([1, 1, 1, 2, 2, 3])))]
    some = lambda: f"c{rnd.randrange(n)}"
    refs = [(f"r{i % 3}", some()) for i in range(7)] + [("r0", None), ("r1", "unknown")]
    tips = [(f"p{i // 2}", rnd.choice([some(), some(), "0000", "alone", None]), rnd.choice([some(), None, "0000", "gone"]), rnd.choice(["r0", "r1", "r2", "none", None])) for i in range(24)]
    return edges, tips, refs


def test_equals_a_walk(spark):
    edges, tips, refs = given(1, 110)
    tables = spark.createDataFrame(edges + edges[:9], "sha string, parent string").repartition(3), spark.createDataFrame(tips, "push_id string, sha string, remote_sha string, remote string"), spark.createDataFrame(refs, "remote string, sha string")
    rows = [tuple(r) for r in commits.outgoing_commits(*tables).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == walked(edges, tips, refs)


def test_a_long_history_is_not_walked(spark, monkeypatch):
    """Twenty pushes of two commits each, onto a line of 3,000 with a side branch every hundred: what is asked of the index
    touches rows in proportion to the answer, and building it writes a row per commit at a time."""
    n, written = 3000, []
    real = history._stored
    monkeypatch.setattr(history, "_stored", lambda df, name: (out := real(df, name), written.append((name, out.count())))[0])
    line = [(f"m{i}", f"m{i - 1}") for i in range(1, n)]
    for k in range(100, n, 100):  # forked thirty commits before, merged here
        line += [(f"s{k}.0", f"m{k - 30}"), (f"s{k}.1", f"s{k}.0"), (f"m{k}", f"s{k}.1")]
    line += [(f"p{i}.{j}", f"p{i}.{j - 1}" if j else f"m{n - 1 - i}") for i in range(20) for j in range(2)]
    index = history.CommitIndex(spark.createDataFrame(line, "sha string, parent string"))
    assert max(k for _, k in written) <= len(line) + 1 and len(written) < 60
    del written[:]
    tips = [(f"push{i}", f"p{i}.1", f"m{n - 1 - i}" if i % 2 else None, "origin") for i in range(20)]
    refs = spark.createDataFrame([("origin", f"m{n - 1}"), ("origin", "m5"), ("origin", "s400.1")], "remote string, sha string")
    out = commits.outgoing_commits(index, spark.createDataFrame(tips, "push_id string, sha string, remote_sha string, remote string"), refs)
    assert sorted(map(tuple, out.collect())) == sorted((f"push{i}", f"p{i}.{j}") for i in range(20) for j in range(2))
    assert max(k for _, k in written) <= 3 * 40


def test_no_commits(spark):
    edges, tips = spark.createDataFrame([], "sha string, parent string"), spark.createDataFrame([("p", "a", None), ("q", None, "a")], "push_id string, sha string, remote_sha string")
    assert [tuple(r) for r in commits.outgoing_commits(edges, tips).collect()] == [("p", "a")]


def test_tables_go_when_nothing_reads_them(spark, monkeypatch, tmp_path):
    """While an answer is made few tables are there at a time, and then those that it is read from; the session stays as it was."""
    edges, tips, refs = given(2, 60)
    kept, real, before = [], history._stored, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    monkeypatch.setattr(history, "scratch", lambda session, name: str(tmp_path / f"{name}-{len(kept)}"))
    monkeypatch.setattr(history, "_stored", lambda df, name: (real(df, name), kept.append(len(os.listdir(tmp_path))))[0])
    tables = spark.createDataFrame(edges, "sha string, parent string"), spark.createDataFrame(tips, "push_id string, sha string, remote_sha string, remote string"), spark.createDataFrame(refs, "remote string, sha string")
    out = commits.outgoing_commits(*tables)
    assert len(kept) > 15 and max(kept) <= 9
    assert sorted(x.split("-")[0] for x in os.listdir(tmp_path)) == ["commits", "open"]
    assert {tuple(r) for r in out.collect()} == walked(edges, tips, refs)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == before


def test_zero_is_an_id_where_ids_are_numbers(spark):
    edges = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 1)], "sha long, parent long")
    tips = spark.createDataFrame([("p", 0, None, "r"), ("q", 2, 0, "r"), ("s", 3, None, "t")], "push_id string, sha long, remote_sha long, remote string")
    refs = spark.createDataFrame([("r", 2), ("t", 0)], "remote string, sha long")
    assert sorted(map(tuple, commits.outgoing_commits(edges, tips, refs).collect())) == [("q", 1), ("q", 2), ("s", 1), ("s", 3)]
    tips = spark.createDataFrame([("p", 0, None, "u")], tips.schema)
    assert sorted(map(tuple, commits.outgoing_commits(edges, tips, refs).collect())) == [("p", 0)]
