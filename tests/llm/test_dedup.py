"""Ops 1, 2 and 8 against brute force on fixtures with nulls, ties, empty and long texts, copies and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from vigil.llm import components, exact_dedup, simhash, substring
from vigil.llm import quotient_filter as qf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, kept int"


def rows(seed=0, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ß", "x y", " "]
    passage = [rnd.choice(vocab) for _ in range(70)]
    texts = [None, "", " \n", "one", "a  b\tc", "a b c", " a b c", "same same " * 60, "same same " * 61]
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 200))]
        if i % 3 == 0:
            at = rnd.randint(0, len(words))
            words[at:at] = passage[rnd.randint(0, 25) :]
        texts.append(rnd.choice([" ", "\n", "  "]).join(words))
    texts += [texts[12]] * 5 + [texts[20] + " tail", texts[20].replace(" ", "\t", 1)]
    texts.append(" ".join(rnd.choice(vocab) for _ in range(9000)) + " " + " ".join(passage))
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    out = [(i, t, "en", "s", 1, "clash", "clash", 0) for i, t in zip(ids, texts, strict=True)]
    return [*out, out[20], (None, texts[20], None, None, None, None, None, None)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_dedup_equals_brute_force(spark, seed):
    data = rows(seed)
    first = {}
    for d, t, *_ in data:
        w = words(t)
        for i in range(len(w) - 49) if d is not None else ():
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    want = []
    for d, t, *_ in data:
        w = words(t)
        gone = set()
        for i in range(len(w) - 49) if d is not None else ():
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [tuple(r) for r in substring.substring_dedup(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()]
    assert sorted(want, key=str) == sorted(got, key=str)
    assert sum(x[2] for x in want) > 300


def test_substring_window_must_be_even(spark):
    with pytest.raises(ValueError):
        substring.substring_dedup(spark.createDataFrame(rows(), SCHEMA), window=7)


def simhash_of(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    data = rows(3)
    near = " ".join(f"n{i % 97}" for i in range(800))
    data += [(1000 + i, near + f" Extra{i}" * (i % 5), "en", "s", 1, "", "", 0) for i in range(40)]
    prints = [simhash_of(t) for _, t, *_ in data]
    group = list(range(len(data)))
    for _ in range(len(data)):
        new = [min(group[j] for j in range(len(data)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(data))]
        if new == group:
            break
        group = new
    least = {}
    for g, (d, *_) in zip(group, data, strict=True):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    want = [(d, p, least[g]) for (d, *_), p, g in zip(data, prints, group, strict=True)]
    got = [(r.id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()]
    assert sorted(want, key=str) == sorted(got, key=str)
    kept = simhash.deduplicated(spark.createDataFrame(data, SCHEMA))
    assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(least.values(), key=str)


@pytest.mark.parametrize("options", [{}, {"size": 5, "budget": 24, "similarity": 0.8}])
def test_one_row_of_each_component_stays(spark, options):
    """Unequal texts under one id, null ids, rows that are equal in all columns."""
    one, other, third = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    data = [(2, one, "x"), (5, other, "x"), (5, one, "x"), (None, third, "x"), (None, third, "y"), (None, one, "x"), (7, third + "\n", "x"), (9, None, "x"), (9, None, "x"), (9, "", "y")]
    data += [(None, "alone " * 30, "x"), (None, "alone " * 30, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, h string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(df, **options).collect()), key=str)
    assert len(got) == 5 and [d for d, _ in got] == [2, 5, 7, 9, None] and got[0][1] == one and got[1][1] == other


def test_trie_links_keep_all_connections():
    rnd = np.random.default_rng(5)
    v = np.unique(np.array([int(c) ^ sum(1 << int(b) for b in set(rnd.integers(0, 36, rnd.integers(0, 5)))) for c in rnd.integers(0, 2**36, 40) for _ in range(12)], np.uint64))
    close = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    want = simhash._forest(len(v), *np.nonzero(close))
    links = list(simhash.trie_links(v, np.zeros(len(v), np.int64), leaf=1, at_once=50))
    i, j = (np.concatenate(x) for x in zip(*links, strict=True))
    assert (np.bitwise_count(v[i] ^ v[j]) <= 3).all()
    assert (simhash._forest(len(v), i, j) == want).all()


def test_front_is_undone():
    v = np.random.default_rng(0).integers(0, 2**64, 100, dtype=np.uint64)
    for k in range(16):
        assert (simhash._front(simhash._front(v, k), k, back=True) == v).all()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.a: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def test_exact_dedup_equals_brute_force(spark):
    data = rows(4) + [(500 + i, "hot text", "en", "s", 1, "", "", 0) for i in range(300)]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in data]
    groups = {}
    for (d, *_), t in zip(data, norm, strict=True):
        groups.setdefault(t, []).append(d)
    least = {t: min((d for d in g if d is not None), default=None) for t, g in groups.items()}
    want = [(d, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (d, *_), t in zip(data, norm, strict=True)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(data, SCHEMA).repartition(6)).collect()
    got = [(r.id, r.keep_id, r.group_size, hashlib.sha256(r.norm.encode()).hexdigest()) for r in out]
    assert sorted(want, key=str) == sorted(got, key=str)
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.id == r.keep_id for r in kept)
    left = exact_dedup.deduplicated(spark.createDataFrame(data, SCHEMA))
    assert left.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert {(r.doc_id, r.text) for r in left.collect()} <= {(d, t) for d, t, *_ in data} and left.count() == len(groups)


def test_equal_fingerprints_of_different_texts_are_not_equal(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(7).cast("long"))
    out = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")).collect()
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in out} == {(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)}


def test_quotient_filters_merge_without_loss():
    prints = np.random.default_rng(1).integers(-(2**63), 2**63, 500)
    prints = np.r_[prints, prints[:100], prints[:50]]
    import pyarrow as pa

    prints &= (1 << (qf.INNER + 6)) - 1
    prints[:40] &= (1 << qf.INNER) - 1  # a slice of many beside slices of few
    some = np.r_[prints, np.full(300, prints[0])]
    parts = [b for own in np.array_split(np.random.default_rng(2).permutation(some), 7) for b in qf._build()(iter([pa.RecordBatch.from_arrays([pa.array(own)], ["fp"])]))]
    table = pa.Table.from_batches(parts)
    got = {}
    for q in set(table["slice"].to_pylist()):
        out = qf._merged(table.filter(pa.compute.equal(table["slice"], q)))
        got |= dict(zip(out["fp"].to_pylist(), out["copies"].to_pylist(), strict=True))
    values, counts = np.unique(some, return_counts=True)
    assert got == {int(v): int(c) for v, c in zip(values, counts, strict=True) if c > 1}
    low, n = np.unique(prints[:40], return_counts=True)
    back = qf.unpacked(len(low), *qf.packed(low, n * 100))
    assert (back[0] == low).all() and (back[1] == n * 100).all()


@pytest.mark.parametrize("run", [lambda d: substring.substring_dedup(d), lambda d: simhash.near_duplicates(d), lambda d: exact_dedup.exact_dedup(d)])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
