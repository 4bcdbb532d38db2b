"""Recall of the pipeline's near-dedup links over the given documents, against all pairs of similarity 0.8 or more.

`python -m tests.llm.test_near_copies_given FOLDER` measures it on a larger table."""

import math
import re
import sys
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from vigil.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def similar_pairs(rows, similarity=0.8, size=5):
    """rows (id, text) -> (groups: set -> ids, the pairs of different sets that are similar): a set's rarest shingles, one more
    than it may lose, have to meet one of the other's, and every pair that meets is compared."""
    groups = defaultdict(list)
    for i, text in rows:
        w = WORD.findall((text or "").translate(UPPER))
        groups[frozenset(" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()].append(i)
    sets = list(groups)
    n = Counter(s for one in sets for s in one)
    index, pairs = defaultdict(list), []
    for at, one in enumerate(sets):
        rare = sorted(one, key=lambda s: (n[s], s))[: len(one) - math.ceil(similarity * len(one) - 1e-9) + 1]
        for other in {j for s in rare for j in index[s]}:
            both = len(one & sets[other])
            if both >= similarity * (len(one) + len(sets[other]) - both) - 1e-9:
                pairs.append((other, at))
        for s in rare:
            index[s].append(at)
    return [groups[s] for s in sets], pairs


def recall(spark, folder):
    """(pairs found in one component, all pairs, rows whose component differs from brute force, rows)"""
    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    groups, pairs = similar_pairs(rows)
    root = list(range(len(groups)))

    def top(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a, b in pairs:
        root[top(a)] = top(b)
    least = {}
    for k, ids in enumerate(groups):
        least[top(k)] = min(least.get(top(k), ids[0]), *ids)
    want = {i: least[top(k)] for k, ids in enumerate(groups) for i in ids}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.id: r.component_id for r in simhash.near_duplicates(docs, size=5, budget=24, similarity=0.8).collect()}
    assert len(got) == len(want) == len(rows)
    return sum(got[groups[a][0]] == got[groups[b][0]] for a, b in pairs), len(pairs), sum(got[i] != want[i] for i in want), len(rows)


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_recall_of_links(spark, sf):
    found, pairs, differ, rows = recall(spark, f"/root/testdata/{sf}")
    assert pairs > 20 and found >= 0.99 * pairs and differ <= 0.01 * rows


if __name__ == "__main__":
    import os
    import tempfile

    from pyspark.sql import SparkSession

    session = SparkSession.builder.master(f"local[{os.cpu_count()}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    print("recall: found %d of %d pairs; component differs in %d of %d rows" % recall(session, sys.argv[1]))
