"""Candidate links for SimHash near-dedup at a given Jaccard similarity of shingle sets.

Texts of similarity 0.8 differ in about ten of 64 SimHash bits and may differ in twice as many, a budget at which no choice
of agreed bits names the subtrees of the trie self-join. Here a subtree is named by a rare shingle instead. The shingles of a
text are put into one order for all texts, common ones last, as a sample counts them; of two sets of similarity s or more
the first |x| - ceil(2s / (1 + s) |x|) + 1 shingles of the smaller and the first |y| - ceil(s |y|) + 1 of the larger share
one. The order decides the cost only. Within each subtree node pairs go down the trie of fingerprints together and are
pruned beyond the budget; what is left is compared exactly.

A large group of near copies would make very many pairs, so the texts of a subtree are first compared with one text of it,
the results joined to components, and again with
another; only pairs that are in different components then go down the trie.
Nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import bitmap, in_bitmap, most_frequent, shuffled, stored
from .components import connected_components
from .simhash import majority_bits, shingle_hashes, trie_links

#: One text in SAMPLE is counted for the order of shingles, in which at most COMMON frequent ones come last.
SAMPLE, COMMON = 16, 100_000
#: How many centres a large group has in the round of stars.
HUBS = 8
EPS = 1e-9


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of the whole text, sorted."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def _print(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def described(texts: DataFrame, size: int) -> DataFrame:
    """texts (..., text) -> (..., fp, sample): the print of the shingle set, and the set itself for one text in SAMPLE."""
    kept = [c for c in texts.columns if c != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = [shingle_set(t, size) for t in some.column("text").to_pylist()]
                prints = [_print(s) for s in sets]
                sample = [s.tobytes() if p % SAMPLE == 0 else None for p, s in zip(prints, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(prints, pa.int64()), pa.array(sample, pa.binary())], [*kept, "fp", "sample"])

    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    return texts.select(*kept, "text").mapInArrow(rows, f"{schema}, fp long, sample binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], ["key"])


def prefix_length(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - EPS)) + 1 if n else 0


def _prefixes(size: int, similarity: float, shared):
    """Texts -> (fp, sim, n, keys): the first shingles of the set in the order for all texts, as packed integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [s for t in batch.column(0).slice(at, 500).to_pylist() if (s := shingle_set(t, size)).size]
                sizes = np.array([len(s) for s in sets], np.int64)
                sims = majority_bits(np.concatenate([np.zeros(0, np.uint64), *sets]), sizes)
                keys = []
                for own in sets:
                    p = prefix_length(len(own), similarity)
                    if len(common):
                        k = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        own = own[np.lexsort((own, np.where(common[k] == own, counts[k], 0)))]
                    keys.append(own[:p].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([_print(s) for s in sets], pa.int64()), pa.array(sims.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(keys, pa.binary())], ["fp", "sim", "n", "keys"])

    return rows


def _keys_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64)


def _entries(shared, shift: np.uint64):
    """(fp, sim, n, keys) -> (key, fp, sim, n, place) of the keys whose first bits are in the filter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                each = np.array([len(k) // 8 for k in some.column(3).to_pylist()], np.int64)
                keys = _keys_of(some.column(3))
                row = np.repeat(np.arange(len(each)), each)
                place = np.arange(len(keys)) - np.repeat(np.cumsum(each) - each, each)
                hit = in_bitmap(shared.value, (keys >> shift).view(np.int64))
                own = pa.array(row[hit])
                yield pa.RecordBatch.from_arrays([pa.array(keys[hit].view(np.int64)), *(some.column(k).take(own) for k in range(3)), pa.array(place[hit].astype(np.int32))], ["key", "fp", "sim", "n", "place"])

    return rows


def _sets(size: int, shared):
    """(text, t) -> the sets of the texts whose t is in the filter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).filter(pa.array(in_bitmap(shared.value, batch.column(1).to_numpy(zero_copy_only=False))))
            for at in range(0, len(some), 500):
                sets = [shingle_set(t, size) for t in some.slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_print(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "hashes"])

    return rows


def _alike(similarity: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - EPS)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return rows


def _possible(n: Column, place: Column, other_n: Column, other_place: Column, similarity: float) -> Column:
    """Whether a pair whose first shared shingle has these places can be similar enough."""
    return F.least(n - place, other_n - other_place) >= (n + other_n) * (similarity / (1 + similarity)) - EPS


def _trie_pairs(similarity: float, budget: int):
    """Rows (key, sim, fp, n, place, root), each subtree together and sorted -> pairs of different components that the trie
    doesn't prune and that can be similar enough."""

    def joined(key, sim, fp, n, place, root) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((sim.view(np.uint64), key))
        key, sim, fp, n, place, root = (x[order] for x in (key, sim.view(np.uint64), fp, n.astype(np.int64), place, root))
        for i, j in trie_links(sim, key, fixed=0, budget=budget, every=True):
            ok = (root[i] != root[j]) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= (n[i] + n[j]) * (similarity / (1 + similarity)) - EPS)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(fp[i[ok]]), pa.array(fp[j[ok]])], ["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                yield from joined(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held is not None:
            yield from joined(*held)

    return rows


def similar_links(texts: DataFrame, known: DataFrame, size: int, similarity: float, budget: int) -> DataFrame:
    """texts (text, t), known (t, fp, sample) as `described` returns it -> (a, root): the set prints that links connect with
    others. A link is a pair of sets of the similarity or more whose fingerprints differ in at most `budget` bits."""
    spark = texts.sparkSession
    counted = known.filter("sample is not null").select("sample").mapInArrow(_keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    common = most_frequent(counted, "n", COMMON).select("key", "n").toArrow()
    order = np.argsort(common["key"].to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((common["key"].to_numpy().view(np.uint64)[order], common["n"].to_numpy()[order]))
    prefixes = stored(texts.select("text").mapInArrow(_prefixes(size, similarity, shared), "fp long, sim long, n int, keys binary"), "prefixes")
    # Most shingles stand in one text: a counting filter finds the others without a shuffle of the entries themselves.
    total = prefixes.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    shift = np.uint64(64 - qf.INNER - qf.slice_bits_for(total // 8))
    again = qf.repeated(prefixes.select("keys"), lambda batch: (_keys_of(batch.column(0)) >> shift).view(np.int64))
    shared_keys = spark.sparkContext.broadcast(bitmap(again.select("fp")))
    some = stored(prefixes.mapInArrow(_entries(shared_keys, shift), "key long, fp long, sim long, n int, place int").dropDuplicates(["key", "fp"]), "some")
    first_of_smaller = F.col("n") - F.col("place") >= F.col("n") * (2 * similarity / (1 + similarity)) - EPS
    keys = some.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min(F.when(first_of_smaller, F.col("n"))).alias("least")).filter("lo <> hi and least is not null")
    members = stored(some.join(shuffled(keys.select("key", "least")), "key").filter("n >= least").drop("least"), "members")

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        some_texts = spark.sparkContext.broadcast(bitmap(known.join(shuffled(wanted), "fp", "left_semi").select("t")))
        sets = stored(texts.mapInArrow(_sets(size, some_texts), "fp long, hashes binary").join(shuffled(wanted), "fp", "left_semi").dropDuplicates(["fp"]), "sets")
        one, two = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
        return pairs.join(shuffled(one), "a").join(shuffled(two), "b").select("a", "b", "x", "y").mapInArrow(_alike(similarity), "a long, b long")

    roots = spark.createDataFrame([], "a long, root long")
    # A round of stars, then the trie: first for the nearest pairs, which leave fewer components to the full budget.
    for bits in (None, budget // 4, budget):
        # The order of columns is that of `_trie_pairs`.
        rooted = members.join(shuffled(roots), F.col("fp") == F.col("a"), "left").select("key", "sim", "fp", "n", "place", F.coalesce("root", "fp").alias("root"))
        row = F.struct("fp", "n", "place", "root", "sim")
        apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("fp", F.pmod("key", F.lit(HUBS))), row.alias("row")))["row"].alias("o")).filter("lo <> hi")
        if bits is None:
            pairs = rooted.join(shuffled(apart.select("key", "o")), "key").filter((F.col("root") != F.col("o.root")) & (F.bit_count(F.col("sim").bitwiseXOR(F.col("o.sim"))) <= budget))
            pairs = pairs.filter(_possible(F.col("n"), F.col("place"), F.col("o.n"), F.col("o.place"), similarity)).select(F.col("fp").alias("a"), F.col("o.fp").alias("b"))
        else:
            dealt = rooted.join(shuffled(apart.select("key")), "key").repartition("key").sortWithinPartitions("key")
            pairs = dealt.mapInArrow(_trie_pairs(similarity, bits), "a long, b long")
        roots = connected_components(alike(pairs).unionByName(roots.withColumnRenamed("root", "b")))
    return roots
