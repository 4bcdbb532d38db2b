"""SimHash near-dedup by a binary trie self-join.

Fingerprints of equal value are grouped first, so copies cost nothing further. Two fingerprints of 64 bits that differ in
at most 3 agree on one of four 16-bit blocks, and of the other 48 bits on one of four 12-bit blocks; for each of the 16
choices the agreed 28 bits are moved to the front and name a subtree of a binary trie, which is one shuffle key. Within a
subtree the trie is joined with itself: node pairs go down together, differing bits add up, and a pair is pruned once
they exceed the budget. Sorted fingerprints are the trie (a node is a range), and node pairs go down as numpy arrays, so
a step handles many pairs. Each task reduces its links to a forest that keeps all connections, and the components are
found by star contraction in Spark. Nothing is dropped or capped, and no pairs of copies are made.

With a `similarity`, links are pairs within a wider budget whose shingle sets have that Jaccard similarity; `similar` names
the subtrees then and compares what the trie leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, stored
from .components import connected_components

BITS, BUDGET, FIXED = 64, 3, 28
SEED = 42

#: For a byte, its bits spread over the eight bytes of an integer: sums of up to 255 of them don't carry over.
_SPREAD = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None], axis=2, bitorder="little").reshape(256, 8).copy().view(np.uint64)[:, 0]


def shingle_hashes(text: str | None, size: int = 3) -> list[int]:
    """XXH64 of each word shingle of the text, A-Z in lower case; fewer words are one shingle, no word gives none."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of `sizes` hashes: a bit is 1 if it is set in over half of the run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    size = sizes[full]
    begin = np.cumsum(size) - size
    parts = -(-size // 255)
    first_part = np.cumsum(parts) - parts
    at = np.repeat(begin - first_part * 255, parts) + np.arange(parts.sum()) * 255
    for byte in range(8):
        lanes = np.add.reduceat(_SPREAD[((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)], at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_part, axis=0)
        bits = (2 * counts > size[:, None]).astype(np.uint64)
        for bit in range(8):
            out[full] |= bits[:, bit] << np.uint64(8 * byte + bit)
    return out


def fingerprints(texts: DataFrame, size: int = 3) -> DataFrame:
    """texts (..., text) -> (..., fp): the SimHash of every whole text; null and empty texts give 0."""
    kept = [c for c in texts.columns if c != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                each = [shingle_hashes(t, size) for t in some.column("text").to_pylist()]
                sizes = np.fromiter(map(len, each), np.int64, len(each))
                flat = np.fromiter((h for hs in each for h in hs), np.uint64, int(sizes.sum()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(majority_bits(flat, sizes).view(np.int64))], [*kept, "fp"])

    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    return texts.select(*kept, "text").mapInArrow(rows, f"{schema}, fp long")


def _front(v: np.ndarray, k: int, back: bool = False) -> np.ndarray:
    """Move block k // 4 and then, of the rest, sub-block k % 4 to the front; or back again."""
    i, j, low = np.uint64(16 * (k // 4)), np.uint64(12 * (k % 4)), np.uint64((1 << 48) - 1)
    turn = lambda x, n, width: ((x << n) | (x >> (np.uint64(width) - n))) if n else x
    if back:
        rest = turn(v & low, np.uint64(48) - j if j else j, 48) & low
        return turn((v & ~low) | rest, np.uint64(64) - i if i else i, 64)
    v = turn(v, i, 64)
    return (v & ~low) | (turn(v & low, j, 48) & low)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(16):
            moved = _front(v, k)
            top = ((moved >> np.uint64(BITS - FIXED)) | (np.uint64(k) << np.uint64(FIXED))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(moved.view(np.int64))], ["subtree", "v"])


def _pairs(lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of each pair of ranges."""
    wide = hi_b - lo_b
    n = (hi_a - lo_a) * wide
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(lo_a, n) + inner // np.repeat(wide, n), np.repeat(lo_b, n) + inner % np.repeat(wide, n)


def trie_links(v: np.ndarray, subtrees: np.ndarray, fixed: int = FIXED, budget: int = BUDGET, leaf: int = 32, at_once: int = 1 << 17, every: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of v (sorted within each run of `subtrees`) that connect all values of a subtree that differ in at most
    `budget` bits, or with `every` all such pairs. Subtrees share their first `fixed` bits. Without `every` the values of a
    subtree are distinct."""
    cuts = np.flatnonzero(np.r_[True, subtrees[1:] != subtrees[:-1]]) if len(v) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(v)].astype(np.int64)
    many = ends - cuts > 1
    cuts, ends = cuts[many], ends[many]
    todo = [(fixed, cuts, ends, cuts, ends, np.zeros(len(cuts), np.int64))]
    while todo:
        depth, la, ha, lb, hb, err = todo.pop()
        if len(la) > at_once:
            todo += [(depth, *(x[at : at + at_once] for x in (la, ha, lb, hb, err))) for at in range(0, len(la), at_once)]
            continue
        size = (ha - la) * (hb - lb)
        # All values below are within the budget: a star connects them. Where every pair is wanted, only equal values are so.
        near = np.full(len(la), False) if every else err + (BITS - depth) <= budget
        if near.any():
            for a, b, c, d in ((la, la + 1, lb, hb), (la, ha, lb, lb + 1)):
                i, j = _pairs(a[near], b[near], c[near], d[near])
                yield i, j
        small = ~near & ((size <= leaf) | (depth == BITS))
        if small.any():
            i, j = _pairs(la[small], ha[small], lb[small], hb[small])
            hit = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
            yield i[hit], j[hit]
        go = ~near & ~small
        if not go.any():
            continue
        la, ha, lb, hb, err = (x[go] for x in (la, ha, lb, hb, err))
        bit = np.uint64(BITS - 1 - depth)

        def middle(lo, hi, bit=bit):
            """The first index of each range at which the bit is set, by bisection in all ranges at once."""
            lo, hi = lo.copy(), hi.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                one = ((v[np.minimum(mid, len(v) - 1)] >> bit) & np.uint64(1)).astype(bool)
                hi, lo = np.where(open_ & one, mid, hi), np.where(open_ & ~one, mid + 1, lo)
            return lo

        ma, mb, same = middle(la, ha), middle(lb, hb), la == lb
        below = ((la, ma, lb, mb, err, None), (ma, ha, mb, hb, err, None), (la, ma, mb, hb, err + 1, None), (ma, ha, lb, mb, err + 1, ~same))
        kids = []
        for a, b, c, d, e, only in below:
            keep = (b > a) & (d > c) & (e <= budget) & ~((a == c) & (b - a < 2))
            keep = keep if only is None else keep & only
            kids.append(tuple(x[keep] for x in (a, b, c, d, e)))
        todo.append((depth + 1, *(np.concatenate(x) for x in zip(*kids, strict=True))))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links i-j connect it with."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not (root[root] == root).all():
            root = root[root]


def _links(budget: int):
    """Rows (subtree, v) sorted by both -> a forest of links (a, b) that connects what is linked within a subtree."""

    def joined(tree: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        root, kept_i, kept_j, n = np.arange(len(v)), [], [], 0
        for i, j in trie_links(v, tree, budget=budget):
            kept_i, kept_j, n = [*kept_i, i], [*kept_j, j], n + len(i)
            if n > 1 << 21:
                root = _forest(len(v), np.concatenate([np.arange(len(v)), *kept_i]), np.concatenate([root, *kept_j]))
                kept_i, kept_j, n = [], [], 0
        root = _forest(len(v), np.concatenate([np.arange(len(v)), *kept_i]), np.concatenate([root, *kept_j]))
        child = np.flatnonzero(root != np.arange(len(v)))
        for k in range(16):
            own = child[(tree[child] >> FIXED) == k]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(_front(x, k, back=True).view(np.int64)) for x in (v[own], v[root[own]])], ["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, v = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            tree = np.r_[tree, batch.column(0).to_numpy(zero_copy_only=False)]
            v = np.r_[v, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            whole = int(np.searchsorted(tree, tree[-1])) if len(tree) else 0
            if whole:
                yield from joined(tree[:whole], v[:whole])
                tree, v = tree[whole:], v[whole:]
        yield from joined(tree, v)

    return rows


def fingerprint_links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links (a, b) that connect all fingerprints of the one column of `distinct` that differ in at most `budget` bits, 3 at
    most."""
    # The order of v as a signed number is that of its bits within a subtree, whose first bit is shared.
    dealt = distinct.mapInArrow(_keyed, "subtree long, v long").repartition("subtree").sortWithinPartitions("subtree", "v")
    return dealt.mapInArrow(_links(budget), "a long, b long")


def _placed(docs: DataFrame, id_col: str, text_col: str, size: int, budget: int, similarity: float | None) -> DataFrame:
    """(id, t, h, fp, component_id) for each row: hashes of the text and of the whole row, a print that rows of one node
    share, and the smallest id of the component."""
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"), whole.alias("h"), F.col(f"`{text_col}`").alias("text"))
    if similarity is None:
        if budget > BUDGET:
            raise ValueError(f"a budget over {BUDGET} bits needs a similarity")
        prints = stored(fingerprints(rows, size), "fingerprints")
        roots = connected_components(fingerprint_links(prints.select("fp").distinct(), budget))
    else:
        from . import similar

        prints = stored(similar.described(rows, size), "described")
        roots = similar.similar_links(rows.select("text", "t"), prints, size, similarity, budget)
        prints = prints.drop("sample")
    ids = prints.groupBy("fp").agg(F.min("id").alias("least"))
    placed = ids.join(shuffled(roots.withColumnRenamed("a", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = stored(placed, "placed")
    firsts = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(shuffled(placed.join(shuffled(firsts), "root").select("fp", "root", "component_id")), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = BUDGET, similarity: float | None = None) -> DataFrame:
    """(id, fp, component_id) for each row of `docs`; component_id is the smallest id of the component.

    Links are pairs of fingerprints over `size`-word shingles that differ in at most `budget` bits, 3 at most; with a
    `similarity`, pairs of shingle sets of that Jaccard similarity or more within `budget` bits, and fp is a print of the
    set. Null and empty texts are equal and linked; so are equal texts, of any length. A null id is never the smallest; a
    component of null ids alone has a null component_id. Rows with equal ids each have their own row. An empty table gives an
    empty result; other columns may have any name.
    """
    return _placed(docs, id_col, text_col, size, budget, similarity).select("id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = BUDGET, similarity: float | None = None) -> DataFrame:
    """One row of `docs` for each component, with all its columns: that of the smallest id, null ids last; of rows that share
    it, one. Links and odd rows are as in `near_duplicates`; an empty table stays empty."""
    placed = stored(_placed(docs, id_col, text_col, size, budget, similarity).select("id", "t", "h", "root"), "rows")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "t", "h")
    kept = placed.groupBy("root").agg(F.min(key).alias("first")).select("first.id", "first.t", "first.h")
    # Rows that are equal in all columns can't be told apart by a join; there are few, so only these are made distinct.
    times = placed.groupBy("id", "t", "h").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    on_ = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.t") == F.col(f"{b}.t")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    kept = kept.alias("k").join(shuffled(times.alias("n")), on_("k", "n"), "left").select("k.id", "k.t", "k.h", F.col("n._times").isNotNull().alias("_again"))
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"), whole.alias("h"))
    out = rows.alias("d").join(shuffled(kept.alias("k")), on_("d", "k")).select("d.row", "d.id", "d.t", "d.h", "k._again")
    once, again = out.filter("not _again"), out.filter("_again").dropDuplicates(["id", "t", "h"])
    return once.unionByName(again).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
