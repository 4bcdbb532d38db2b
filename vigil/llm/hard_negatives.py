"""Hard-negative mining: for each anchor and each of its nearest rows of the same label, the best rows of other labels whose
score lies in a window below that of the positive.

Every row lies in a leaf of a multiway hyperplane tree (`hyperplane_tree`). Neighbouring leaves make up parts of bounded size;
a hot leaf is many parts. A search first scans the query's own leaf, which bounds the score that an answer needs; what is
left of its windows are annuli, and the tree tells which other leaves may meet them. A query travels once to each part that
holds some of them, with a bit for each leaf, and a part meets its queries in cogroups of bounded size, where they are scanned
exactly, block by block. The same search finds the positives (one window without ends) and the negatives (a window for each
positive).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_batches, stored
from .hyperplane_tree import FANOUT, Tree, to_query

#: Rows that the split points are fitted on, rows of a leaf to aim at, rows and queries that are multiplied at a time.
SAMPLE, LEAF, BLOCK = 8192, 2048, 512
#: Rows of a part, leaves of a part, queries that meet a part in one group, and rows of an Arrow batch: so many at most, and rows
#: and queries with fewer bytes than WIDEST in one group.
PART, PART_LEAVES, SLOT, BATCH, WIDEST = 16384, 62, 32768, 1024, 1 << 25
#: Components become whole numbers of at most so much, and vectors have at most so many: scores are exact in a double.
LIMIT, MOST_COMPONENTS = 1 << 20, 4096
SCALE = 256
_LEAST, _MOST = -(1 << 62), 1 << 62
_NO_ID = (1 << 63) - 1
PLACED = "rid long, id long, label long, leaf int, v binary"
REACH = "leaf int, at int, low double, high double"
SENT = "part int, slot int, wanted long, rid long, label long, lows binary, highs binary, v binary"
FOUND = "rid long, w int, score long, id long"


def vectors(rows: DataFrame, anchor: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(rid, id, label, anchor, v): the rows that take part, with whole numbers as components."""
    v = F.col(f"`{vector_col}`")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    some = rows.filter(F.col(f"`{label_col}`").isNotNull()).filter(fine)
    return some.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column as rows of doubles; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(float)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _bytes(matrix: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    matrix = np.ascontiguousarray(matrix)
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.itemsize * matrix.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(matrix)])


def _from_bytes(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The matrix that `_bytes` has written."""
    column = column.cast(pa.binary())
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for c in (c for c in chunks if len(c)):
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        out.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(c), -1))
    return np.concatenate(out) if out else np.zeros((0, 0), kind)


def _leaves(shared: Broadcast, width: int, kind: type) -> Callable:
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "id", "label")), pa.array(shared.value.leaf_of(v), pa.int32()), _bytes(v.astype(kind))], ["rid", "id", "label", "leaf", "v"])

    return placed


def _reached(shared: Broadcast, kind: type, rows: int) -> Callable:
    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the rows of a task, so many at a time, by leaf the least and the greatest distances to the split points above."""
        held: list[pa.RecordBatch] = []

        def told() -> pa.RecordBatch:
            leaf, v = (np.concatenate([f(b) for b in held]) for f in (lambda b: b.column("leaf").to_numpy(), lambda b: _from_bytes(b.column("v"), kind)))
            order = np.argsort(leaf, kind="stable")
            leaves, first = np.unique(leaf[order], return_index=True)
            found = [shared.value.reach(x, v[at].astype(float)) for x, at in zip(leaves.tolist(), np.split(order, first[1:]), strict=True)]
            sizes = [len(low) for low, _ in found]
            columns = np.repeat(leaves, sizes).astype(np.int32), np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]), *(np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["leaf", "at", "low", "high"])

        for batch in batches:
            held += [batch] * (batch.num_rows > 0)
            if sum(b.num_rows for b in held) >= rows:
                yield told()
                held.clear()
        if held:
            yield told()

    return reached


class Parts:
    """Parts of neighbouring leaves. By leaf: its first part, the parts that it is dealt over, and its bit in a part."""

    def __init__(self, counts: list[int], most: int):
        self.first, self.pieces, self.bit, self.leaves = [], [], [], []
        room = 0
        for leaf, n in enumerate(counts):
            pieces = max(1, -(-n // most))
            if not self.leaves or n > room or len(self.leaves[-1]) == PART_LEAVES:
                self.leaves += [[] for _ in range(pieces)]
                room = most if pieces == 1 else 0
            self.first.append(len(self.leaves) - pieces)
            self.pieces.append(pieces)
            self.bit.append(len(self.leaves[-1]))
            for own in self.leaves[self.first[leaf] :]:
                own.append(leaf)
            room -= n if pieces == 1 else 0


class Index:
    """The tree over all rows, and the rows with their leaves as a stored table."""

    def __init__(self, rows: DataFrame):
        """rows: as `vectors` gives them, stored. The sample is the SAMPLE rows whose numbers have the smallest hashes."""
        spark = rows.sparkSession
        norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
        n, width, radius2, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm2), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
        self.width = max(1, width or 0)
        if self.width > MOST_COMPONENTS:
            raise ValueError(f"vectors have at most {MOST_COMPONENTS} components")
        self.kind = np.int16 if (largest or 0) < 1 << 15 else np.int32
        # Scores are whole numbers, and no part of their sum is above the greatest square of a length.
        self.real = np.float32 if (radius2 or 0) < 1 << 24 else np.float64
        self.most = max(1, WIDEST // (self.width * np.dtype(self.kind).itemsize))
        sample = rows.orderBy(F.xxhash64("rid")).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
        sample = _matrix(sample, self.width)
        first = np.unique(sample, axis=0, return_index=True)[1] if sample.size else np.arange(len(sample))[:1]
        self.tree = Tree(sample[np.sort(first)], n, float(radius2 or 0), LEAF)
        shared = spark.sparkContext.broadcast(self.tree)
        placed = stored(rows.select("rid", "id", "label", "v").mapInArrow(_leaves(shared, self.width, self.kind), PLACED), "placed")
        reach = placed.select("leaf", "v").mapInArrow(_reached(shared, self.kind, min(4 * PART, self.most)), REACH).groupBy("leaf", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        counts, found = [0] * self.tree.leaves, {}
        for r in placed.groupBy("leaf").count().collect():
            counts[r["leaf"]] = r["count"]
            found[r["leaf"]] = (np.zeros(len(self.tree.paths[r["leaf"]]) * FANOUT), np.zeros(len(self.tree.paths[r["leaf"]]) * FANOUT))
        for r in reach.collect():
            found[r.leaf][0][r.at], found[r.leaf][1][r.at] = r.low, r.high
        self.tree.set_ranges(found)
        # A few groups for each task, as far as their sizes allow.
        parts = Parts(counts, min(self.most, PART, max(LEAF, n // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
        of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("leaf"))
        part = of(parts.first) + F.pmod(F.xxhash64("rid"), of(parts.pieces).cast("long")).cast("int")
        self.rows = placed.select(part.alias("part"), of(parts.bit).alias("bit"), "rid", "id", "label", "v")
        self.shared = spark.sparkContext.broadcast((self.tree, parts))

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """queries (rid, label, v, lows, highs), whose arrays hold the ends of one or more windows of scores -> (rid, w, nth,
        score, id): the first k other rows of the same or of another label in each window, by score and then id."""
        slots = max(1, -(-queries.count() // min(SLOT, self.most)))
        own = self._scanned(queries, True, same, k, slots)
        least = own.filter(F.col("nth") == k).groupBy("rid").agg(F.collect_list(F.struct("w", "score")).alias("least"))
        better = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.get(F.filter("least", lambda x: x["w"] == w), 0)["score"], low)))
        narrowed = queries.join(least, "rid", "left").select("rid", "label", "v", better.alias("lows"), "highs")
        others = self._scanned(stored(narrowed, "narrowed"), False, same, k, slots)
        return _first(own.drop("nth").unionByName(others.drop("nth")), k)

    def _scanned(self, queries: DataFrame, home: bool, same: bool, k: int, slots: int) -> DataFrame:
        """The first k rows of each window in the queries' own leaves, or in the others that may hold some. Queries are dealt
        over slots, and each part meets one slot at a time."""
        dealt = queries.withColumn("slot", F.pmod(F.xxhash64("rid"), F.lit(slots)).cast("int"))
        sent = dealt.mapInArrow(_sent(self.shared, self.width, self.kind, home), SENT)
        rows = self.rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        met = sent.groupBy("part", "slot").cogroup(rows.groupBy("part", "slot")).applyInArrow(_scan(self.kind, self.real, same, k), FOUND)
        return stored(_first(met, k), "found")


def _first(found: DataFrame, k: int) -> DataFrame:
    """By query and window the first k; Spark limits each task's rows before the shuffle."""
    order = W.partitionBy("rid", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def _sent(shared: Broadcast, width: int, kind: type, home: bool) -> Callable:
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                some, (tree, parts) = batch.slice(start, BLOCK), shared.value
                q = _matrix(some.column("v"), width)
                lows, highs = (_matrix(some.column(c), max(1, len(some.column(c)[0]))) for c in ("lows", "highs"))
                own = tree.leaf_of(q)
                if home:
                    wanted = own[:, None] == np.arange(tree.leaves)
                    wanted[(highs < lows).all(axis=1)] = False
                else:
                    wanted = tree.visits(q, to_query(q, highs, tree.radius2), np.where(highs < lows, -np.inf, to_query(q, lows, tree.radius2)))
                    wanted[np.arange(len(q)), own] = False
                slot, rids, labels = (some.column(c).to_numpy() for c in ("slot", "rid", "label"))
                lows, highs, q = lows.astype(np.int64), highs.astype(np.int64), q.astype(kind)
                for part, leaves in enumerate(parts.leaves):
                    bits = wanted[:, leaves] @ (1 << np.arange(len(leaves)))
                    at = np.flatnonzero(bits)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), *(pa.array(x[at]) for x in (slot, bits, rids, labels)), *(_bytes(x[at]) for x in (lows, highs, q))], [c.split()[0] for c in SENT.split(", ")])

    return sent


def _scan(kind: type, real: type, same: bool, k: int) -> Callable:
    """The queries of a slot against the rows of a part, leaf by leaf and block by block."""
    #: Whole numbers below it, which all scores are, are exact.
    end = 1 << (24 if real is np.float32 else 53)

    def scanned(sent: pa.Table, rows: pa.Table) -> pa.Table:
        of = lambda table, *names: (table.column(c).to_numpy() for c in names)
        q_rids, q_labels, wanted = of(sent, "rid", "label", "wanted")
        lows, highs = (_from_bytes(sent.column(c), np.int64) for c in ("lows", "highs"))
        rids, labels, bits = of(rows, "rid", "label", "bit")
        ids = rows.column("id").fill_null(_NO_ID).to_numpy()
        q, v = (_from_bytes(t.column("v"), kind) for t in (sent, rows))
        # The best of each query and window so far, best first.
        scores, found = np.full((*lows.shape, k), _LEAST), np.full((*lows.shape, k), _NO_ID)
        for bit in np.unique(bits).tolist():
            asks, own = np.flatnonzero(wanted >> bit & 1), np.flatnonzero(bits == bit)
            own = own[np.argsort(ids[own], kind="stable")]
            blocks = [(own[i : i + BLOCK], v[own[i : i + BLOCK]].astype(real).T) for i in range(0, len(own) if len(asks) else 0, BLOCK)]
            for first in range(0, len(asks), BLOCK):
                at = asks[first : first + BLOCK]
                q_at = q[at].astype(real)
                for row, v_row in blocks:
                    # Only what comes before the last of the best counts; a tie by a later id doesn't.
                    last = scores[at, :, -1]
                    low = np.where(last == _LEAST, lows[at], np.maximum(lows[at], last + (found[at, :, -1] <= ids[row[0]])))
                    fits = low <= highs[at]
                    least, most = (np.clip(x, -end, end).astype(real)[:, None] for x in (np.where(fits, low, _MOST).min(axis=1), np.where(fits, highs[at], _LEAST).max(axis=1)))
                    score = q_at @ v_row
                    i, j = np.nonzero((score >= least) & (score <= most))
                    right = ((q_labels[at[i]] == labels[row[j]]) == same) & (q_rids[at[i]] != rids[row[j]])
                    i, j = i[right], j[right]
                    s = score[i, j].astype(np.int64)
                    for w in range(lows.shape[1]):
                        inside = (s >= low[i, w]) & (s <= highs[at[i], w])
                        if inside.any():
                            _merge(scores[:, w], found[:, w], at[i[inside]], s[inside], ids[row[j[inside]]])
        of_query, w, nth = np.nonzero(scores != _LEAST)
        return pa.table([pa.array(q_rids[of_query], pa.int64()), pa.array(w, pa.int32()), pa.array(scores[of_query, w, nth], pa.int64()), pa.array(found[of_query, w, nth], pa.int64())], ["rid", "w", "score", "id"])

    return scanned


def _merge(scores: np.ndarray, found: np.ndarray, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Puts new rows among the best of their queries (queries by places), which keep their number."""
    k, whose = scores.shape[1], np.unique(query)
    query, score, ids = (np.concatenate(x) for x in ((np.repeat(whose, k), query), (scores[whose].ravel(), score), (found[whose].ravel(), ids)))
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    scores[whose], found[whose] = score[top].reshape(-1, k), ids[top].reshape(-1, k)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_positive: int = 5, n_negative: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """rows, and a condition that names the anchors -> (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): the positives are the anchor's first rows of its label, the negatives of each the first rows of other
    labels with window[0] % to window[1] % of the positive's score. Ids and labels are whole numbers.

    Rows with a null label, a null vector, or a component that is null or not finite take no part. Vectors of different
    lengths end in zeros, empty ones are all zeros; scaled components stop at LIMIT, which is 4096 unscaled. Equal scores go
    by id, null ids last; rows that repeat an id, or all of it, are rows of their own, also as anchors. Anchors without a
    positive and positives without a negative have no rows; a window under a score of zero or less is empty or that score.
    An empty table gives an empty result, and other columns may have any name."""
    session = rows.sparkSession
    rows = stored(vectors(rows, anchor, id_col, vector_col, label_col), "vectors", small_batches(session, BATCH))
    index = Index(rows)
    anchors = stored(rows.filter("anchor").select("rid", "id", "label", "v"), "anchors")
    ends = [F.array(F.lit(x).cast("long")) for x in (_LEAST, _MOST)]
    positives = stored(index.search(anchors.select("rid", "label", "v", ends[0].alias("lows"), ends[1].alias("highs")), True, n_positive), "positives")
    # Spark's integer division cuts towards zero; these are the least and the greatest whole score of the window.
    low = lambda p: F.call_function("div", p * window[0] + F.pmod(-p * window[0], F.lit(100)), F.lit(100))
    high = lambda p: F.call_function("div", p * window[1] - F.pmod(p * window[1], F.lit(100)), F.lit(100))
    each = F.transform(F.array_sort(F.collect_list(F.struct("nth", "score"))), lambda x: x["score"])
    padded = F.transform(F.sequence(F.lit(0), F.lit(n_positive - 1)), lambda i: F.get("p", i))
    windows = positives.groupBy("rid").agg(each.alias("p")).select("rid", padded.alias("p"))
    queries = windows.join(anchors, "rid").select("rid", "label", "v", F.transform("p", lambda p: F.coalesce(low(p), F.lit(_MOST))).alias("lows"), F.transform("p", lambda p: F.coalesce(high(p), F.lit(_LEAST))).alias("highs"))
    negatives = index.search(stored(queries, "windows"), False, n_negative)
    own = positives.select("rid", (F.col("nth") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    no_id = lambda c: F.nullif(F.col(c), F.lit(_NO_ID)).alias(c)
    out = negatives.select("rid", "w", F.col("nth").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(own, ["rid", "w"]).join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid")
    return stored(out.select("anchor_id", no_id("positive_id"), "rank", no_id("negative_id"), "positive_score", "negative_score"), "negatives", session)
