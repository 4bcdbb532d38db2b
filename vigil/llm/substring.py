"""Substring dedup by level-wise doubling of word windows.

Level 1 looks at windows of half the length. Of these only the winnowed ones are taken: a full window holds `half + 1` half
windows and its anchor is the one with the least hash (the last of equals), which depends on the words of the window alone,
so equal windows always have equal anchors and none is missed. Neighbouring windows with one anchor form a run, one row of
the shuffle instead of one row per word. Anchors that start in two documents survive.

Level 2 extends the survivors alone to twice the length: only texts that hold a surviving anchor are read again, and only
windows around such anchors are hashed. A run that is equal as a whole to a run of a smaller document is settled at once, and
only the first document of each kind of run still has its single windows compared. There the windows have the wanted
length and no candidate is left to extend.

Runs and windows are grouped by hash with minimum and maximum of the ids, pre-aggregated before the shuffle, and joined
back with plain equi-joins, which Spark splits where a passage stands in very many documents. Keys are pairs of 64-bit
hashes (anchor and run, anchor and window).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, stored, words_of

WINDOW = 50
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
SPANS = "array<struct<start:int,n:int>>"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ordered pair."""
    x = a * _A + ((b << np.uint64(29)) | (b >> np.uint64(35))) * _B
    x ^= x >> np.uint64(32)
    x *= _C
    return x ^ (x >> np.uint64(29))


def grown(h: np.ndarray, length: int, to: int) -> np.ndarray:
    """Hashes of all windows of `to` words from those of `length` words, by doubling; the last step may overlap."""
    while length < to:
        step = min(length, to - length)
        h, length = mixed(h[:-step], h[step:]), length + step
        if not len(h):
            break
    return h


def last_least(h: np.ndarray, wide: int) -> np.ndarray:
    """For each i the position of the least of h[i : i + wide], the last of equals; by doubling."""
    least, at, length = h, np.arange(len(h)), 1
    while length < wide:
        step = min(length, wide - length)
        right = least[step:] <= least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        length += step
    return at


def runs_of(flat: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(anchor hash, words from the run's start to its anchor, first window, number of windows) of all runs; ends: for each
    word, its document's end."""
    half = window // 2
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    if len(flat) < window:
        return none
    h_half = grown(flat, 1, half)
    n_full = len(flat) - window + 1
    anchor = last_least(h_half, window - half + 1)[:n_full]
    valid = np.arange(n_full) + window <= ends[:n_full]
    starts = valid & np.r_[True, (anchor[1:] != anchor[:-1]) | ~valid[:-1]]
    first = np.flatnonzero(starts)
    if not len(first):
        return none
    return h_half[anchor[first]], anchor[first] - first, first, np.add.reduceat(valid.astype(np.int64), first)


def _flat(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def _anchors(window: int):
    """(id, t, hashes) -> a row for each run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                flat, offsets = _flat(some, 2)
                anchor, ahead, first, n = runs_of(flat, np.repeat(offsets[1:], np.diff(offsets)), window)
                doc = np.searchsorted(offsets, first, side="right") - 1
                small = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), some.column(0).take(pa.array(doc)), some.column(1).take(pa.array(doc)), small(first - offsets[doc]), small(n), small(ahead)],
                    ["anchor", "id", "t", "start", "n", "ahead"],
                )

    return rows


def _around(some: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """(id, t, hashes, runs) -> anchor, start, n, ahead of all runs, the row of each, its offset in the words of all rows, and
    the hashes of all full windows."""
    flat, offsets = _flat(some, 2)
    runs = some.column(3)
    inner = runs.offsets.to_numpy().astype(np.int64)
    fields = runs.values.slice(inner[0], inner[-1] - inner[0])
    doc = np.repeat(np.arange(len(runs)), np.diff(inner))
    h_full = grown(grown(flat, 1, window // 2), window // 2, window)
    return *(fields.field(k).to_numpy(zero_copy_only=False) for k in range(4)), doc, offsets[doc], h_full


def _extended(window: int):
    """The runs of surviving anchors with a hash of their full windows: the first, the last and how they lie."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                anchor, start, n, ahead, doc, offset, h_full = _around(some, window)
                shape = (ahead.astype(np.int64) * (window + 1) + n).astype(np.uint64)
                run = mixed(mixed(h_full[offset + start], h_full[offset + start + n - 1]), shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(run.view(np.int64)), some.column(0).take(pa.array(doc)), some.column(1).take(pa.array(doc)), pa.array(start), pa.array(n), pa.array(ahead)], ["anchor", "run", "id", "t", "start", "n", "ahead"]
                )

    return rows


def _windows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                anchor, start, n, _, doc, offset, h_full = _around(some, window)
                each = np.repeat(np.arange(len(n)), n)
                s = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                owner = doc[each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[each]), pa.array(h_full[s + offset[each]].view(np.int64)), some.column(0).take(pa.array(owner)), some.column(1).take(pa.array(owner)), pa.array(s.astype(np.int32))],
                    ["anchor", "win", "id", "t", "start"],
                )

    return rows


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) -> (id, n_words, n_removed, kept)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            totals, removed, kept = [], [], []
            for text, spans in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                totals.append(len(words))
                if spans:
                    edges = np.zeros(len(words) + 1, np.int32)
                    for span in spans:
                        edges[span["start"]] += 1
                        edges[span["start"] + span["n"]] -= 1
                    left = np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()
                    removed.append(len(words) - len(left))
                    words = [words[i] for i in left]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (id, t, text) -> (id, t, spans): the word spans of windows that also start in a document of smaller id. Rows with
    equal id and t are equal."""
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    rows = docs.filter(F.col("id").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    run = F.struct("anchor", "start", "n", "ahead")

    def with_runs(runs: DataFrame) -> DataFrame:
        """The texts that have such runs. Sets, so that rows which are equal don't add up."""
        each = stored(runs.groupBy("id", "t").agg(F.collect_set(run).alias("runs")), "places")
        wanted = rows.sparkSession.sparkContext.broadcast(bitmap(each.select("t")))

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(wanted.value, batch.column(1).to_numpy(zero_copy_only=False))))

        # Texts that the filter rules out aren't shuffled.
        texts = rows.select("id", "t", "text").mapInArrow(some, f"id {kind}, t long, text string")
        return texts.join(each, ["id", "t"]).select("id", "t", _hashes(F.col("text")).alias("h"), "runs")

    level = stored(rows.select("id", "t", _hashes(F.col("text")).alias("h")).mapInArrow(_anchors(window), f"anchor long, id {kind}, t long, start int, n int, ahead int"), "anchors")
    alive = level.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("anchor")
    runs = with_runs(level.join(stored(alive, "alive"), "anchor")).mapInArrow(_extended(window), f"anchor long, run long, id {kind}, t long, start int, n int, ahead int")
    runs = stored(runs, "runs")
    kinds = stored(runs.groupBy("anchor", "run").agg(F.min("id").alias("first"), F.max("id").alias("last")), "kinds")
    many = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = kinds.join(many, "anchor").filter("first < last or kinds > 1")
    found = stored(runs.join(kinds.select("anchor", "run", "first", "kinds"), ["anchor", "run"]), "found")
    whole = found.filter(F.col("id") > F.col("first")).select("id", "t", "start", (F.col("n") + window - 1).alias("n"))
    leads = found.filter((F.col("id") == F.col("first")) & (F.col("kinds") > 1))
    single = stored(with_runs(leads).mapInArrow(_windows(window), f"anchor long, win long, id {kind}, t long, start int"), "windows")
    firsts = single.groupBy("anchor", "win").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    late = single.join(firsts.select("anchor", "win", "first"), ["anchor", "win"]).filter(F.col("id") > F.col("first"))
    spans = whole.unionByName(late.select("id", "t", "start", F.lit(window).alias("n")))
    return spans.groupBy("id", "t").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept) for each row of `docs`: kept is the text left, its words joined by one space.

    Null and empty texts have no words. A row with a null id loses nothing and makes no other row lose words. Rows with
    equal ids don't count as smaller than each other. Texts shorter than the window stay whole; very long ones are read whole.
    An empty table gives an empty result; other columns may have any name.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"))
    spans = repeated_spans(rows, window)
    out = rows.join(spans, ["id", "t"], "left").select("id", "text", "spans")
    return out.mapInArrow(_without, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept string")
