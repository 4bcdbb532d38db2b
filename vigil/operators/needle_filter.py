"""Which places of a text may hold a needle of a dictionary of any size: one filter of bounded size, one pass over the text.

The dictionary never reaches the text. Each needle is reduced to a keyed digest and to three entries of a Bloom filter: its
first eight bytes, these together with its length, and its digest. The filter, whose bits are counted out for the number of
needles, is all that is broadcast. A place of the text is tried by its eight bytes first, then by each length; only then are
bytes digested. What passes all three is a hit or nearly surely one; the equi-join with the digests decides. Neither side of
the join holds a byte of text or needle, and needles that share their first eight bytes, however many, are told apart by
length and digest before anything is shuffled.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = 8
#: Bits for an entry while there are enough, probes for an entry, and bits at most: a larger dictionary makes a denser
#: filter, which lets more places through to the join and changes no result.
BITS, PROBES, MOST_BITS = 16, 4, 1 << 28
#: Bytes of text that are looked at in one go.
CHUNK = 1 << 20
_DIGEST = 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _with_length(prefixes: np.ndarray, length: np.ndarray) -> np.ndarray:
    return _mixed(prefixes + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Filter:
    def __init__(self, words: np.ndarray, lengths: np.ndarray, key: bytes):
        self.words, self.lengths, self.key = words, lengths, key

    @staticmethod
    def slots(hashes: np.ndarray, n_words: int) -> list[np.ndarray]:
        """The bits of an entry, one array for each probe; n_words is a power of two."""
        step, mask = _mixed(hashes) | np.uint64(1), np.uint64(64 * n_words - 1)
        return [(hashes + np.uint64(k) * step) & mask for k in range(PROBES)]

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Indexes of the entries that may be in the filter; each probe is made for those that passed the last."""
        left = np.arange(len(hashes))
        step, mask = None, np.uint64(64 * len(self.words) - 1)
        for k in range(PROBES):
            at = hashes[left] & mask if k == 0 else (hashes[left] + np.uint64(k) * step) & mask
            fits = (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            left = left[fits]
            step = (_mixed(hashes[left]) | np.uint64(1)) if k == 0 else step[fits]
        return left

    def digest(self, data: bytes) -> bytes:
        return hashlib.blake2b(data, digest_size=_DIGEST, key=self.key).digest()

    def found(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(place, length, digest) of what passes the filter in texts that follow each other in `data` and stop at `ends`."""
        view = memoryview(data)
        for first in range(0, max(0, len(data) - PREFIX + 1), CHUNK):
            part = data[first : first + CHUNK + PREFIX - 1].astype(np.uint64)
            for step in (1, 2, 4):
                part = part[:-step] | (part[step:] << np.uint64(8 * step))
            at = self.may_hold(_mixed(part))
            prefixes, at = part[at], at + first
            room = ends[np.searchsorted(ends, at, side="right")] - at
            for length in self.lengths.tolist():
                some = np.flatnonzero(room >= length)
                some = some[self.may_hold(_with_length(prefixes[some], np.full(len(some), length)))]
                digests = [self.digest(view[i : i + length]) for i in at[some].tolist()]
                heads = np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)
                for k in self.may_hold(_mixed(heads)).tolist():
                    yield int(at[some[k]]), length, digests[k]


def _prefix(needle: bytes) -> int:
    return int.from_bytes(needle[:PREFIX], "little")


def _reduced(key: Broadcast) -> Callable:
    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = Filter(np.zeros(1, np.uint64), np.zeros(0, np.int64), key.value).digest
        for batch in batches:
            kept = [(n, label) for n, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if n is not None and len(n) >= PREFIX]
            needles, labels = zip(*kept, strict=True) if kept else ((), ())
            prefixes = np.array([_prefix(n) for n in needles], np.uint64)
            lengths = np.array([len(n) for n in needles], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([digest(n) for n in needles], pa.binary()), pa.array(labels, pa.string()), pa.array(lengths), pa.array(_mixed(prefixes).view(np.int64)), pa.array(_with_length(prefixes, lengths).view(np.int64))], ["digest", "label", "len", "one", "two"])

    return reduced


def _bits(n_words: int) -> Callable:
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = np.frombuffer(b"".join(d[:8] for d in batch.column("digest").to_pylist()), np.uint64)
            hashes = np.concatenate([batch.column(c).to_numpy().view(np.uint64) for c in ("one", "two")] + [_mixed(heads)])
            at = np.unique(np.concatenate(Filter.slots(hashes, n_words)))
            words, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "bits"])

    return bits


def reduced(needles: DataFrame, store: Callable[[DataFrame, str], DataFrame], most_bits: int = MOST_BITS) -> tuple[DataFrame, Broadcast]:
    """needles (needle binary, label) -> the stored table (digest, label) and the filter in a broadcast. The key of the digests
    is made for this call and known to its tasks only. What comes to the driver are the filter's bits, MOST_BITS at most, and
    the distinct lengths."""
    spark = needles.sparkSession
    key = spark.sparkContext.broadcast(secrets.token_bytes(32))
    entries = store(needles.select(F.col("needle").cast("binary").alias("needle"), "label").mapInArrow(_reduced(key), "digest binary, label string, len long, one long, two long"), "needles")
    n, lengths = entries.agg(F.count(F.lit(1)), F.array_sort(F.collect_set("len"))).first()
    n_words = 1
    while 64 * n_words < min(most_bits, 3 * BITS * n):
        n_words *= 2
    bits = entries.mapInArrow(_bits(n_words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n_words, np.uint64)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return entries.select("digest", "label"), spark.sparkContext.broadcast(Filter(words, np.array(lengths, np.int64), key.value))


def passed(shared: Broadcast) -> Callable:
    """Batches of (path, content, offset, own, size) to (path, start, len, digest): what passes the filter, at its place in
    the whole file. Of a range only places among its own bytes count; the ones after them are there to be read on."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column("content")
            bounds = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
            data = np.frombuffer(content.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if content.buffers()[2] and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
            ends = bounds[1:] - bounds[0]
            offset, own, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("offset", "own", "size"))
            most = int(shared.value.lengths.max(initial=0))
            if len(ends) and ((offset + np.diff(bounds) < size) & (np.diff(bounds) < own + most - 1)).any():
                raise ValueError(f"a range has to go on for {most - 1} bytes, the longest needle less one")
            rows, starts, lengths, digests = [], [], [], []
            for at, length, digest in shared.value.found(data, ends):
                row = int(np.searchsorted(ends, at, side="right"))
                start = at - int(bounds[row] - bounds[0])
                if start < own[row]:
                    rows.append(row)
                    starts.append(start + int(offset[row]))
                    lengths.append(length)
                    digests.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.binary())], ["path", "start", "len", "digest"])

    return search
