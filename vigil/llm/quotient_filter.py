"""Counting quotient filters as rows: fingerprints of a partition as compact slices that merge without loss.

A fingerprint of SLICE bits and `inner` bits below them goes to the slice that its first bits name. Within a slice the next
bits are the quotient, the rest the remainder. A slice keeps one bit per possible quotient (occupied), its remainders in
order of quotient and remainder, one bit per remainder that ends the run of its quotient, one that tells whether a counter
follows, and the counters above one as varints. How many bits the quotient has follows from the number of fingerprints in
the slice, so a slice of few is a few bytes. Quotient and remainder together give the fingerprint back, so slices of one
name merge as sorted sequences whose equal members add their counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a fingerprint within its slice.
INNER = 30
SCHEMA = "slice long, n int, occupied binary, ends binary, counted binary, remainders binary, counters binary"
#: Fingerprints that a task gathers before it adds up equal ones.
GATHER = 1 << 21


def added(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints with the sum of their counts. The stable sort merges runs that are sorted already."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, int)
    return prints[first], (np.add.reduceat(counts, first) if len(first) else counts)


def varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, low ones first; the top bit says that more follow."""
    out = bytearray()
    for v in values.tolist():
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def from_varints(data: bytes) -> np.ndarray:
    out, v, shift = [], 0, 0
    for byte in data:
        v |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(v)
            v, shift = 0, 0
    return np.array(out, np.int64)


def quotient_bits(n: int) -> int:
    return max(0, n.bit_length() - 1)


def packed(low: np.ndarray, counts: np.ndarray) -> tuple[bytes, ...]:
    """The sorted distinct inner fingerprints of one slice and their counts as (occupied, ends, counted, remainders,
    counters)."""
    bits = quotient_bits(len(low))
    r = INNER - bits
    quotient, remainder = low >> r, low & ((1 << r) - 1)
    occupied = np.zeros(1 << bits, bool)
    occupied[quotient] = True
    ends = np.r_[quotient[1:] != quotient[:-1], True]
    more = counts > 1
    kind = np.uint16 if r <= 16 else np.uint32
    return np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(more).tobytes(), remainder.astype(kind).tobytes(), varints(counts[more])


def unpacked(n: int, occupied: bytes, ends: bytes, counted: bytes, remainders: bytes, counters: bytes) -> tuple[np.ndarray, np.ndarray]:
    bits = quotient_bits(n)
    r = INNER - bits
    flags = lambda data, size: np.unpackbits(np.frombuffer(data, np.uint8), count=size).astype(bool)
    ended = flags(ends, n)
    run = np.cumsum(ended) - ended  # how many runs end before each remainder
    quotient = np.flatnonzero(flags(occupied, 1 << bits))[run]
    counts = np.ones(n, np.int64)
    counts[flags(counted, n)] = from_varints(counters)
    return (quotient << r) | np.frombuffer(remainders, np.uint16 if r <= 16 else np.uint32).astype(np.int64), counts


def _longs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)


def _build(values: Callable[[pa.RecordBatch], np.ndarray] = _longs):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, counts, more, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            more.append(values(batch))
            size += len(more[-1])
            if size > GATHER:
                prints, counts = added(np.concatenate([prints, *more]), np.concatenate([counts, np.ones(size, np.int64)]))
                more, size = [], 0
        prints, counts = added(np.concatenate([prints, *more]), np.concatenate([counts, np.ones(size, np.int64)]))
        name = prints >> INNER
        cuts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(prints) else np.zeros(0, int)
        stops, low = np.r_[cuts[1:], len(prints)].astype(int), prints & ((1 << INNER) - 1)
        for at in range(0, len(cuts), 4096):
            some = list(zip(cuts[at : at + 4096].tolist(), stops[at : at + 4096].tolist(), strict=True))
            parts = list(zip(*(packed(low[a:b], counts[a:b]) for a, b in some), strict=True))
            columns = [pa.array(name[cuts[at : at + 4096]]), pa.array([b - a for a, b in some], pa.int32()), *(pa.array(p, pa.binary()) for p in parts)]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "n", "occupied", "ends", "counted", "remainders", "counters"])

    return build


def _merged(table: pa.Table) -> pa.Table:
    """The slices of one name -> its fingerprints with a count above one."""
    parts = [unpacked(*row) for row in zip(*(table[k].to_pylist() for k in table.column_names[1:]), strict=True)]
    low, counts = added(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))
    again = counts > 1
    name = table["slice"][0].as_py()
    return pa.table({"fp": pa.array((name << INNER) | low[again]), "copies": pa.array(counts[again])})


def slice_bits_for(n_rows: int, per_slice: int = 4000) -> int:
    """Bits of the name of a slice that give each merged slice about per_slice fingerprints; grows with the table."""
    return min(32, max(6, (n_rows // per_slice).bit_length()))


def short_print(full: Column, slice_bits: int) -> Column:
    """The first bits of a 64-bit hash, as many as the filter keeps."""
    return F.shiftrightunsigned(full, 64 - INNER - slice_bits)


def repeated(prints: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray] = _longs) -> DataFrame:
    """(fp, copies) of the fingerprints, made by `short_print`, that occur more than once in the one column of `prints`, or in
    what `values` takes from its batches.

    Each task's filter is a few bytes for each distinct fingerprint, whatever its count; a slice holds a bounded share of
    the distinct fingerprints from each task, so no fingerprint makes a group large."""
    return prints.mapInArrow(_build(values), SCHEMA).groupBy("slice").applyInArrow(_merged, "fp long, copies long")
