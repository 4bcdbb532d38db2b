"""Parts of pasted secrets in what is said later.

A secret that comes back whole is found by its value; half of one is not. Here secrets and turns are reduced to keyed hashes of
their runs of GRAM bytes, of which those with the smallest hash of every WINDOW neighbours are kept on both sides. So whatever
two texts share over GRAM + WINDOW - 1 bytes or more, they share a kept hash of it, and a quarter of all hashes is shuffled. The
key is made for the call; no text and no secret leaves the stage that reads it."""

from __future__ import annotations

import secrets as random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW = 12, 8
#: Shared runs that are always found have so many bytes.
SURE = GRAM + WINDOW - 1
#: Bytes of a text that are hashed in one go.
CHUNK = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kept_hashes(data: bytes, keys: tuple[int, int]) -> np.ndarray:
    """The hashes kept of a text, without repeats; of a text with fewer than WINDOW runs the smallest one, of one without a
    run none."""
    found = []
    for first in range(0, max(0, len(data) - GRAM + 1), CHUNK):
        w = np.frombuffer(data[first : first + CHUNK + SURE - 1], np.uint8).astype(np.uint64)
        for step in (1, 2, 4):
            w = w[:-step] | (w[step:] << np.uint64(8 * step))
        if len(w) <= GRAM - 8:
            break
        h = _mixed(_mixed(w[: len(w) - GRAM + 8] ^ np.uint64(keys[0])) + (w[GRAM - 8 :] ^ np.uint64(keys[1])))
        if len(h) < WINDOW:
            found.append(h.min(keepdims=True))
            break
        found.append(np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _reduced(keys: Broadcast) -> Callable:
    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [kept_hashes(t.encode() if isinstance(t, str) else t or b"", keys.value) for t in batch.column(batch.num_columns - 1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(each)), [len(h) for h in each]))
            hashes = np.concatenate(each) if each else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), pa.array(hashes.view(np.int64))], [*batch.schema.names[:-1], "hash"])

    return reduced


def echoed_parts(turns: DataFrame, pasted: DataFrame, least: int = 1) -> DataFrame:
    """turns (conv_id, turn, role, text), pasted (conv_id, turn, label, secret) of what users have pasted -> (conv_id, label,
    pasted_turn, echoed_turn, n_shared) of the assistant's later turns of the conversation that repeat a part of the secret, or
    all of it, and how many kept hashes they share; `least` of them at least.

    A part of SURE bytes is always found, one of fewer than GRAM never. Null and shorter texts and secrets share nothing;
    repeated rows count once. A very frequent secret is one row per conversation."""
    spark = turns.sparkSession
    keys = spark.sparkContext.broadcast((random.randbits(64), random.randbits(64)))
    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    # Hashed where it is read: the rows are grouped by hashes, not by secrets.
    own = pasted.select("conv_id", "label", F.col("turn").alias("pasted_turn"), "secret")
    own = own.mapInArrow(_reduced(keys), f"{kind(own, 'conv_id')}, {kind(own, 'label')}, {kind(own, 'pasted_turn')}, hash long").groupBy("conv_id", "label", "hash").agg(F.min("pasted_turn").alias("pasted_turn"))
    said = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("echoed_turn"), "text")
    said = said.mapInArrow(_reduced(keys), f"{kind(said, 'conv_id')}, {kind(said, 'echoed_turn')}, hash long").distinct()
    met = said.join(own, ["conv_id", "hash"]).filter("echoed_turn > pasted_turn")
    return met.groupBy("conv_id", "label", "echoed_turn").agg(F.min("pasted_turn").alias("pasted_turn"), F.count(F.lit(1)).alias("n_shared")).filter(F.col("n_shared") >= least).select("conv_id", "label", "pasted_turn", "echoed_turn", "n_shared")
