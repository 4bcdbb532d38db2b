"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap; the chunks are rows, so they are pre-tokenised in parallel. The pre-token
pattern looks forward only, so once two neighbouring chunks begin a pre-token at one place, all that follows is equal:
there they are stitched. The last pre-token of a chunk may be cut short and doesn't count. Where two chunks don't meet
within their overlap (a run longer than it), the text is pre-tokenised again from the last sure place. Pieces are then
encoded by their ranks; decoding joins the bytes of the ids. Texts of one chunk need no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 32768, 512
#: Distinct pre-tokens whose ids a task remembers; beyond it, it starts anew.
REMEMBER = 200_000


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Ids of pre-tokens by their ranks. A pre-token that stands alone splits into itself, so the library's own merges
    apply to it as a whole."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.find, self.known = read_ranks(path), regex.compile(pattern), {}
        self.bytes = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.merged = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

    def encode(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = self.merged(p)
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def stitched(chunks: list[tuple[int, str]], find: regex.Pattern) -> list[str]:
    """The pre-tokens of a text from overlapping chunks (offset, chunk), in order."""
    return stitched_from([(at, text, [m.start() + at for m in find.finditer(text)]) for at, text in chunks], find)


def stitched_from(chunks: list[tuple[int, str, list[int]]], find: regex.Pattern) -> list[str]:
    """The same where each chunk comes with the starts of its pre-tokens in the whole text."""
    pieces: list[str] = []
    at, text, starts = chunks[0]
    for n, nxt, begins in chunks[1:]:
        sure = starts[:-1]  # the last pre-token may go on behind the chunk
        meet = max(set(sure).intersection(begins), default=None)
        if meet is None:
            whole = text + nxt[at + len(text) - n :]
            last = starts[-1] if starts else at
            text, starts = whole, [*sure, *(m.start() + last for m in find.finditer(whole[last - at :]))]
            continue
        cut = [s - at for s in starts if s <= meet]
        pieces += [text[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        at, text, starts = n, nxt, [s for s in begins if s >= meet]
    cut = [*(s - at for s in starts), len(text)]
    return pieces + [text[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _batch(keys: pa.Array, ids: list[list[int]], decoded: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids, decoded) for each row of `docs`: token ids array<int> and the bytes that they decode to.

    A null text is empty; an empty text has no ids. Rows with equal ids are rows of their own. An empty table gives an
    empty result; other columns may have any name. The rank file is read by each worker from `path`, which must exist
    on every executor.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [bpe.encode(bpe.find.findall(t)) for t in some.column(1).to_pylist()]
                yield _batch(some.column(0), ids, [bpe.decode(x) for x in ids])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                begin = some.column(2).to_pylist()
                found = [[m.start() + b for m in find.finditer(t)] for b, t in zip(begin, some.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.list_(pa.int64()))], ["row", "id", "begin", "text", "starts"])

    def joined(table: pa.Table) -> pa.Table:
        bpe = Encoder(path, pattern)
        table = table.sort_by("begin")
        parts = zip(table["begin"].to_pylist(), table["text"].to_pylist(), table["starts"].to_pylist(), strict=True)
        ids = bpe.encode(stitched_from(list(parts), bpe.find))
        return pa.Table.from_batches([_batch(table["id"].combine_chunks().slice(0, 1), [ids], [bpe.decode(ids)])])

    whole = rows.filter(F.length("text") <= chunk).mapInArrow(short, f"id {kind}, ids array<int>, decoded binary")
    long = rows.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    begins = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk)))
    cut = long.select("row", "id", "text", begins.alias("begin")).select("row", "id", F.col("begin").cast("long").alias("begin"), F.substring("text", F.col("begin") + 1, F.lit(chunk + overlap)).alias("text"))
    found = cut.mapInArrow(starts, f"row long, id {kind}, begin long, text string, starts array<long>")
    return whole.unionByName(found.groupBy("row").applyInArrow(joined, f"id {kind}, ids array<int>, decoded binary"))
