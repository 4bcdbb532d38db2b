"""Search for known credentials in every form they take when they leak, and redaction.

The text is never shuffled for the search: a filter of the dictionary goes to the text, and only hits move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import scratch
from . import needle_filter
from .scan import running

MIN_LINE = 20
#: Needles, and bytes of needles, that a broadcast may hold whole, for redaction in one pass.
PART, PART_BYTES = 200_000, 32 << 20


def dictionary(secrets: DataFrame) -> DataFrame:
    """secrets (secret string, label) -> needles (needle binary, label): raw, JSON, percent and base64 forms and the
    long lines of multi-line secrets, each of 8 bytes at least; too short and word-like secrets are left out."""
    s = secrets.select(T.trimmed(F.col("secret")).alias("secret"), "label").filter(T.searchability(F.col("secret")) == "searchable")
    c = F.col("secret")
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: T.trimmed(x)), lambda x: (F.octet_length(x) >= MIN_LINE) & ~x.startswith("-----") & F.contains(c, F.lit("\n")))
    forms = F.concat(F.array(c, T.form_json(c), T.form_percent(c), *T.base64_forms(c)), lines)
    out = s.select(F.explode(forms).alias("needle"), "label").filter(F.octet_length("needle") >= T.MIN_BYTES)
    return out.groupBy("needle").agg(F.min("label").alias("label")).select(F.col("needle").cast("binary").alias("needle"), "label")


class Matcher:
    """At every position the longest needle that starts there; a table of 8-byte prefixes rules out the others."""

    def __init__(self, needles: list[tuple[bytes, str]]):
        self.by_prefix: dict[int, list[tuple[bytes, str]]] = {}
        for needle, label in sorted(needles, key=lambda x: (-len(x[0]), x[0])):
            self.by_prefix.setdefault(int.from_bytes(needle[:8], "little"), []).append((needle, label))
        self.prefixes = np.sort(np.fromiter(self.by_prefix, np.uint64, len(self.by_prefix)))

    def find(self, data: bytes) -> Iterator[tuple[int, int, str]]:
        if len(data) < 8 or not len(self.prefixes):
            return
        w = np.frombuffer(data, np.uint8).astype(np.uint64)
        for step in (1, 2, 4):
            w = w[:-step] | (w[step:] << np.uint64(8 * step))
        at = np.searchsorted(self.prefixes, w)
        for i in np.flatnonzero(self.prefixes[np.minimum(at, len(self.prefixes) - 1)] == w).tolist():
            for needle, label in self.by_prefix[int(w[i])]:
                if data.startswith(needle, i):
                    yield i, len(needle), label
                    break


def leaks(outputs: DataFrame, needles: DataFrame) -> DataFrame:
    """outputs (path, content) -> (path, label) of each known credential that an output gives away; none should."""
    return find_known(outputs, needles).select("path", "label").distinct()


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def redact_rows(rows: DataFrame, needles: DataFrame) -> DataFrame:
    """rows (path, content) -> (path, content binary, n_redacted) of every row, with known credentials replaced. One pass
    without a shuffle and without state while the dictionary fits one broadcast, PART needles of PART_BYTES together; `rows`
    may then be a stream. A larger one is searched by its filter, for which a stream has to come batch by batch."""
    spark, kind = rows.sparkSession, rows.schema["path"].dataType.simpleString()
    # The dictionary is read once, partition by partition, and no further than what may be shared.
    few, size = [], 0
    for r in needles.limit(PART + 1).toLocalIterator():
        few.append((bytes(r.needle), r.label))
        size += len(r.needle)
        if len(few) > PART or size > PART_BYTES:
            if rows.isStreaming:
                raise ValueError(f"more than {PART} needles or {PART_BYTES} bytes: redact the batches of the stream")
            return _redact_by_hits(rows, needles)
    shared = spark.sparkContext.broadcast(few)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            out, counts = [], []
            for data in batch.column(1).to_pylist():
                parts, stop, n = [], 0, 0
                for start, length, label in matcher.find(data) if data else ():
                    if start >= stop:  # hits that overlap are one span
                        parts += [data[stop:start], f"[REDACTED:{label}]".encode()]
                        n += 1
                    stop = max(stop, start + length)
                out.append(None if data is None else b"".join([*parts, data[stop:]]))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(counts, pa.int64())], ["path", "content", "n_redacted"])

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(cut, f"path {kind}, content binary, n_redacted long")


def _redact_by_hits(rows: DataFrame, needles: DataFrame) -> DataFrame:
    """As redact_rows, for a dictionary of any size. Rows are numbered, as paths may repeat, and written once; of them only
    those with a hit meet their spans in a join."""
    numbered = _stored(rows.select(F.monotonically_increasing_id().alias("rid"), "path", F.col("content").cast("binary").alias("content")), "numbered")
    files = numbered.select(F.col("rid").alias("path"), "content")
    spans = _stored(merge_hits(find_known(files, needles)), "spans")
    cut = redact(files, spans).select(F.col("path").alias("rid"), F.col("content").alias("redacted"), "n_redacted")
    whole = numbered.join(spans.select(F.col("path").alias("rid")).distinct(), "rid", "left_anti")
    changed = cut.join(numbered.select("rid", "path"), "rid")
    return whole.select("path", "content", F.lit(0).cast("long").alias("n_redacted")).unionByName(changed.select("path", F.col("redacted").alias("content"), "n_redacted"))


def find_known(files: DataFrame, needles: DataFrame, most_bits: int = needle_filter.MOST_BITS) -> DataFrame:
    """files (path, content) -> hits (path, start, len, label): at every place the longest needle that starts there; offsets
    are bytes. A null content has none. A dictionary of any size is one scan of the files, see `needle_filter`.

    Files may come in ranges, as `ranges.read_ranges` gives them: (path, offset, own, size, content). Hits are then at their
    place in the whole file, and each is found once, in the range that its first byte belongs to."""
    ranged = "offset" in files.columns
    digests, shared = needle_filter.reduced(needles, _stored, most_bits)
    content = F.col("content").cast("binary")
    where = {c: F.col(c) for c in ("offset", "own", "size")} if ranged else {"offset": F.lit(0), "own": F.length(content), "size": F.length(content)}
    rows = files.filter(F.length(content) >= needle_filter.PREFIX).select("path", content.alias("content"), *[v.cast("long").alias(c) for c, v in where.items()])
    passed = rows.mapInArrow(needle_filter.passed(shared), f"path {files.schema['path'].dataType.simpleString()}, start long, len long, digest binary")
    hits = passed.join(digests, "digest").groupBy("path", "start").agg(F.max(F.struct("len", "label")).alias("best"))
    return hits.select("path", "start", "best.len", "best.label")


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hits that overlap become one span with the first label; spans that only touch stay apart. How far the hits before one
    reach is a blocked scan, so a document with very many hits is spread over tasks; so is the start of its span."""
    order, end = ["start", "len", "label"], F.col("start") + F.col("len")
    hits = _stored(hits.select("path", *order), "hits")  # a scan reads its rows twice
    rows = running(hits, ["path"], "start", order, before=True, reach=("max", end))
    fresh = F.when(F.col("reach").isNull() | (F.col("start") >= F.col("reach")), F.col("start"))
    rows = running(rows.select("path", *order, fresh.alias("fresh")), ["path"], "start", order, span=("max", F.col("fresh")))
    merged = rows.groupBy("path", "span").agg(F.max(end).alias("stop"), F.min_by("label", F.struct(*order)).alias("label"))
    return merged.select("path", F.col("span").alias("start"), (F.col("stop") - F.col("span")).alias("len"), "label")


def count_known(spans: DataFrame) -> DataFrame:
    return spans.groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"))


def search_totals(files: DataFrame, spans: DataFrame, secrets: DataFrame) -> DataFrame:
    """One row: files searched, occurrences, files with hits, labels found; credentials searched for, and how many were not,
    as too short or weak (word-like). secrets (secret) are the distinct credentials."""
    hit = spans.agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("path").alias("files_with_hits"), F.count_distinct("label").alias("labels"))
    kind = secrets.select(T.trimmed(F.col("secret")).alias("secret")).distinct().select(T.searchability(F.col("secret")).alias("kind"))
    searched = kind.agg(*[F.count_if(F.col("kind") == k).alias(name) for k, name in (("searchable", "credentials"), ("too_short", "too_short"), ("weak", "weak"))])
    return files.agg(F.count(F.lit(1)).alias("files")).crossJoin(hit).crossJoin(searched)


def redact(files: DataFrame, spans: DataFrame) -> DataFrame:
    """files (path, content) with each span replaced by [REDACTED:label]: (path, content binary, n_redacted). Files
    without a span aren't returned. Paths are unique."""
    each = spans.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "len", "label"))).alias("spans"))
    rows = files.select("path", F.col("content").cast("binary").alias("content")).join(each, "path")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, at = [], 0
                for s in found:
                    parts += [data[at : s["start"]], f"[REDACTED:{s['label']}]".encode()]
                    at = s["start"] + s["len"]
                out.append(b"".join([*parts, data[at:]]))
            n = pa.array([len(x) for x in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), n], ["path", "content", "n_redacted"])

    return rows.mapInArrow(cut, f"path {rows.schema['path'].dataType.simpleString()}, content binary, n_redacted long")
