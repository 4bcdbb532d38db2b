"""From raw documents to token ids: drop toxic texts, exact copies and near copies, mix the sources, encode.

Each stage takes what its predecessor kept, as a table with the columns of `documents`; the last one returns one row per
document of the mix with its token count and the digests of its ids and of the bytes they decode to. A document that the
mix takes twice is two rows. Stages are written as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, exact_dedup, mixing, simhash, toxicity
from vigil.llm.common import documents, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents not predicted toxic, as `toxicity.clean` has it: null and empty texts stay, equal texts share one verdict,
    long ones are scored whole, an empty table stays empty, and other columns are carried along."""
    return toxicity.clean(docs, documents(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal normalised texts, that of the smallest id, null ids last; null and empty texts are one
    group. See `exact_dedup.deduplicated` for ties, repeated rows, long texts and other columns."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, that of the smallest id, null ids last; texts without a word are one. See
    `simhash.deduplicated` for ties, repeated rows, long texts and other columns."""
    return simhash.deduplicated(docs, size=5, budget=24, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as `mixing.planned` says: null sources are one source, rows with equal ids take the same draw, null
    and empty texts follow the rate of their source, and a source without a word has no copies."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row, repeated ones too: null and empty texts have no token, long ones are encoded in chunks, and an
    empty table gives an empty result. Of the columns only the id is carried along."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("bpe", encode),
]

#: SQL can't express the classifier, the fingerprints or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
