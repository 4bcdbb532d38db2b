"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source (one row per source leaves each map task). Targets come from water filling: each source
gets min(limit, level * weight), with the level at which the targets add up to the wanted total. A document of a source
with rate r = target / size is emitted floor(r) times, plus once more if a hash of its id, seeded, falls below the
fraction. Nothing is sorted or gathered by source, so a source with a third of all rows is no special case; the table
of sources has one row per source and joins as such (Spark broadcasts it only while it is below its own threshold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD

WEIGHTS = (3.0, 1.0, 2.0)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add `target` to (source, source_size): weights repeat over the sources by code point, null last.

    The sources are ranked by limit / weight. If the first k are held at their limits, the rest share what remains by
    weight; k is right where that level lies below the next ratio. All of it is window sums over one row per source.
    """
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    limits = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    limits = limits.withColumn("ratio", F.col("limit") / F.col("weight"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    left = F.greatest(total - F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.lit(0.0))
    # From the first source that isn't held on, all levels are this one; held sources stop at their limit anyway.
    limits = limits.withColumn("level", left / F.sum("weight").over(after)).withColumn("place", F.row_number().over(by_ratio))
    open_level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(W.partitionBy())["level"]
    limits = limits.withColumn("open_level", open_level)
    return limits.select("source", "source_size", F.coalesce(F.least("limit", F.col("open_level") * F.col("weight")), F.col("limit")).alias("target"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(seed:id); the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """`docs` as (id, rest, source, size, source_size, target, copies): how often each document enters the mix.

    A null or empty text has size 0; its copies follow the same rate. Null sources are one source. A source of size 0
    has target 0 and no copies. Rows with equal ids take the same draw. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"))
    sums = docs.select(F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sums, weights, share, most).withColumnRenamed("source", "of")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (draw(F.col("id"), seed) < rate - whole).cast("long")
    return rows.join(goals, F.col("source").eqNullSafe(F.col("of"))).select("id", "rest", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: each row of `docs`, with all its columns, as often as planned."""
    out = planned(docs, **options).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
