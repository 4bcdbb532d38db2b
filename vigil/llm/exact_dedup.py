"""Exact dedup with counting quotient filters.

Each partition turns the fingerprints of its texts into a counting quotient filter (`quotient_filter`); slices of one name
merge without loss by their sorted remainders, so one shuffle of compact slices gives the count of each fingerprint in the
whole corpus. Only fingerprints with a count above one go on to byte verification: there the normalised texts themselves
are grouped, so two texts that merely share a fingerprint are never taken for equal.

A hot group of copies is one remainder with a counter per partition in the filters, and one row per map task in the
grouping of texts; the join that gives each copy its group is a plain equi-join, which Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import WS, stored


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bits: int | None = None) -> DataFrame:
    """One row per row of `docs`, dropped ones too.

    Returns id, text (as given), norm (normalised), rest (struct of the other columns), keep_id, group_size, kept. A
    null text is empty; all empty texts are one group. A null id sorts after all others. Where rows of one group share
    the smallest id, exactly one of them is kept. Texts of any length are compared whole. An empty table gives an empty
    result; other columns may have any name.
    """
    bits = slice_bits or qf.slice_bits_for(docs.count())
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("struct<none:int>")
    text = F.col(f"`{text_col}`")
    short = qf.short_print(F.xxhash64(normalised(text)), bits)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), rest.alias("rest"), short.alias("fp"))
    # Stored, so that its size is known: below its own threshold Spark broadcasts it and no text is shuffled here.
    repeats = stored(qf.repeated(docs.select(short.alias("fp"))).select("fp"), "repeats")
    alone = rows.join(repeats, "fp", "left_anti").withColumns({"norm": normalised(F.col("text")), "keep_id": F.col("id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    # The rows of repeated fingerprints are stored once, with numbers that tell rows that are equal in all columns apart.
    again = rows.join(repeats, "fp").withColumns({"norm": normalised(F.col("text")), "tie": F.xxhash64("text", F.to_json("rest")), "rid": F.monotonically_increasing_id()})
    again = stored(again.drop("fp"), "again")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "tie", "rid")
    # Stored too: a join of two plain shuffles is one that Spark can split where a group of copies is very large.
    groups = stored(again.groupBy("norm").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    again = again.join(groups, "norm").withColumns({"keep_id": F.col("first.id"), "kept": F.col("rid") == F.col("first.rid")})
    columns = ["id", "text", "norm", "rest", "keep_id", "group_size", "kept"]
    return alone.select(columns).unionByName(again.select(columns))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of equal normalised texts the one with the smallest id, null ids
    last; of rows that share it exactly one. Null and empty texts are one group. Very long texts are compared whole, an
    empty table stays empty, and other columns may have any name."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept")
    value = {id_col: F.col("id"), text_col: F.col("text")}
    return kept.select(*[value.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
