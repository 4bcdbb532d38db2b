"""Running values down very long documents.

A window over one document sorts it in one task. Here a document is cut into blocks of its own order: each block is first
reduced to one row, a window over those few rows gives what every block takes over from the ones before it, and a window
within each block does the rest. One huge document is as many tasks as it has blocks; the result is that of the plain window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Lines, bytes or positions of a block.
BLOCK = 1 << 16


def running(rows: DataFrame, by: list[str], at: str, order: list[str], before: bool = False, block: int | None = None, **values: tuple[str, Column]) -> DataFrame:
    """`rows` with a column for each of `values`, a name and (kind, column): the running "max", the running "sum" or the "last"
    value that isn't null, over the rows of the same `by` up to this one, or up to the one before it if `before`.

    `at` is a whole number that never falls in the order of `order`, which it heads; blocks are ranges of it. Keys may be null.
    Rows with equal order take any turn among themselves, as in a window."""
    block = block or BLOCK
    names, key = list(values), [*by, "_block"]
    rows = rows.withColumns({"_block": F.floor(F.col(at) / block).cast("long")} | {f"_{n}": c for n, (_, c) in values.items()})
    turn = F.struct(*order)

    def total(name: str) -> Column:
        kind, v = values[name][0], F.col(f"_{name}")
        return (F.max(v) if kind == "max" else F.sum(v) if kind == "sum" else F.max_by(v, F.when(v.isNotNull(), turn))).alias(f"_{name}_all")

    def along(name: str, v: Column, w: W) -> Column:
        kind = values[name][0]
        return F.max(v).over(w) if kind == "max" else F.sum(v).over(w) if kind == "sum" else F.last(v, ignorenulls=True).over(w)

    blocks = rows.groupBy(*key).agg(*[total(n) for n in names])
    earlier = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    taken = blocks.select(*[F.col(k).alias(f"_of_{k}") for k in key], *[along(n, F.col(f"_{n}_all"), earlier).alias(f"_{n}_taken") for n in names])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in key])
    within = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    joined = rows.join(taken, same)

    def whole(name: str) -> Column:
        own, old = along(name, F.col(f"_{name}"), within), F.col(f"_{name}_taken")
        kind = values[name][0]
        return F.greatest(own, old) if kind == "max" else F.coalesce(own, old) if kind == "last" else F.when(own.isNull() & old.isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(old, F.lit(0)))

    out = joined.withColumns({n: whole(n) for n in names})
    return out.drop(*[f"_of_{k}" for k in key], "_block", *[x for n in names for x in (f"_{n}", f"_{n}_taken")])
