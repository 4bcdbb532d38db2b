"""Filter interaction audit: what each filter removes in every order, and its Shapley share.

A document matters only through the set of filters that it fails, so each part of the corpus is reduced to counts of the 32
sets. From them every coalition's removals are tabulated: how many documents at least one of its filters removes. The steps
of all orders are differences of two coalitions. Shapley shares solve the kernel-weighted least-squares problem over the
coalitions whose shares must add up to what all filters remove together; its normal equations are solved in rationals, so
the shares are exact whole numbers once they are summed over all orders.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The filters in the order of their bits.
FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
_UPPER = bytes(range(65, 91))
_SYMBOL = re.compile(r"[#$%&*|]")


def failed(text: str) -> int:
    """Bits of the filters A to D that a text fails. Bytes split at the six white-space characters, as words do."""
    data = text.encode()
    words = data.split()
    upper = len(data) - len(data.translate(None, _UPPER))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1 | (100 * upper > MOST_UPPER * len(text)) << 2 | (_SYMBOL.search(text) is not None) << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        masks = pa.array([failed(t) for t in texts], pa.int32())
        prints = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), masks, prints], ["id", "part", "mask", "print"])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask): the filters that each row fails. Filter E compares whole texts by SHA-256 over the whole table: a row
    fails where a smaller id has the same text; a null id is larger than all others. The join is a plain one, which Spark
    splits where one text is very frequent."""
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), part.alias("part"), F.col(f"`{text_col}`").alias("text"))
    rows = stored(rows.mapInArrow(_judged, f"id {rows.schema['id'].dataType.simpleString()}, part string, mask int, print binary"), "judged")
    firsts = stored(rows.groupBy("print").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("print", "first"), "firsts")
    later = F.when(F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(firsts, "print", "left").select("id", "part", F.col("mask").bitwiseOR(later).alias("mask"))


def shapley_weights(n: int) -> list[list[int]]:
    """For each of n players the n! fold of what each coalition's value, in the order of its bits, adds to the player's
    share: the inverse of the constrained normal equations, applied to the unit games.

    Minimise the sum over proper coalitions S of k(S) (v(S) - sum of shares in S)^2, with the shares adding up to v(all)."""
    every = range(1 << n)
    size = [s.bit_count() for s in every]
    kernel = [Fraction(n - 1, comb(n, size[s]) * size[s] * (n - size[s])) if 0 < size[s] < n else Fraction(0) for s in every]
    both = lambda i, j: sum((kernel[s] for s in every if s >> i & s >> j & 1), Fraction(0))
    # Unknowns: the shares and the multiplier of the constraint; right-hand sides: one column for each coalition.
    table = [[*(both(i, j) for j in range(n)), Fraction(1), *(kernel[s] * (s >> i & 1) for s in every)] for i in range(n)]
    table.append([*[Fraction(1)] * n, Fraction(0), *(Fraction(int(s == (1 << n) - 1)) for s in every)])
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if table[r][c])
        table[c], table[pivot] = table[pivot], table[c]
        table[c] = [x / table[c][c] for x in table[c]]
        for r in range(n + 1):
            if r != c and table[r][c]:
                table[r] = [x - table[r][c] * y for x, y in zip(table[r], table[c], strict=True)]
    shares = [[x * factorial(n) for x in row[n + 1 :]] for row in table[:n]]
    assert all(x.denominator == 1 for row in shares for x in row)
    return [[int(x) for x in row] for row in shares]


def coalitions(judged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """judged (id, part, mask), labels (id, quality, toxic) -> per part: total, and by coalition the arrays lost, good and
    toxic: rows that it removes, and of these the good and the toxic ones. An id with several labels counts as good or
    toxic if one of them says so; an id without is neither."""
    said = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]
    counts = judged.join(said, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *sums)
    each = counts.select("part", "mask", "n", "good", "toxic", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("s"))
    hit = F.col("mask").bitwiseAND(F.col("s")) != 0
    table = each.groupBy("part", "s").agg(F.sum("n").alias("total"), *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")])
    rows = table.groupBy("part").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("v"))
    return rows.select("part", "total", F.col("v.n").alias("lost"), F.col("v.good").alias("good"), F.col("v.toxic").alias("toxic"))


def _bits(letters: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)])


def steps(games: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    share = lambda w: F.aggregate(F.zip_with("lost", F.array(*map(F.lit, w)), lambda v, x: v * x), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = games.withColumn("shares", F.array(*[share(w) for w in shapley_weights(len(FILTERS))]))
    rows = rows.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumns({"before": _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)), "own": _bits(F.substring("filter_order", F.col("step"), F.lit(1)))})
    at = lambda values, s: F.get(F.col(values), s)
    before, own = F.col("before"), F.col("own")
    gone = lambda values: at(values, before + own) - at(values, before)
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - at("lost", before + own)).alias("kept"),
        gone("lost").alias("removed"),
        (at("lost", own) - gone("lost")).alias("redundant"),
        (at("lost", F.lit(ALL)) - at("lost", F.lit(ALL) - own)).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.get("shares", F.locate("1", F.reverse(F.bin(own))) - 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part (null and empty are one), order and step, zeros included.

    A null text is empty: it fails A only, and E where a smaller id has an empty text too. Very long texts are read whole.
    Rows that share the smallest id of a text pass E, all of them; repeated rows count as often as they occur. An empty table
    has no parts and no rows; null and repeated ids in `labels` are as `coalitions` says, and other columns may have any
    name."""
    return steps(coalitions(judged(docs, id_col, text_col, part_col), labels, id_col))
