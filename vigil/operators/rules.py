"""Lines against a table of regular expressions, few or thousands.

A few rules are one predicate each of a single pass. Of many, each gives up a literal that every match of it holds; an
Aho-Corasick automaton finds all literals of a line in one go, and only the rules whose literal is there, with those that have
none, are tried. So the work hardly depends on the number of rules. What decides is always the rule itself, as Spark reads it.
"""

from __future__ import annotations

import re
from re import _constants as code
from re import _parser

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that are tried one by one.
FEW = 32
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def literal(pattern: str) -> str:
    """The longest run of characters, A-Z in lower case, that every match of a pattern holds; empty if none is sure. Only what
    stands in a row on the outermost level counts: a choice, a class or an optional part ends a run."""
    try:
        parts = list(_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return ""  # not a pattern for this parser; it is tried on every line
    runs, run = [""], ""
    while parts:
        op, value = parts.pop(0)
        if op is code.LITERAL and value < 128:
            run += chr(value)
            continue
        if op is code.SUBPATTERN:
            parts[:0] = list(value[3])
            continue
        if op is code.AT:  # a boundary takes no character
            continue
        runs.append(run)
        run = ""
    return max([*runs, run], key=len).translate(_LOWER)


def rule_hits(lines: DataFrame, rules: list[tuple[str, str]], few: int = FEW) -> DataFrame:
    """lines (..., text) x rules (label, regex) -> a row per line and rule that matches, with its label. Lines that match none
    leave no row; labels may repeat."""
    if len(rules) <= few:
        hit = F.array_compact(F.array(*[F.when(F.regexp_like("text", F.lit(p)), F.lit(label)) for label, p in rules])) if rules else F.array().cast("array<string>")
        return lines.withColumn("label", F.explode(hit))
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast([literal(p) for _, p in rules])
    made: dict[str, tuple] = {}

    @F.pandas_udf("array<int>")
    def candidates(texts: pd.Series) -> pd.Series:
        if not made:
            by: dict[str, list[int]] = {}
            for i, x in enumerate(shared.value):
                by.setdefault(x, []).append(i)
            automaton = ahocorasick.Automaton()
            for x, own in by.items():
                if x:
                    automaton.add_word(x, own)
            automaton.make_automaton()
            made["all"] = (automaton, by.get("", []))
        automaton, always = made["all"]
        some = bool(len(automaton))
        return texts.map(lambda t: [] if t is None else sorted({i for _, own in automaton.iter(t.translate(_LOWER)) for i in own} | set(always)) if some else always)

    # The rules are a small table, which Spark broadcasts if it is below its own limit; a line meets its candidates only.
    table = spark.createDataFrame([(i, label, p) for i, (label, p) in enumerate(rules)], "_rule int, label string, _pattern string")
    tried = lines.withColumn("_rule", F.explode(candidates("text"))).join(table, "_rule")
    return tried.filter(F.regexp_like("text", F.col("_pattern"))).drop("_rule", "_pattern")
