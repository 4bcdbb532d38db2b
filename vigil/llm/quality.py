"""Quality rules: a table of thresholds compiled into one Spark projection, with built-in functions only.

Every measure is an expression over the words and lines of the row, so there is no shuffle and no user function. The
repeated 8-word windows of a text are found by sorting its window hashes within the row; a row's work is n log n in its
own length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WS, words_of

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the and of to a in is that it with for was on are as be by this or from at an not but have he they we you i "
    "le la les de des du et un une en que qui dans pour est sur pas au avec par ce il elle ne se "
    "el los las del y o con una por para su al lo como es se más "
    "der die das und den von zu mit sich auf für ist nicht ein eine dem im auch als er sie"
).split()

#: (measure, least, most): a text is kept while every measure lies within its bounds. Measures are ratios, but the first.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("mean_word_chars", 1.5, 16),
    ("symbol_ratio", None, 0.25),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
)
WINDOW = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: what a lambda captures is otherwise evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more in the row. Where all window hashes are distinct there are none;
    else sort (hash, start), keep equal neighbours, sort the starts and add up what each window covers before the next
    one begins."""

    def doubled(step: int) -> Callable[[Column], Column]:
        """Hashes of windows of `step` words to those of twice as many."""
        return lambda h: F.zip_with(F.slice(h, 1, F.size(h) - step), F.slice(h, step + 1, F.size(h) - step), lambda x, y: F.xxhash64(x, y))

    def twice(found: Column) -> Column:
        at = lambda i: F.get(found, i)["h"]
        return F.transform(F.filter(found, lambda w, i: ((i > 0) & (at(i - 1) == w["h"])) | (at(i + 1) == w["h"])), lambda w: w["i"])

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def counted(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(_let(F.sort_array(_let(placed, twice)), covered))

    found = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        found = _let(found, doubled(step))
    return F.when(F.size(words) >= WINDOW, _let(found, counted)).otherwise(0)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add `_m`, a struct of measures of the text column. A null text has no words; its ratios are 0."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    base = docs.withColumn("_w", words_of(F.col(f"`{text_col}`"))).withColumn("_l", lines)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, n_lines = F.size("_w"), F.size("_l")
    chars, symbols = F.length(F.regexp_replace(text, WS, "")), F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    stops = F.size(F.filter("_w", lambda w: w.isin(sorted({v for x in STOP_WORDS for v in (x, x.capitalize(), x.upper())}))))
    dup = n_lines - F.size(F.array_distinct("_l"))
    counts = {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup,
        "n_repeat_words": _repeat_words(F.col("_w")),
    }
    ratios = {
        "mean_word_chars": ratio(chars, n),
        "symbol_ratio": ratio(symbols, chars),
        "stop_word_ratio": ratio(stops, n),
        "dup_line_ratio": ratio(dup, n_lines),
        "bullet_line_ratio": ratio(F.size(F.filter("_l", lambda x: F.regexp_like(x, F.lit(r"^[\x20\x09]*[-*•]")))), n_lines),
        "ellipsis_line_ratio": ratio(F.size(F.filter("_l", lambda x: F.regexp_like(x, F.lit(r"(\.\.\.|…)[\x20\x09]*$")))), n_lines),
    }
    measures = F.struct(*[v.cast("long").alias(k) for k, v in counts.items()], *[v.alias(k) for k, v in ratios.items()])
    return base.withColumn("_m", measures).drop("_w", "_l")


def verdict(rules: tuple[tuple[str, float | None, float | None], ...] = RULES, of: str = "_m") -> Column:
    """The rule table as one boolean expression."""
    tests = [F.col(f"{of}.{k}") >= F.lit(low) for k, low, _ in rules if low is not None] + [F.col(f"{of}.{k}") <= F.lit(high) for k, _, high in rules if high is not None]
    return reduce(lambda a, b: a & b, tests)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row: id, the measures, base_failed, kept. Null and empty texts fail; other columns may have any name."""
    rows = measured(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    failed = (F.col("_m.n_words") < 20) | (100 * F.col("_m.n_repeat_words") > 30 * F.col("_m.n_words"))
    return rows.select("id", "_m.*", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
