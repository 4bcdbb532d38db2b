"""Licence scan: ordered signature rules, with built-in functions only.

Every rule of `licence_rules` is tried where one of its head words stands, and only there: a row's text is cut into words, the
places of head words are found, and the words from such a place on are matched against the few rules of that word. What
is found are intervals of words. One that lies within another of the same or a higher level is suppressed; of equal ones the
first rule stays. All of it is one projection over the row: no shuffle and no user function.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_rules import GRANT_HEADS, SPAN, Rule, compiled

#: Words of lower-cased text: runs of letters, digits and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RULES = "array<struct<ord:int,need:string,label:string,level:int,score:double,base:boolean,pattern:string>>"
_HITS = "array<struct<start:int,end:int,label:string,level:int,ord:int,score:double,base:boolean>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _literal(rules: list[Rule]) -> str:
    """The rules as SQL: one text is much sooner a literal than thousands of columns."""
    row = lambda r: f"named_struct('ord', {r.ord}, 'need', '{r.need}', 'label', '{r.label}', 'level', {r.level}, 'score', {r.score}D, 'base', {str(r.base).lower()}, 'pattern', r'^(?:{r.pattern})(?: |$)')"
    return f"array({', '.join(map(row, rules))})"


def _found(words: Column, rules: list[Rule]) -> Column:
    """Every interval of words that a rule matches, containers before what they hold."""
    heads = sorted({r.head for r in rules if r.head})
    notices = F.expr(_literal([r for r in rules if not r.head])) if any(not r.head for r in rules) else None
    by_head = F.expr(f"map({', '.join(f"'{h}', {_literal([r for r in rules if r.head == h])}" for h in heads)})")
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*heads, *GRANT_HEADS))

    def tried(i: Column, ahead: Column) -> Column:
        word = F.get(words, i)
        own = F.coalesce(F.try_element_at(by_head, word), F.array().cast(_RULES))
        if notices is not None:
            own = F.concat(own, F.when(word.isin(*GRANT_HEADS), F.filter(notices, lambda r: F.contains(ahead, r["need"]))).otherwise(F.array().cast(_RULES)))
        matched = F.filter(F.transform(own, lambda r: F.struct(r.alias("r"), F.rtrim(F.call_function("regexp_extract", ahead, r["pattern"], F.lit(0))).alias("m"))), lambda x: x["m"] != "")
        return F.transform(matched, lambda x: F.struct(i.alias("start"), (-(i + 1 + F.regexp_count(x["m"], F.lit(" ")))).alias("back"), (-x["r"]["level"]).alias("down"), x["r"]["ord"].alias("ord"), x["r"]["label"].alias("label"), x["r"]["score"].alias("score"), x["r"]["base"].alias("base")))

    each = F.transform(places, lambda i: _let(F.array_join(F.slice(words, i + 1, SPAN), " "), lambda ahead: tried(i, ahead)))
    ordered = F.array_sort(F.flatten(each))
    return F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["label"].alias("label"), (-x["down"]).alias("level"), x["ord"].alias("ord"), x["score"].alias("score"), x["base"].alias("base"))).cast(_HITS)


def _kept(hits: Column, levels: int = 4) -> Column:
    """The intervals that none before them, of the same or a higher level, reaches over. Hits are ordered by their start, the
    longer and the higher first, so that what holds one comes before it; the state is how far each level has reached."""
    start = F.struct(*[F.lit(0).alias(f"e{k}") for k in range(levels)], F.array().cast(_HITS).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        reach = F.element_at(F.array(*[acc[f"e{k}"] for k in range(levels)]), x["level"] + 1)
        further = [F.when(x["level"] >= k, F.greatest(acc[f"e{k}"], x["end"])).otherwise(acc[f"e{k}"]).alias(f"e{k}") for k in range(levels)]
        return F.struct(*further, F.when(x["end"] > reach, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(hits, start, step, lambda acc: acc["kept"])


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Per row: id, n_words, base (start, end, label of every base phrase), spans (start, end, label, level, ord, score, base
    of every detection that stays), base_labels, labels (sorted, distinct, both kinds), score (that of the surest detection that
    stays, 0 if there is none). Places are counted in words from 0.

    A null text is empty: no word, no span, score 0. Texts of any length are read whole; a row's work grows with its words and
    with its detections. Of rules that match the very same words the first stays; repeated rows are rows of their own. An empty
    table gives an empty result, and other columns may have any name."""
    rules = rules or compiled()
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.select("id", F.size("words").cast("long").alias("n_words"), F.when(F.size("words") > 0, _found(F.col("words"), rules)).otherwise(F.array().cast(_HITS)).alias("hits"))
    rows = rows.select("id", "n_words", F.filter("hits", lambda x: x["base"]).alias("base"), F.when(F.size("hits") > 0, _kept(F.col("hits"))).otherwise(F.array().cast(_HITS)).alias("spans"))
    names = lambda c: F.transform(c, lambda x: x["label"])
    return rows.select("id", "n_words", "base", "spans", F.array_sort(F.array_distinct(names("base"))).alias("base_labels"), F.array_sort(F.array_union(names("base"), names("spans"))).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("score"))
