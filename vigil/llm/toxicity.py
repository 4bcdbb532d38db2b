"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams, so misspellings that were never seen share vectors with
those that were. A bag is a draw of words of one text; the mean of their vectors goes into a linear softmax, and both are
trained together. A word's margin is the log-odds that the two give it alone. A toxic text holds a few such words among
many harmless ones, so its evidence is the mean over all its words of what each margin has beyond `cut`, a high quantile of
the margins of clean words. The last layer maps the evidence to a probability; its threshold comes from labelled rows that
the embeddings were not trained on.

Training takes a bounded sample of labelled rows: at most PER_CLASS rows of each class, by the hash of the id, and whole
texts of at most MAX_BYTES in all. Scoring is one pass over all texts without a shuffle, with a model of fixed size.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, stored

_WORD = re.compile(r"\w+")
BUCKETS, DIM, BAG, LIMIT = 1 << 15, 8, 24, 0.7
GRAMS = (3, 4, 5, 6)
#: Labelled rows of class 0 and of class 1 that training may take, at most, and bytes of their texts.
PER_CLASS, MAX_BYTES = (3000, 1500), 64 << 20
#: One labelled row in CALIBRATE sets the threshold and trains nothing else; what a false alarm costs against a miss there.
CALIBRATE, ALARM = 3, 2
QUANTILE = 0.998
#: Distinct words whose margins a task remembers; beyond it, it starts anew. Characters of a word that are hashed at once.
REMEMBER, PIECE = 300_000, 4096


def words_in(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(word: str) -> Iterator[list[int]]:
    """Buckets of all character 3- to 6-grams of <word> and of the word itself, a long word piece by piece."""
    w = f"<{word}>"
    yield [zlib.crc32(w.encode()) % BUCKETS]
    for at in range(0, len(w), PIECE):
        yield [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(at, min(at + PIECE, len(w) - n + 1))]


@dataclass
class Model:
    """The margin (log-odds) of each bucket, where a word's margin begins to count, and the threshold of the evidence."""

    margins: np.ndarray
    cut: float
    threshold: float
    constant: float | None = None

    def of_word(self, word: str) -> float:
        total, n = 0.0, 0
        for ids in subwords(word):
            total, n = total + float(self.margins[ids].sum()), n + len(ids)
        return total / n

    def evidence(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        """The mean over the words of each text of max(margin - cut, 0); 0 without words."""
        if len(known) > REMEMBER:
            known.clear()
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            words = words_in(text)
            for w in set(words).difference(known):
                known[w] = max(self.of_word(w) - self.cut, 0.0)
            if words:
                out[i] = sum(map(known.__getitem__, words)) / len(words)
        return out

    def score(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = 4 * np.log((self.evidence(texts, known) + self.threshold / 10) / (1.1 * self.threshold)) + np.log(LIMIT / (1 - LIMIT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def embed(texts: list[str], y: np.ndarray, steps: int = 600, batch: int = 128, rate: float = 200.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The margins of all buckets, trained on bags drawn from both classes alike, and those of the distinct words of the
    clean texts."""
    rnd = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in dict.fromkeys(words_in(t))], np.int32) for t in texts]
    packed, n_grams = array("i"), np.zeros(len(vocabulary), np.int64)
    for i, w in enumerate(vocabulary):
        for ids in subwords(w):
            packed.extend(ids)
            n_grams[i] += len(ids)
    del vocabulary
    grams, first = np.frombuffer(packed, np.int32), np.cumsum(n_grams) - n_grams
    sides = [[i for i, d in enumerate(docs) if len(d) and y[i] == k] for k in (True, False)]
    E, W, b = rnd.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), rnd.uniform(-1, 1, (DIM, 2)), np.zeros(2)
    target = np.repeat([1, 0], batch // 2)
    for at in range(steps) if all(sides) else ():
        pick = np.concatenate([rnd.choice(side, batch // 2) for side in sides])
        bags = [docs[i] if len(docs[i]) <= BAG else docs[i][rnd.integers(0, len(docs[i]), BAG)] for i in pick]
        sizes = np.array([len(x) for x in bags])
        used, back = np.unique(np.concatenate(bags), return_inverse=True)
        n = n_grams[used]
        flat = grams[np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        vectors = np.add.reduceat(E[flat], np.cumsum(n) - n) / n[:, None]
        bag = np.add.reduceat(vectors[back], np.cumsum(sizes) - sizes) / sizes[:, None]
        z = bag @ W + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), target] -= 1
        dword, down = np.repeat(p @ W.T / sizes[:, None], sizes, axis=0), rate * (1 - at / steps) / batch
        for k in range(DIM):
            own = np.bincount(back, dword[:, k], len(used)) / n
            E[:, k] -= down * np.bincount(flat, np.repeat(own, n), BUCKETS)
        W, b = W - 0.05 * bag.T @ p, b - 0.01 * p.sum(0)
    margins = E @ (W[:, 1] - W[:, 0])
    clean = np.unique(np.concatenate([docs[i] for i in sides[1]])) if sides[1] else np.zeros(0, np.int64)
    n = n_grams[clean]
    flat = grams[np.repeat(first[clean] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return margins, (np.add.reduceat(margins[flat], np.cumsum(n) - n) / n if len(clean) else np.zeros(1))


def threshold(x: np.ndarray, y: np.ndarray) -> float:
    """The evidence at which misses and false alarms cost least; the middle of equals."""
    values = np.unique(x)
    middles = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values + 1e-6
    missed = np.searchsorted(np.sort(x[y]), middles)
    alarms = (~y).sum() - np.searchsorted(np.sort(x[~y]), middles)
    cost = missed + ALARM * alarms
    best = np.flatnonzero(cost == cost.min())
    return max(float(middles[best[len(best) // 2]]), 1e-6)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit on whole texts. With one class only, every text gets a score that says so. Where a class has under six rows, no
    row is kept apart for the threshold."""
    y = np.asarray(labels, bool)
    if y.all() or not y.any():
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 0.98 if len(y) and y.all() else 0.02)
    nth = np.where(y, np.cumsum(y), np.cumsum(~y)) - 1
    apart = nth % CALIBRATE == 0 if min(y.sum(), (~y).sum()) >= 6 else np.zeros(len(y), bool)
    own = np.flatnonzero(~apart)
    margins, clean = embed([texts[i] for i in own], y[own], seed=seed)
    model = Model(margins, float(np.quantile(clean, QUANTILE)), 1.0)
    judged = np.flatnonzero(apart) if apart.any() else own
    model.threshold = threshold(model.evidence([texts[i] for i in judged], {}), y[judged])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, wanted: Column, per_class: tuple[int, int] = PER_CLASS, max_bytes: int = MAX_BYTES) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most per_class[k] rows of class k, and max_bytes of text, among the labelled ids that
    `wanted` admits, those with the least hash. An id with both labels is left out; of rows with equal ids the least text
    counts."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & wanted).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    known = known.filter("toxic = other").select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("at"))
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A little more than is wanted, so that what comes to the driver doesn't grow with the table or its partitions.
    most = F.lit(0)
    for k, n in total.items():
        most = F.when(F.col("toxic") == k, int((1 << 30) * min(1.0, (1.2 * per_class[k] + 50) / n))).otherwise(most)
    some = sorted(known.filter(F.col("at") < most).collect(), key=lambda r: (r["at"], r.doc_id))
    ids = [(r.doc_id, r.toxic) for k in (0, 1) for r in [r for r in some if r.toxic == k][: per_class[k]]]
    table = docs.sparkSession.createDataFrame(ids, "of long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(table), F.col("doc_id") == F.col("of"))
    rows = stored(rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")), "labelled")
    # Rows of both classes in turn, up to the bound of bytes.
    sizes = {r.doc_id: r.n for r in rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()}
    nth, order = {0: 0, 1: 0}, []
    for doc_id, toxic in ids:
        if doc_id in sizes:
            order.append((nth[toxic] / per_class[toxic], toxic, doc_id))
            nth[toxic] += 1
    taken, used = [], 0
    for _, _, doc_id in sorted(order):
        used += sizes[doc_id]
        if used <= max_bytes:
            taken.append(doc_id)
    if len(taken) < len(order):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in taken], "of long")), F.col("doc_id") == F.col("of"), "left_semi")
    found = sorted(rows.collect(), key=lambda r: r.doc_id)
    return [r.text or "" for r in found], [r.toxic for r in found]


def scorer(spark, model: Model):
    """A column function: text -> score. The model has a fixed size and is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            parts = [shared.value.score(texts.iloc[at : at + 500].tolist(), known) for at in range(0, len(texts), 500)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return lambda text: score(F.coalesce(text, F.lit("")))


def not_held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 3 != 1


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row of `docs`.

    Null and empty texts have no evidence and get the least score. Very long texts and words are scored whole. Rows with
    equal ids are rows of their own; equal texts have equal scores. Labels of null ids, or other than 0 and 1, are not used,
    nor are ids with both labels. Without labels of both classes all texts get one score. An empty table gives an empty
    result; other columns may have any name."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    model = train(*training_rows(own, labels, not_held_out(F.col("doc_id"))))
    score = scorer(docs.sparkSession, model)
    out = own.select(F.col("doc_id").alias("id"), (~not_held_out(F.col("doc_id"))).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns. Null and empty texts stay, rows with equal
    ids or texts are judged one by one and alike, and other columns may have any name; an empty table stays empty."""
    model = train(*training_rows(docs.select("doc_id", "text"), labels, not_held_out(F.col("doc_id"))))
    return docs.filter(scorer(docs.sparkSession, model)(F.col("text")) < LIMIT)
