"""LM scoring with Brown class-based bigrams, the classes of words found by exchange clustering.

The most frequent words, CORE of them at most, are clustered on the driver: their bigram counts are a matrix of fixed size,
and exchange moves one word at a time to the class that raises the likelihood of the class bigrams most, until none moves.
All other words of the training text, however many, are then exchanged once in Spark: the contexts of each word (states
before and after) are counted, and the word goes to the class under which they are likeliest. So every word has a class, and
what is gathered (counts, contexts, classes) grows with the input. A text has

    log10 P = sum of log10 P(class | state before) + log10 P(word | class)

with both parts smoothed. The state is the class of the word before where that word is in the core, `rare` where it isn't,
and `end` at the start. A word that wasn't seen in training may be of any class. Counts and classes of the HEAD most frequent
words at most are broadcast; all other tokens are joined with the vocabulary by an equi-join, so none of it is left out. None
of those words can be hot: each has less than 1 / HEAD of the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, most_frequent, stored

HEAD, CORE, CLASSES = 100_000, 2000, 48
#: States before a word: the classes of core words, a word outside the core, the start of a text.
RARE, END, STATES = CLASSES, CLASSES + 1, CLASSES + 2
#: Distinct words or contexts that a task counts before it passes them on.
REMEMBER = 300_000
ADD = 0.1
#: Head words whose contexts are one row of a task's output.
SLICE = 512
_SPACES = "[\x09-\x0d\x20]+"


def words_of_batch(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case, and where those of each text end."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), _SPACES)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(flat, "")
    kept = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    return flat.filter(full), kept[offsets[1:] - offsets[0]]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Sums:
    """Counts by key, added up within a task and passed on when there are too many keys."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.rows = names, [], 0

    def add(self, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        table = pa.table(columns, names=self.names).group_by(self.names[:-1]).aggregate([("n", "sum")])
        self.parts.append(pa.table([table[k] for k in self.names[:-1]] + [table["n_sum"]], names=self.names))
        self.rows += table.num_rows
        if self.rows > REMEMBER:
            whole = self._whole()
            if whole.num_rows > REMEMBER // 2:
                yield from whole.to_batches()
                self.parts, self.rows = [], 0
            else:
                self.parts, self.rows = [whole], whole.num_rows

    def _whole(self) -> pa.Table:
        table = pa.concat_tables(self.parts).group_by(self.names[:-1]).aggregate([("n", "sum")])
        return pa.table([table[k] for k in self.names[:-1]] + [table["n_sum"].cast(pa.int64())], names=self.names)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self._whole().to_batches()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums(["word", "n"])
    for some in _slices(batches):
        words, _ = words_of_batch(some.column(0))
        found = words.value_counts()
        yield from sums.add([found.field("values"), found.field("counts")])
    yield from sums.rest()


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of the one text column."""
    return texts.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, classes: int, end: int, sweeps: int = 50) -> np.ndarray:
    """Classes of the items by exchange: each item in turn goes to the class that raises the likelihood of the class
    bigrams most, until a sweep moves none or, as each move raises it, it has grown by less than a millionth. The item `end`
    keeps the last class to itself."""
    n_items = len(bigrams)
    free = classes - 1
    totals = bigrams.sum(1)
    order = np.argsort(-totals, kind="stable")
    order = order[order != end]
    own = np.full(n_items, free)
    own[order] = np.arange(len(order)) % free
    onehot = np.eye(classes)[own]
    # Of each item: counts with the class after and before it, a block of rows at a time.
    right, left = np.zeros((n_items, classes)), np.zeros((n_items, classes))
    for at in range(0, n_items, 256):
        block = bigrams[at : at + 256].astype(float)
        right[at : at + 256] = block @ onehot
        left += block.T @ onehot[at : at + 256]
    M = onehot.T @ right
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    likelihood = lambda: f(M).sum() - f(M.sum(1)).sum() - f(M.sum(0)).sum()
    before = likelihood()
    for _ in range(sweeps):
        moved = 0
        for w in order:
            r, l, self_, a = right[w].copy(), left[w].copy(), float(bigrams[w, w]), own[w]
            if not (r.any() or l.any()):
                continue
            r[a], l[a] = r[a] - self_, l[a] - self_  # with the others of its class only
            M[a] -= r
            M[:, a] -= l
            M[a, a] -= self_
            # A word has few classes before and after it; the others' cells don't change.
            after, prior = np.flatnonzero(r), np.flatnonzero(l)
            gain = (f(M[:, after] + r[after]) - f(M[:, after])).sum(1) + (f(M[prior] + l[prior, None]) - f(M[prior])).sum(0)
            d = np.diag(M)
            gain += f(d + r + l + self_) - f(d + r) - f(d + l) + f(d)
            for total, new in ((M.sum(1), r.sum() + self_), (M.sum(0), l.sum() + self_)):
                gain -= f(total + new) - f(total)
            b = int(np.argmax(gain[:free]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            M[b] += r
            M[:, b] += l
            M[b, b] += self_
            if b != a:
                own[w], moved = b, moved + 1
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        now = likelihood()
        if not moved or now - before < 1e-6 * abs(before):
            break
        before = now
    return own


class _Finder:
    """The place of each word in a list of words, null where it isn't in it."""

    def __init__(self, words: pa.Array):
        self.words = words

    def __call__(self, words: pa.Array) -> np.ndarray:
        """-1 for a word that isn't in the list. Each distinct word is looked up once."""
        coded = words.dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)


def _sequence(items: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    """One sequence of all texts: the end item, then the items of each text and the end item again."""
    return np.r_[end, np.insert(items, ends, end)]


def _core_bigrams(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = shared.value
        n, find = len(core) + 2, _Finder(core)  # rare words share one item, then the end
        sums = _Sums(["pair", "n"])
        for some in _slices(batches):
            words, ends = words_of_batch(some.column(0))
            items = find(words)
            seq = _sequence(np.where(items < 0, n - 2, items), ends, n - 1)
            pairs, counts = np.unique(seq[:-1] * n + seq[1:], return_counts=True)
            yield from sums.add([pa.array(pairs), pa.array(counts)])
        yield from sums.rest()

    return rows


CONTEXTS = "word string, context int, n long, slice int, ids binary, counts binary"


def _contexts(shared):
    """Counts of the states before and after words outside the core. For words outside the head, rows (word, context, n) with
    context = state * STATES + state after; for the others, rows (slice, ids, counts) of SLICE words, dense."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes = shared.value
        n_core, width = len(classes), 2 * STATES
        find, state = _Finder(head), np.r_[classes, np.full(len(head) - n_core, RARE), RARE].astype(np.int64)  # the place -1 is the last
        dense = np.zeros((len(head) - n_core) * width, np.int32)
        sums = _Sums(["word", "context", "n"])

        def wide(some: pa.RecordBatch) -> pa.RecordBatch:
            none = [pa.nulls(some.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*(some.column(k) for k in ("word", "context", "n")), *none], ["word", "context", "n", "slice", "ids", "counts"])

        for some in _slices(batches):
            words, ends = words_of_batch(some.column(0))
            items = find(words)
            seq = _sequence(state[items], ends, END)
            place = np.arange(len(items)) + 1 + np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
            before, after = seq[place - 1], seq[place + 1]
            mid = items >= n_core
            np.add.at(dense, (items[mid] - n_core) * width + before[mid], 1)
            np.add.at(dense, (items[mid] - n_core) * width + STATES + after[mid], 1)
            at = np.flatnonzero(items < 0)
            context = (before[at] * STATES + after[at]).astype(np.int32)
            for out in sums.add([words.take(pa.array(at)), pa.array(context), pa.array(np.ones(len(at), np.int64))]):
                yield wide(out)
        for out in sums.rest():
            yield wide(out)
        dense = dense.reshape(-1, width)
        for k in range(0, len(dense), SLICE):
            ids = np.flatnonzero(dense[k : k + SLICE].any(1)) + k
            if len(ids):
                none = [pa.nulls(1, t) for t in (pa.string(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([k // SLICE], pa.int32()), pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([dense[ids].tobytes()], pa.binary())], ["word", "context", "n", "slice", "ids", "counts"])

    return rows


def _best(before: np.ndarray, after: np.ndarray, logs: tuple[np.ndarray, ...]) -> np.ndarray:
    """The class of each word from its counts of states before and after: that under which they are likeliest."""
    log_to, log_from, log_size = logs  # P(class | state before), P(state after | class), tokens of a class
    return (before @ log_to + after @ log_from.T - before.sum(1)[:, None] * log_size)[:, : CLASSES - 1].argmax(1)


def _sum_of(table: pa.Table, kind: type) -> tuple[int, np.ndarray, np.ndarray]:
    """The first id, ids and counts of the rows of one slice, added up."""
    total, first = np.zeros((SLICE, 2 * STATES), np.int64), table["slice"][0].as_py() * SLICE
    for ids, counts in zip(table["ids"], table["counts"], strict=True):
        total[np.frombuffer(ids.as_buffer(), np.int32) - first] += np.frombuffer(counts.as_buffer(), kind).reshape(-1, 2 * STATES)
    own = np.flatnonzero(total.any(1))
    return first, own, total[own]


def _added_slices(table: pa.Table) -> pa.Table:
    """Rows of one slice -> one row of the same form, with counts of 64 bits."""
    first, own, total = _sum_of(table, np.int32)
    return pa.table({"slice": table["slice"].slice(0, 1), "ids": [(own + first).astype(np.int32).tobytes()], "counts": [total.tobytes()]})


def _placed_slices(shared):
    """The rows of one slice -> (ids, classes, steps): the classes of its words, and counts of (state before, class)."""

    def rows(table: pa.Table) -> pa.Table:
        first, own, total = _sum_of(table, np.int64)
        before, after = total[:, :STATES].astype(float), total[:, STATES:].astype(float)
        classes = _best(before, after, shared.value)
        steps = np.zeros((CLASSES, STATES))
        np.add.at(steps, classes, before)
        return pa.table({"ids": [(own + first).tobytes()], "classes": [classes.tobytes()], "steps": [steps.T.tobytes()]})

    return rows


def _placed_words(shared):
    """Rows (word, n, contexts: list of (context, n)) -> (word, n, class, contexts)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches, 2000):
            lists = some.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            inner = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            context, n = inner.field(0).to_numpy(zero_copy_only=False), inner.field(1).to_numpy(zero_copy_only=False)
            word = np.repeat(np.arange(len(lists)), np.diff(offsets))
            before, after = (np.bincount(word * STATES + c, n, len(lists) * STATES).reshape(-1, STATES) for c in (context // STATES, context % STATES))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(_best(before, after, shared.value).astype(np.int32)), lists], ["word", "n", "class", "contexts"])

    return rows


class Model:
    """All of fixed size: head words with their counts and classes, transitions, and totals of the classes."""

    def __init__(self, head: pa.Array, counts: np.ndarray, classes: np.ndarray, n_core: int, steps: np.ndarray, sizes: np.ndarray, kinds: np.ndarray, n_docs: int):
        """steps: counts of (state, class), the class of the end last; sizes, kinds: tokens and distinct words by class."""
        self.head, self.counts, self.classes, self.n_core, self.n_docs = head, counts, classes, n_core, n_docs
        self.n, self.kinds = int(sizes.sum()), int(kinds.sum())
        share = (steps.sum(0) + 1) / (steps.sum() + CLASSES)
        self.log_step = np.log10((steps + 20 * share) / (steps.sum(1, keepdims=True) + 20))
        self.log_room = np.log10(sizes + ADD * (kinds + 1))  # P(word | class) = (count + ADD) / room
        self.log_base_room = np.log10(self.n + ADD * (self.kinds + 1))
        # An unseen word may be of any class, each of which keeps ADD for it.
        self.log_unseen = np.log10((10.0**self.log_step * ADD / 10.0**self.log_room).sum(1))


SCHEMA = "rid long, id {}, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<struct<word:string,state:int>>"


def _scores(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        find = _Finder(m.head)
        log_count = np.r_[np.log10(m.counts + ADD), np.log10(m.n_docs + ADD), np.log10(ADD)]  # head words, the end, others
        end, other = len(m.counts), len(m.counts) + 1
        of_class = np.r_[m.classes, CLASSES - 1, 0].astype(np.int64)
        state = np.r_[m.classes[: m.n_core], np.full(len(m.classes) - m.n_core, RARE), END, RARE].astype(np.int64)
        for some in _slices(batches):
            words, ends = words_of_batch(some.column(3))
            items = find(words)
            items[items < 0] = other
            seq = _sequence(items, ends, end)
            before, now = state[seq[:-1]], seq[1:]
            tail = now == other
            step = np.where(tail, m.log_unseen[before], m.log_step[before, of_class[now]] + log_count[now] - m.log_room[of_class[now]])
            base = log_count[now] - m.log_base_room
            starts = np.r_[0, ends[:-1]] + np.arange(len(ends))
            n_tokens = np.diff(np.r_[0, ends]) + 1
            n_tail = np.add.reduceat(tail.astype(np.int64), starts) if len(starts) else n_tokens
            n_known = n_tokens - n_tail - (0 if m.n_docs else 1)
            place = np.flatnonzero(tail)
            held = pa.StructArray.from_arrays([words.filter(pa.array(items == other)), pa.array(before[place].astype(np.int32))], ["word", "state"])
            tails = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_tail)].astype(np.int32)), held)
            sums = [np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (base, step)]
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(n_tokens), pa.array(n_known), *map(pa.array, sums), tails], ["rid", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"])

    return rows


def _log_rows(counts: np.ndarray, add: float = 0.5) -> np.ndarray:
    return np.log((counts + add) / (counts + add).sum(1, keepdims=True))


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the one text column, and the words outside its head: (word, n, class)."""
    spark = texts.sparkSession
    words = stored(vocabulary(texts), "vocabulary")
    top = most_frequent(words, "n", HEAD).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    head, counts = top["word"].combine_chunks(), top["n"].to_numpy()
    n_core = min(CORE, len(counts))
    core = head.slice(0, n_core)
    n = n_core + 2
    pairs = texts.mapInArrow(_core_bigrams(spark.sparkContext.broadcast(core)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros(n * n, np.int64)
    bigrams[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    bigrams = bigrams.reshape(n, n)
    del pairs
    n_docs = int(bigrams[:, n - 1].sum())
    # The rare words' item is no word: it takes part in no class, but stays beside them as a state.
    known = np.r_[np.arange(n_core), n - 1]
    classes = exchange(bigrams[np.ix_(known, known)], CLASSES, n_core)[:n_core] if n_core else np.zeros(0, np.int64)
    state = np.r_[classes, RARE, END].astype(np.int64)
    both = np.zeros((STATES, STATES))
    np.add.at(both, (np.repeat(state, n), np.tile(state, n)), bigrams.ravel())
    # Other words: likelihoods of what stands before and after, from the core's classes.
    sizes = np.bincount(classes, counts[:n_core], CLASSES) if n_core else np.zeros(CLASSES)
    kinds = np.bincount(classes, minlength=CLASSES).astype(float)
    shared = spark.sparkContext.broadcast((_log_rows(both[:, :CLASSES]), _log_rows(both[:CLASSES]), np.log(sizes + 1)))
    found = stored(texts.mapInArrow(_contexts(spark.sparkContext.broadcast((head, classes))), CONTEXTS), "contexts")
    own, steps = np.r_[classes, np.zeros(len(counts) - n_core, np.int64)], np.zeros((STATES, CLASSES))
    steps[:, : CLASSES - 1] = both[:, : CLASSES - 1]
    steps[:, CLASSES - 1] = both[:, END]
    # Each task has a row for each slice; they are added up in two steps, so that no group holds a row of every task.
    some = F.pmod(F.spark_partition_id(), F.lit(max(1, int(len(found.inputFiles()) ** 0.5)))).alias("some")
    dense = found.filter("slice is not null").select("slice", "ids", "counts", some)
    dense = dense.groupBy("slice", "some").applyInArrow(lambda table: _added_slices(table.drop_columns("some")), "slice int, ids binary, counts binary")
    for r in dense.groupBy("slice").applyInArrow(_placed_slices(shared), "ids binary, classes binary, steps binary").collect():
        ids, new = np.frombuffer(r.ids, np.int64) + n_core, np.frombuffer(r.classes, np.int64)
        own[ids] = new
        steps += np.frombuffer(r.steps).reshape(STATES, CLASSES)
        np.add.at(sizes, new, counts[ids])
        np.add.at(kinds, new, 1)
    # A word has at most STATES * STATES contexts, however often it occurs.
    tail = found.filter("word is not null").select("word", "context", "n").repartition("word").groupBy("word", "context").agg(F.sum("n").alias("n"))
    tail = tail.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("context", "n")).alias("contexts"))
    placed = stored(tail.mapInArrow(_placed_words(shared), "word string, n long, class int, contexts array<struct<context:int,n:long>>"), "classes")
    for r in placed.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        sizes[r["class"]] += r.n
        kinds[r["class"]] += r.kinds
    each = placed.select("class", F.explode("contexts").alias("c")).groupBy("class", F.floor(F.col("c.context") / STATES).cast("int").alias("state")).agg(F.sum("c.n").alias("n"))
    for r in each.collect():
        steps[r.state, r["class"]] += r.n
    sizes[CLASSES - 1], kinds[CLASSES - 1] = n_docs, n_docs > 0
    return Model(head, counts, own, n_core, steps, sizes, kinds, n_docs), placed.select("word", "n", "class")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`.

    Rows whose crc32(id) mod 10 is 0 are held out, the others train. A null text is empty and has its end alone; a null
    id counts as the empty string in crc32. Very long texts are scored whole; equal texts have equal scores. Rows with equal
    ids are rows of their own. Without training rows all words are unknown. An empty table gives an empty result; other
    columns may have any name.
    """
    held_out = crc_of_id(F.col(f"`{id_col}`")) % 10 == 0
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), held_out.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    model, words = fit(rows.filter(~F.col("held_out")).select("text"))
    # Row numbers are fixed by being written once; head words are scored here, tail words are passed on.
    part = stored(rows.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model)), SCHEMA.format(rows.schema["id"].dataType.simpleString())), "scored")
    table = lambda x: F.array(*[F.lit(float(v)) for v in x])
    step = F.get(table(model.log_step.ravel()), F.col("state") * CLASSES + F.col("class")) - F.get(table(model.log_room), F.col("class"))
    gain = F.log10(F.col("n") + ADD)
    tail = part.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.state").join(words, "word")
    more = tail.groupBy("rid").agg(F.count(F.lit(1)).alias("found"), F.sum(gain - F.log10(F.lit(ADD))).alias("base_gain"), F.sum(gain + step - F.get(table(model.log_unseen), F.col("state"))).alias("gain"))
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    return part.join(more, "rid", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base_score") + or_zero("base_gain")).alias("base_score"), (F.col("score") + or_zero("gain")).alias("score")
    )
