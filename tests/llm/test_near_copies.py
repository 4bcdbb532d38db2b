"""The pipeline's near-dedup stage against brute force over 5-word shingles."""

import random

import corpus_pipeline
from vigil.llm import simhash


def texts(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    passage = [rnd.choice(vocab) for _ in range(40)]
    out = [None, "", "one two", "One  two", "a b c d e f"]
    for _ in range(30):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(6, 260))]
        out.append(" ".join(base + passage))
        for _ in range(rnd.randint(0, 4)):
            words = base + passage
            for _ in range(rnd.randint(1, 1 + len(words) // 35)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            out.append(" ".join(words[rnd.randint(0, 3) :]))
    return out


def components(rows, similarity=0.8, size=5):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= similarity * len(a | b) - 1e-9:
                root = [root[j] if r == root[i] else r for r in root]
    return sorted((rows[i][0], min(rows[k][0] for k in range(len(rows)) if root[k] == root[i])) for i in range(len(rows)))


def test_near_copies_of_similarity_08_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = components(rows)
    got = simhash.near_duplicates(df, size=5, budget=24, similarity=0.8).collect()
    assert sorted((r.id, r.component_id) for r in got) == want
    assert sum(a != b for a, b in want) > 15
    assert simhash.near_duplicates(df.limit(0), size=5, budget=24, similarity=0.8).count() == 0


def test_the_stage_drops_copies_with_some_words_changed(spark):
    rnd = random.Random(1)
    words = [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(500)) for _ in range(300)]
    other = list(words)
    for k in (40, 90, 140, 190, 240):  # 25 of 296 shingles differ: similarity 0.844
        other[k] = "changed"
    df = spark.createDataFrame([(2, " ".join(words)), (1, " ".join(other)), (3, "no copy of it")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [1, 3]


def test_no_join_of_the_stage_passes_a_table_through_the_driver(spark):
    store = spark._jsparkSession.sharedState().statusStore()

    def plans():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        runs = store.executionsList()
        return {(r := runs.apply(i)).executionId(): r.physicalPlanDescription() for i in range(runs.size())}

    before = set(plans())
    simhash.deduplicated(spark.createDataFrame(list(enumerate(texts()[:60])), "doc_id long, text string"), size=5, budget=24, similarity=0.8).collect()
    own = [p for k, p in plans().items() if k not in before]
    assert any("SortMergeJoin" in p for p in own) and not any("BroadcastExchange" in p for p in own)
