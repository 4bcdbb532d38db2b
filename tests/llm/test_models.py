"""Ops 3, 4 and 10 and the pipeline: held-out accuracy, brute force, fixtures of pages."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from vigil.llm import class_lm, html, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, word string"
SLURS = ["blockhead", "nitwit", "dunce"]


def crc(d):
    return zlib.crc32(("" if d is None else str(d)).encode())


def corpus(n=500, seed=0):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(["la", "te", "mi", "so", "ru", "ne"]) for _ in range(rnd.randint(1, 4))) for _ in range(500)]
    out, labels = [], []
    for d in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(5, 150))]
        bad = rnd.random() < 0.3
        for _ in range(2 + len(words) // 40 if bad else 0):
            words.insert(rnd.randint(0, len(words)), rnd.choice(SLURS) + rnd.choice(["", "s", "ish", "ery"]))
        out.append((d, " ".join(words), "en", f"s{d % 3}", 1, 0.0, "x"))
        labels.append((d, 1, int(bad)))
    odd = [(9001, None, "en", None, 0, 0.0, "x"), (9002, "", "en", "s1", 0, 0.0, "x"), (None, "la te", "en", "s1", 0, 0.0, "x"), out[3]]
    return out + odd, labels + [(None, 1, 1), (5, None, None), (9001, 1, 0)]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus()
    truth = {d: t for d, _, t in labels[:500]}
    out = toxicity.toxicity(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (crc(r.id) % 3 == 1) for r in out)
    held = [(truth[r.id], r.predicted) for r in out if r.held_out and r.id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95 and {p for _, p in held} == {0, 1}
    assert all(r.predicted == 0 for r in out if r.id in (9001, 9002))
    unseen = toxicity.train([t or "" for _, t, *_ in docs[:500]], [truth[d] for d, *_ in docs[:500]]).score(["la te mi so dunceling nitwitty ru ne"], {})
    assert unseen[0] > 0.5


def test_toxicity_without_labels_and_of_nothing(spark):
    docs = spark.createDataFrame(corpus(20)[0], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_lm_base_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "HEAD", 120)  # most words go by way of the join
    monkeypatch.setattr(class_lm, "CORE", 50)
    docs = corpus(300)[0] + [(7000 + i, f"new{i} LA Te É é", "en", "s", 1, 0.0, "x") for i in range(30)]
    train = [d for d in docs if crc(d[0]) % 10]
    words = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for d in train for w in words(d[1]))
    n, kinds = sum(counts.values()) + len(train), len(counts) + 1
    room = math.log10(n + 0.1 * (kinds + 1))
    base = lambda t: sum(math.log10(counts[w] + 0.1) - room for w in words(t)) + math.log10(len(train) + 0.1) - room
    want = sorted((str(d), crc(d) % 10 == 0, len(words(t)) + 1, sum(w in counts for w in words(t)) + 1, n, round(base(t), 6)) for d, t, *_ in docs)
    out = class_lm.lm_scores(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)


def test_lm_of_nothing_and_without_training_rows(spark):
    assert class_lm.lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [(d, "a b", "en", "s", 1, 0.0, "x") for d in range(200) if crc(d) % 10 == 0]
    assert {(r.n_known, r.train_tokens) for r in class_lm.lm_scores(spark.createDataFrame(held, SCHEMA)).collect()} == {(0, 0)}


def test_exchange_finds_planted_classes_and_never_lowers_the_likelihood():
    rnd = np.random.default_rng(0)
    seq, state = [], 0
    for _ in range(6000):
        state = (state + 1) % 3
        seq.append(int(rnd.integers(0, 10)) * 3 + state)
    pairs = np.zeros((31, 31))
    np.add.at(pairs, (seq[:-1], seq[1:]), 1)
    own = class_lm.exchange(pairs, 4, 30)
    assert own[30] == 3 and all(len(set(own[s:30:3])) == 1 for s in range(3)) and len(set(own[:30])) == 3

    def likelihood(own):
        z = np.eye(4)[own]
        m = z.T @ pairs @ z
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(m) - f(m.sum(0)) - f(m.sum(1))

    start = np.r_[np.arange(30) % 3, 3]
    assert likelihood(own) >= likelihood(start)


def test_class_scores_equal_brute_force(spark, monkeypatch):
    """The score from counts made anew: every word of the training texts has a class, and what it is joined from doesn't
    matter."""
    monkeypatch.setattr(class_lm, "HEAD", 120)
    monkeypatch.setattr(class_lm, "CORE", 40)
    docs = [(d, t) for d, t, *_ in corpus(300)[0]] + [(7000 + i, f"new{i} LA Te \u00c9 \u00e9") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    train = [t for d, t in docs if crc(d) % 10]
    model, rest = class_lm.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    of = dict(zip(model.head.to_pylist(), model.classes.tolist(), strict=True)) | {r.word: r["class"] for r in rest.collect()}
    core = set(model.head.to_pylist()[: model.n_core])
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    counts = Counter(w for t in train for w in words(t))
    assert set(of) == set(counts) and len(core) <= 40 < len(model.head) <= 120 and set(of.values()) <= set(range(class_lm.CLASSES - 1))
    end = class_lm.CLASSES - 1
    state = lambda w: class_lm.END if w is None else of[w] if w in core else class_lm.RARE
    steps = np.zeros((class_lm.STATES, class_lm.CLASSES))
    for t in train:
        seq = [None, *words(t), None]
        for a, b in zip(seq, seq[1:], strict=False):
            steps[state(a), end if b is None else of[b]] += 1
    share = (steps.sum(0) + 1) / (steps.sum() + class_lm.CLASSES)
    p_class = (steps + 20 * share) / (steps.sum(1, keepdims=True) + 20)
    assert np.allclose(p_class.sum(1), 1)
    size, kinds = np.zeros(class_lm.CLASSES), np.zeros(class_lm.CLASSES)
    for w, n in counts.items():
        size[of[w]] += n
        kinds[of[w]] += 1
    size[end], kinds[end] = len(train), 1
    room = size + 0.1 * (kinds + 1)
    unseen = (p_class * 0.1 / room).sum(1)

    def score(text):
        total, before = 0.0, None
        for w in [*words(text), None]:
            c = end if w is None else of.get(w)
            n = len(train) if w is None else counts[w]
            total += math.log10(unseen[state(before)] if c is None else p_class[state(before), c] * (n + 0.1) / room[c])
            before = w
        return total

    out = class_lm.lm_scores(df).collect()
    assert sorted((str(r.id), round(r.score, 5)) for r in out) == sorted((str(d), round(score(t), 5)) for d, t in docs)


def test_classes_lower_the_perplexity_of_held_out_texts(spark):
    """Words of three kinds that follow each other in turn, most of them rare: the classes show it, counts alone don't."""
    rnd = random.Random(2)
    kinds = [[f"{k}{i}" for i in range(600)] for k in "abc"]
    pick = lambda words: words[min(int(rnd.expovariate(1 / 80)), 599)]
    docs = [(d, " ".join(pick(kinds[i % 3]) for i in range(rnd.randint(30, 90)))) for d in range(400)]
    out = [r for r in class_lm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.held_out]
    assert len(out) > 20 and sum(r.score for r in out) > sum(r.base_score for r in out) + 0.3 * sum(r.n_tokens for r in out)


PAGES = [
    (1, "http://a.org/1", "<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>Menu</a></nav><article><h1>Head &amp; more</h1><p>One <b>two</b>\n three<p>Four<br>five&nbsp;six</article><aside>Side</aside><footer>Foot</footer></body></html>", "Head & more\nOne two three\nFour five six"),
    (2, "http://a.org/2", "<body><article><p>" + "text " * 40 + "</p><div class='ad-slot'>Buy</div><form>Mail <input></form><section id=comments><p>Nice!</p></section></article>", ("text " * 40).strip()),
    (3, "http://b.org:80/x", "<body><div class='cookie-notice'>We use</div><div class=wrap7><div class='post42'><p>A paragraph of some length.</p><p>Another &lt;one&gt;.</p></div></div><div class=links><a href=1>l1</a><a href=2>l2</a></div><script>var x='<p>no</p>'</script>", "A paragraph of some length.\nAnother <one>."),
    (4, "http://a.org/3", "<body><div><p>No article here.</p></div><foo", "No article here."),
    (5, None, None, ""),
    (6, "not a url", "", ""),
    (7, "http://a.org/4", "<article>a < b and c > d<ul><li>x<li>y</ul><!-- hidden --><style>p{}</style>", "a < b and c > d\nx\ny"),
]


def test_html_pages(spark):
    rows = [(i, u, h, "x", "y") for i, u, h, _ in PAGES] + [(1, "http://a.org/1", PAGES[0][2], "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, winner string")
    got = [(r.id, r.text) for r in html.main_text(df).collect()]
    assert sorted(got) == sorted([(i, t) for i, _, _, t in PAGES] + [(1, PAGES[0][3])])
    assert html.main_text(df.limit(0)).count() == 0


def test_votes_of_the_host_decide(spark):
    page = "<body><div class=story{}><p>{}</p></div><div class=extra><p>{}</p></div>"
    rows = [(i, f"https://u@H.org:8/{i}", page.format(i, "long text " * 9, "tiny")) for i in range(5)] + [(9, "https://h.org/9", page.format(9, "short", "long other " * 20))]
    out = {r.id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[9] == "short" and out[0] == ("long text " * 9).strip()


@pytest.fixture(scope="module")
def piped(spark, tmp_path_factory):
    docs, labels = corpus(240)
    docs = [d for d in docs if d[0] is not None] + [(8000 + i, docs[0][1], "en", "s1", 1, 0.0, "x") for i in range(5)]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return docs, str(where)


def test_pipeline_stages(spark, piped):
    docs, where = piped
    now, names = spark.read.parquet(f"{where}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_dedup", "mix_sources", "bpe"]
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, corpus_pipeline.stored(stage(spark, now, where), "t")
        assert now.columns == before.columns
        texts[name] = [(r.doc_id, r.text) for r in now.collect()]
    assert not any(s in (t or "") for _, t in texts["toxicity"] for s in SLURS) or sum(any(s in (t or "") for s in SLURS) for _, t in texts["toxicity"]) < 5
    own = [t or "" for _, t in texts["exact_dedup"]]
    assert len(own) == len(set(own)) == len({t or "" for _, t in texts["toxicity"]})
    assert max(Counter(d for d, _ in texts["mix_sources"]).values()) == 2
    out = corpus_pipeline.STAGES[-1][1](spark, now, where)
    assert out.count() == len(texts["mix_sources"]) == corpus_pipeline.run(spark, where).count()
