"""Parts of pasted secrets, against a search for every run."""

import random
import string

from vigil.operators import repeats


def test_every_long_part_is_found_and_nothing_else(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice(string.ascii_letters + string.digits + "é") for _ in range(n))
    turns, pasted = [], []
    for c in range(200):
        secret = word(rnd.choice([8, 15, 19, 40, 300]))
        pasted += [(c, 2, f"k{c}", secret), (c, 4, f"k{c}", secret)]
        for t in range(8):
            part = secret[(a := rnd.randrange(len(secret))) : a + rnd.choice([5, 11, 19, 25, 200])]
            turns.append((c, t, rnd.choice(["assistant", "assistant", "user"]), rnd.choice([None, "", "plain words only", f"so {word(6)}{part}{word(3)} it was", part])))
    pasted += [(1, 2, "none", None), (1, 2, "empty", "")]
    schema = "conv_id int, turn int, role string, text string"
    got = {(r.conv_id, r.label, r.echoed_turn): r for r in repeats.echoed_parts(spark.createDataFrame(turns, schema).repartition(3), spark.createDataFrame(pasted, "conv_id int, turn int, label string, secret string")).collect()}
    runs = lambda s, n: {s.encode()[i : i + n] for i in range(len(s.encode()) - n + 1)} if s else set()
    secrets = {c: s for c, _, label, s in pasted if label == f"k{c}"}
    sure, may = set(), set()
    for c, t, role, text in turns:
        if role == "assistant" and t > 2:
            if runs(text, repeats.SURE) & runs(secrets[c], repeats.SURE):
                sure.add((c, f"k{c}", t))
            if runs(text, repeats.GRAM) & runs(secrets[c], repeats.GRAM):
                may.add((c, f"k{c}", t))
    assert sure <= set(got) <= may and len(sure) > 30 and all(r.pasted_turn == 2 for r in got.values())


def test_long_texts_are_hashed_across_chunks(monkeypatch):
    rnd = random.Random(9)
    text, keys = bytes(rnd.randrange(256) for _ in range(3000)), (rnd.getrandbits(64), rnd.getrandbits(64))
    whole = repeats.kept_hashes(text, keys)
    for chunk in (1, 7, 100, 2999):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        assert repeats.kept_hashes(text, keys).tolist() == whole.tolist()
    assert len(whole) < 1000 and len(repeats.kept_hashes(b"short", keys)) == 0
