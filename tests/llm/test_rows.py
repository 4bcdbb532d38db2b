"""Ops 5, 6, 7 and 9 against brute force, round trips and the tokenizer library."""

import base64
import hashlib
import json
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from vigil.llm import bpe, mixing, quality, secrets

SCHEMA = "doc_id long, text string, source string, size string, rest int, words string"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, texts, sources=("a",)):
    return spark.createDataFrame([(i, t, sources[i % len(sources)], "x", 1, "y") for i, t in enumerate(texts)], SCHEMA)


def texts(seed=0):
    rnd = random.Random(seed)
    vocab = ["the", "of", "Straße", "naïve", "x1", "12345", "###", "a&b", "日本語", " ", "don't", "I'll", "<|endoftext|>", "🙂🙃"]
    out = [None, "", "  ", "\n\n\n", "a" * 3000, " " * 700 + "x", "word " * 30, "a b c d e f g h " * 5]
    out += ["".join(rnd.choice(vocab) + rnd.choice([" ", "  ", "\n", "", "\t", "\r\n "]) for _ in range(rnd.randint(1, 400))) for _ in range(40)]
    return out


def test_bpe_equals_the_library_and_decodes(spark):
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = texts() + ["日本" * 900 + "?" * 500 + " tail's"]
    for chunk, overlap in ((32768, 512), (97, 20), (50, 3)):
        out = bpe.encode(frame(spark, data), PATH, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
        got = {r.id: (r.ids, bytes(r.decoded)) for r in out}
        assert len(out) == len(data)
        assert got == {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(data)}


def test_pieces_merge_as_the_ranks_say():
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    rnd = random.Random(1)
    for _ in range(60):
        word = "".join(rnd.choice("abethinorsé") for _ in range(rnd.randint(1, 60)))
        parts = [word.encode()[i : i + 1] for i in range(len(word.encode()))]
        while len(parts) > 1:
            rank, at = min((encoder.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert encoder.encode([word]) == [encoder.ranks[p] for p in parts]


def test_stitching_falls_back_when_chunks_do_not_meet():
    find = regex.compile(public_tokenizers.PATTERN)
    text = "ab " * 5 + "z" * 200 + " end of  it" + " " * 90 + "x"
    chunks = [(i, text[i : i + 34]) for i in range(0, len(text), 30)]
    assert bpe.stitched(chunks, find) == find.findall(text)


def test_quality_equals_brute_force(spark):
    data = texts(1) + ["l1 a\nl2 b\nl1 a\n \n \nl1 a", "- x\n- y", "the cat of it and a dog " * 20, " ".join(f"u{i} the" for i in range(40))]
    got = {r.id: r for r in quality.quality(frame(spark, data)).collect()}
    for i, t in enumerate(data):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)
    assert got[len(data) - 1].kept and not got[0].kept


def test_quality_needs_no_python_and_no_shuffle(spark):
    plan = quality.quality(frame(spark, texts())).selectExpr("*")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_mix_reaches_its_targets(spark):
    names = ["b", "a", None, "é", "Z", "~"]
    data = [f"{'w ' * (1 + (i * 7) % 50)}" for i in range(6000)] + [None, ""]
    docs = frame(spark, data, names)
    out = mixing.planned(docs).collect()
    sizes = Counter()
    for i, t in enumerate(data):
        sizes[names[i % 6]] += len((t or "").split())
    order = sorted(names, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            goal[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
        open_ -= over
    goal |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in out:
        assert r.copies <= 2 and r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - goal[s]) < 0.1 * sizes[s] for s in order)
    assert sorted(map(str, out)) == sorted(map(str, mixing.planned(docs.repartition(7)).collect()))
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert copies == +Counter({r.id: r.copies for r in out}) and mixing.mixed(docs).columns == docs.columns


def test_mix_of_nothing(spark):
    assert mixing.planned(frame(spark, [])).count() == 0
    assert [r.copies for r in mixing.planned(frame(spark, [None, ""])).collect()] == [0, 0]


def b64url(x):
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def test_secret_base_spans_equal_the_patterns(spark):
    rnd = random.Random(2)
    hexes = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    data = [None, "", f'é token = "{hexes}" x', "PassWord:abc", "secret=token=abcdef", "token=token:abcdefg", "AKIA" + "Q" * 16 + " AKIA1", "api-key: zzzzzzz apikey=zzzzzz", "paſsword=abcdefgh", hexes[:23] + " " + hexes[:24]]
    got = {r.id: r.spans for r in secrets.secret_spans(frame(spark, data)).collect()}
    for i, t in enumerate(data):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(s.start, secrets.KINDS.index(s.kind), s.end) for s in got[i] if s.kind in secrets.BASE_KINDS] == sorted(want)


def node(tag, *inner):
    data = b"".join(inner)
    n = len(data)
    wide = (n.bit_length() + 7) // 8
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | wide]) + n.to_bytes(wide, "big")) + data


def number(n):
    return node(2, bytes(range(1, n + 1)))


def strings(*fields):
    return b"".join(len(f).to_bytes(4, "big") + f for f in fields)


VERSION, ALGORITHM, CURVE = node(2, b"\0"), node(0x30, node(6, b"*\x86H\x86\xf7\r\x01\x01\x01"), node(5)), node(0xA0, node(6, b"*\x86H\xce=\x03\x01\x07"))
PRIVATE = {
    "rsa": node(0x30, VERSION, *[number(40)] * 8),
    "dsa": node(0x30, VERSION, *[number(24)] * 5),
    "ec": node(0x30, node(2, b"\1"), node(4, bytes(32)), CURVE),
    "pkcs8": node(0x30, VERSION, ALGORITHM, node(4, node(0x30, VERSION, *[number(40)] * 8))),
    "encrypted": node(0x30, node(0x30, node(6, b"*\x86H\x86\xf7\r\x01\x05\r"), node(0x30, number(20))), node(4, bytes(64))),
    "ssh-ed25519": strings(b"ssh-ed25519", bytes(32), bytes(64)),
    "ssh-rsa": strings(b"ssh-rsa", *[bytes(40)] * 6, b"me@here"),
    "container": b"openssh-key-v1\0" + strings(b"none", b"none", b"") + b"\0\0\0\1" + strings(strings(b"ssh-ed25519", bytes(32)), bytes(60)),
}
PUBLIC = {
    "rsa": node(0x30, number(120), number(3)),
    "spki": node(0x30, ALGORITHM, node(3, b"\0", node(0x30, number(120), number(3)))),
    "certificate": node(0x30, node(0x30, node(0xA0, node(2, b"\2")), number(8), ALGORITHM, node(0x30, node(0x31, node(0x30, node(6, b"U\x04\x03"), node(12, b"name")))), node(0x30, ALGORITHM, node(3, bytes(60)))), ALGORITHM, node(3, bytes(65))),
    "signature": node(0x30, number(32), number(32)),
    "ssh-ed25519": strings(b"ssh-ed25519", bytes(32)),
    "ssh-rsa": strings(b"ssh-rsa", bytes(3), bytes(129)),
    "ecdsa": strings(b"ecdsa-sha2-nistp256", b"nistp256", bytes(65)),
}


def test_structure_confirms_or_rejects():
    head, body = b64url(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), b64url(b'{"sub":"1"}')
    spans = secrets.confirmed_spans
    kinds = lambda t: {secrets.KINDS[k] for _, k, _ in spans(t)}
    assert kinds(f"x {head}.{body}.c2ln y") == {"jwt"}
    assert kinds(f"x {b64url(b'{}' * 9)}.{body}.c2ln y") == set()
    broken = b64url(b'\n {"alg": "none"}')
    assert spans(f"jwt_{head}.{body}.c2ln") == [(4, 3, 4 + len(head) + len(body) + 6)] and kinds(f"{broken}.{body}.c2ln") == {"jwt"}
    assert kinds(f"myservice.longtoken.{head}.{body}.c2ln") == {"jwt"}
    for name, data in PRIVATE.items():
        kind = "keyblob" if name.startswith("ssh") or name == "container" else "der"
        text = base64.b64encode(data).decode()
        lines = "\n".join(text[k : k + 64] for k in range(0, len(text), 64))
        assert kinds(text) == {kind} == kinds(data.hex()) == kinds(f"key: {text} end"), name
        assert spans(lines) == [(0, secrets.KINDS.index(kind), len(lines))], name
        assert kinds(f"-----BEGIN X PRIVATE KEY-----\n{lines}\n-----END X PRIVATE KEY-----") == {"pem"}, name
        assert kinds(f"-----BEGIN X PRIVATE KEY-----\\n{text}\\n-----END X PRIVATE KEY-----") == {"pem"}, name
        assert kinds(base64.b64encode(data[:-1]).decode()) == set(), name
    for name, data in PUBLIC.items():
        text = base64.b64encode(data).decode()
        assert kinds(text) == set() == kinds(data.hex()) == kinds(f"-----BEGIN PUBLIC KEY-----\n{text}\n-----END PUBLIC KEY-----"), name
    secret = base64.b64encode(bytes(range(200))).decode()
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00AA\n\n{secret}\n-----END RSA PRIVATE KEY-----") == {"pem"}
    assert kinds("thererhationenungsch" * 5 + " a.b.c") == set()


def test_layouts_of_keys():
    spans = secrets.confirmed_spans
    kinds = lambda t: {secrets.KINDS[k] for _, k, _ in spans(t)}
    for name, data in PRIVATE.items():
        kind = {"keyblob" if name.startswith("ssh") or name == "container" else "der"}
        text = base64.b64encode(data).decode()
        wrapped = lambda n, sep="\n": sep.join(text[k : k + n] for k in range(0, len(text), n))  # noqa: B023, E731
        assert kinds(wrapped(64) + "\nThanks") == kind, name
        assert kinds("x" * 50 + "\n" + wrapped(64)) == kind, name
        assert kinds("    " + wrapped(64, "\n    ")) == kind, name
        assert kinds('"' + wrapped(64, "\\n") + '\\n"') == kind, name
        assert kinds(wrapped(32)) == kind == kinds("key_" + text), name
        assert kinds("a" + data.hex()) == kind, name
    for data in PUBLIC.values():
        text = base64.b64encode(data).decode()
        assert kinds("key_" + text + "\nThanks") == set() == kinds("a" + data.hex())


@pytest.mark.parametrize("unit", ["-eyJ", "_eyJhbGciOiJ9", "MIIE" + "A" * 60 + "\n", "AAAAB3NzaC1yc2EA" + "A" * 48 + "\n", "-----BEGIN X KEY-----\n", "."])
def test_work_grows_with_the_text(unit):
    import time

    began = time.process_time()
    secrets.confirmed_spans("." + unit * (300_000 // len(unit)) + ".abc.def")
    assert time.process_time() - began < 3


@pytest.mark.parametrize("run", [lambda d: quality.quality(d), lambda d: secrets.secret_spans(d), lambda d: bpe.encode(d, PATH, public_tokenizers.PATTERN)])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hashes_do_not_leave_the_row(spark):
    out = secrets.secret_spans(frame(spark, ["token = " + "ab" * 20]))
    assert [f.name for f in out.schema] == ["id", "spans"] and out.select(F.size("spans")).first()[0] == 2
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
