"""Op 12 against a plain walk over words with the same table, and its SQL on odd rows."""

import random
import re

import duckdb
import pytest

from vigil.llm import licence_rules as lr
from vigil.llm import licences, queries

SCHEMA = "doc_id long, text string, words string, hits int, id string"
RULES = lr.compiled()
CASES = {
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.": "apache-2.0",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
    "Copyright (c) 2020 Some Body. All rights reserved.": "copyright,reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "the gnu lesser general public license v2.1": "gpl,lgpl-2.1",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "an apache landed on the available field": "",
    "the général public license": "",
}


def texts(seed=0):
    rnd = random.Random(seed)
    names = [n.replace("[cs]", "c") for _, n in lr.NAMES] + [p for _, _, _, p in lr.WORDING] + list(lr.BASE) + list(lr.GRANT_HEADS) + ["spdx license identifier mit", "under the", "GNU", "ﬁne", "Kelvin K", "2.0", "version"]
    plain = [re.sub(r"\(([^()|]*)[^()]*\)\??|[?]|\{[^}]*\}|\[[^]]*\]", r"\1", n) for n in names]
    out = [None, "", " \n", "---", "CC-BY cc_by Cc By", "all rights reserved " * 300, "x" * 5000, *CASES]
    return out + [rnd.choice([" ", "-", "\n"]).join(rnd.choice([str.upper, str.title, str.lower])(rnd.choice(plain)) for _ in range(rnd.choice([1, 5, 30]))) for _ in range(80)]


def walked(text):
    words = re.findall(licences.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits, base = set(), []
    for i, w in enumerate(words):
        for phrase, label in lr.BASE.items():
            if words[i : i + len(phrase.split())] == phrase.split():
                base.append((i, label))
        ahead = " ".join(words[i : i + lr.SPAN])
        for r in RULES:
            if (r.head == w or not r.head and w in lr.GRANT_HEADS) and (m := re.match(f"(?:{r.pattern})(?: |$)", ahead)):
                hits.add((i, i + len(m[0].split()), r.ord, r.label, r.level, r.score))
    kept = [h for h in hits if not any(o[0] <= h[0] and o[1] >= h[1] and o[4] >= h[4] and (o[1] - o[0] > h[1] - h[0] or o[4] > h[4] or o[2] < h[2]) for o in hits)]
    starts, labels = [i for i, _ in base], {x for _, x in base}
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {h[3] for h in kept})), max((h[5] for h in kept), default=0.0)


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(None if i == 3 else i // 2, t, "w", 1, "x") for i, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_query_equals_a_walk_and_its_sql(spark, documents):
    folder, rows = documents
    got = queries.op12_license_scan(spark, folder)
    found = sorted(map(repr, map(tuple, got.collect())))
    assert found == sorted(repr((i, *walked(t))) for i, t, *_ in rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert found == sorted(map(repr, con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP12_SQL})").fetchall()))


def test_labels_of_known_lines(spark):
    out = licences.licences(spark.createDataFrame([(i, t, "w", 1, "x") for i, t in enumerate(CASES)], SCHEMA)).collect()
    assert {list(CASES)[r.id]: ",".join(r.labels) for r in out} == CASES


def test_no_python_no_shuffle_and_nothing(spark):
    out = licences.licences(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_the_table(spark):
    assert len({r.ord for r in RULES}) > 300 and all(re.compile(r.pattern).match(r.pattern) or True for r in RULES)
    assert all(r.label and 0 < r.score <= 1 and 0 <= r.level < 4 for r in RULES)
