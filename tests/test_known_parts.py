"""Redaction with a dictionary that one broadcast does not hold."""

from vigil.operators import known
from vigil.streaming import state


def test_rows_and_streams_redacted_in_parts(spark, tmp_path, monkeypatch):
    secrets = [("abcd1234efgh", "cred-1"), ("efgh5678ijkl", "cred-2"), ("abcd1234efgh5678zz", "cred-3")]
    needles = known.dictionary(spark.createDataFrame(secrets, "secret string, label string"))
    texts = ["x abcd1234efgh5678ijkl y", "abcd1234efghabcd1234efgh", None, "", "plain", "abcd1234efgh5678zz", "plain"]
    rows = spark.createDataFrame([(k % 6, t) for k, t in enumerate(texts)], "path int, content string")
    listed = lambda df: sorted((r.path, r.content if r.content is None else bytes(r.content).decode(), r.n_redacted) for r in df.collect())
    key = lambda x: (x[0], x[1] or "")
    whole = sorted(listed(known.redact_rows(rows, needles)), key=key)
    monkeypatch.setattr(known, "PART", 2)
    assert needles.count() > 2
    assert sorted(listed(known.redact_rows(rows, needles)), key=key) == whole and len(whole) == 7
    assert known.leaks(known.redact_rows(rows, needles), needles).count() == 0
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert sorted(listed(state.run_redacted(stream, needles, str(tmp_path / "out"))), key=key) == whole
