"""The registered query of each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, class_lm, exact_dedup, hard_negatives, html, interactions, licence_rules, licences, mixing, quality, secrets, simhash, substring, toxicity
from .common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document less those of windows of 50 that start in a document of a smaller id; see
    `substring.substring_dedup` for odd rows."""
    out = substring.substring_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see `simhash.near_duplicates` for odd rows."""
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, learned from the labelled ones that are not held out; see `toxicity.toxicity` for
    odd rows."""
    out = toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and class-model log probabilities of every document; see `class_lm.lm_scores` for odd rows."""
    return class_lm.lm_scores(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document; see `secrets.secret_spans` for odd rows."""
    out = secrets.secret_spans(documents(spark, sf_dir))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return out.select(F.col("id").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to; see `bpe.encode` for odd rows."""
    import public_tokenizers

    out = bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document; see `quality.quality` for odd rows."""
    out = quality.quality(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and verdict of every document; see `exact_dedup.exact_dedup` for odd rows."""
    out = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.sha2("norm", 256).alias("text_sha256"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document; see `mixing.planned` for odd rows."""
    out = mixing.planned(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; see `html.main_text` for odd rows."""
    out = html.main_text(documents(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with a seventh of the labels moved on by one; see
    `hard_negatives.hard_negatives` for odd rows."""
    rows = documents(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(moved, F.col("vec_id") % 50 == 0)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and labels of every document; see `licences.licences` for odd rows."""
    out = licences.licences(documents(spark, sf_dir))
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every step of the 120 orders of five filters, per source; see `interactions.audit` for odd rows."""
    return interactions.audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
win AS (SELECT doc_id, r, unnest(list_transform(range(1, len(w) - 48), lambda i: sha256(array_to_string(w[i:i + 49], ' ')))) AS k, unnest(range(1, len(w) - 48)) AS p FROM d),
late AS (SELECT r, p FROM (SELECT r, p, doc_id > min(doc_id) OVER (PARTITION BY k) AS late FROM win) WHERE late),
gone AS (SELECT word.r, word.p, word.word, max(late.p) OVER (PARTITION BY word.r ORDER BY word.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM word LEFT JOIN late ON word.r = late.r AND word.p = late.p),
kept AS (SELECT r, count_if(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS k, unnest(range(1, len(w) - 6)) AS p FROM d),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(step)::BIGINT AS n_repeat_words FROM (SELECT r, least(8, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 8)) AS step FROM again) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 len(list_filter(w, lambda x: x IN ({", ".join(f"'{v}'" for x in quality.STOP_WORDS for v in (x, x.capitalize(), x.upper()))}))) AS stops, len(l) AS n_lines,
 len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$'))) AS ellipses FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND word_chars BETWEEN 1.5 * n_words AND 16 * n_words AND n_symbols <= 0.25 * word_chars AND stops >= 0.02 * n_words AND n_dup_lines <= 0.5 * n_lines AND bullets <= 0.9 * n_lines AND ellipses <= 0.5 * n_lines AS kept FROM b
"""

OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((nth - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s),
r AS (SELECT *, most / weight AS ratio FROM w),
l AS (SELECT *, row_number() OVER o AS place, greatest(sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r WINDOW o AS (ORDER BY ratio, encode(source) NULLS LAST)),
t AS (SELECT source, source_size, coalesce(least(most, (SELECT level FROM l WHERE level <= ratio ORDER BY place LIMIT 1) * weight), most) AS target FROM l),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""

OP11_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, b.r AS other, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST, other) AS nth FROM s WHERE same QUALIFY nth <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.nth ORDER BY s.score DESC, s.id NULLS LAST, s.other) AS rank
 FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n
"""

_RULE_ROWS = ", ".join(f"({r.ord}, '{h}', '{r.need}', '{r.label}', {r.level}, {r.score}, '^(?:{r.pattern})(?: |$)', {r.base})" for r in licence_rules.compiled() for h in ([r.head] if r.head else licence_rules.GRANT_HEADS))
#: The same rules, as a table that is joined with the words; base phrases are looked for by their words alone.
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
rules(ord, head, need, label, level, score, pattern, base) AS (VALUES {_RULE_ROWS}),
p AS (SELECT r, w, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
a AS (SELECT r, i, word, array_to_string(w[i + 1:i + {licence_rules.SPAN}], ' ') AS ahead FROM p WHERE word IN (SELECT head FROM rules)),
m AS (SELECT a.r, a.i AS start, rules.*, rtrim(regexp_extract(ahead, pattern)) AS m FROM a JOIN rules ON word = head WHERE contains(ahead, need) AND regexp_matches(ahead, pattern)),
h AS (SELECT DISTINCT r, start, start + 1 + len(m) - len(replace(m, ' ', '')) AS stop, ord, label, level, score FROM m),
k AS (SELECT r, label, score FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.r = h.r AND o.start <= h.start AND o.stop >= h.stop AND o.level >= h.level AND (o.stop - o.start > h.stop - h.start OR o.level > h.level OR o.ord < h.ord))),
b AS (SELECT r, i, CASE WHEN w[i + 1:i + 2] = ['cc', 'by'] THEN 'cc-by' WHEN w[i + 1:i + 3] = ['general', 'public', 'license'] THEN 'gpl' WHEN w[i + 1:i + 3] = ['all', 'rights', 'reserved'] THEN 'reserved' END AS label FROM p),
bs AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM b WHERE label IS NOT NULL GROUP BY r),
ls AS (SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT r, label FROM k UNION SELECT r, label FROM b WHERE label IS NOT NULL) GROUP BY r),
sc AS (SELECT r, max(score)::DOUBLE AS score FROM k GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN ls USING (r) LEFT JOIN sc USING (r)
"""

#: Written from the definition of each count: every document walks through every order.
OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), first IS NOT NULL AND (doc_id IS NULL OR doc_id > first)] AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT g.*, o, step, fails[o[step]] AS fails_it, list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])) AS gone, o[step] AS own FROM g, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, array_to_string(list_transform(o, lambda i: chr(64 + i::INT)), '') AS filter_order, step::INT AS step, own,
 coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND NOT fails_it), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND fails_it), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (coalesce(gone, false) AND fails_it), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails_it AND len(list_filter(fails, lambda b: b)) = 1), 0)::BIGINT AS unique_fails,
 coalesce(sum(good) FILTER (NOT coalesce(gone, false) AND fails_it), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT coalesce(gone, false) AND fails_it), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_class_lm": op4_class_lm,
    "op5_secret_scan": op5_secret_scan,
    "op6_bpe": op6_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_html_extract": op10_html_extract,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_license_scan": op12_license_scan,
    "op13_filter_interactions": op13_filter_interactions,
}
ORACLE_SQL = {"op1_substring_dedup": OP1_SQL, "op7_quality_rules": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op9_mix_sources": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_license_scan": OP12_SQL, "op13_filter_interactions": OP13_SQL}
