"""Registered queries of the credential-hygiene operators, and SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fingerprint import Fingerprinter
from ..operators import audit, commands, commits, extract, known, repeats, transcripts
from ..sources import listing, ranges, readers, redacted
from ..sources.snapshots import Snapshots
from ..streaming import pruned
from ..streaming import state as streams
from .views import TEST_PEPPER, VIEWS, view, view_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LABEL_PREFIX = b"label\0"
_PAD = TEST_PEPPER.ljust(64, b"\0")
_IPAD, _OPAD = bytes(b ^ 0x36 for b in _PAD).hex(), bytes(b ^ 0x5C for b in _PAD).hex()


def _mac(x: str, prefix: bytes) -> str:
    return f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}{prefix.hex()}') || encode({x}))))"


def fp_sql(x: str) -> str:
    return _mac(x, b"fp\0")


def label_sql(fp: str) -> str:
    return f"'cred-' || substr({_mac(fp, LABEL_PREFIX)}, 1, 6)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _fp(spark: SparkSession) -> Fingerprinter:
    return Fingerprinter(spark, TEST_PEPPER)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, fp, at, ord): the secret is dropped in the stage that reads it."""
    return view(spark, sf_dir, "obs").select("location", _fp(spark).fp(F.col("secret")).alias("fp"), F.unix_timestamp("ts").alias("at"), F.struct("ts", "event_id").alias("ord"))


OBS = f"obs AS (SELECT location, {fp_sql('secret')} AS fp, CAST(floor(epoch(ts)) AS BIGINT) AS ats, row(ts, event_id) AS ord FROM ({view_sql('obs')}))"
LATEST = OBS + ", latest AS (SELECT location, arg_max(fp, ord) AS fp, max(ats) AS ats FROM obs GROUP BY location)"


def _kept(df: DataFrame, name: str) -> DataFrame:
    """`df` as a stored table: fingerprints are made once, however many parts of a report read them."""
    folder = readers.scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _last(obs: DataFrame) -> DataFrame:
    return obs.groupBy("location").agg(F.max_by("fp", "ord").alias("fp"), F.max("at").alias("at"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_last(_observed(spark, sf_dir)), "latest")


#: Places that hold one credential on purpose: those of every third user, and those of the ones after them.
DECLARED = "pair AS (SELECT CAST(regexp_extract(location, '/u([0-9]+)/', 1) AS BIGINT) % 3 AS group_id, location FROM latest WHERE CAST(regexp_extract(location, '/u([0-9]+)/', 1) AS BIGINT) % 3 < 2)"
REUSED = f"""{DECLARED}, u AS (SELECT DISTINCT fp, location FROM latest), many AS (SELECT fp, count(*) AS n_locations, min(location) AS first_location FROM u GROUP BY fp HAVING count(*) > 1),
declared AS (SELECT fp, min(group_id) AS group_id FROM (SELECT u.fp, p.group_id, count(*) AS n FROM u JOIN pair p USING (location) GROUP BY ALL) i JOIN many m USING (fp) WHERE i.n = m.n_locations GROUP BY fp),
reused AS (SELECT * FROM many WHERE fp NOT IN (SELECT fp FROM declared))"""


def _pairs(now: DataFrame) -> DataFrame:
    user = F.regexp_extract("location", "/u([0-9]+)/", 1).cast("long")
    return now.filter(user % 3 < 2).select((user % 3).alias("group_id"), "location")


@query(f"WITH {LATEST}, {REUSED} SELECT {label_sql('r.fp')} AS label, n_locations, first_location, location FROM reused r JOIN u ON u.fp = r.fp")
def reused_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reused credential that isn't declared, with all its places."""
    now = _latest(spark, sf_dir)
    same = _pairs(now)
    rows = audit.reused(now, same).join(audit.reused_places(now, same), "fp")
    return rows.select(_fp(spark).label(F.col("fp")).alias("label"), "n_locations", "first_location", "location")


@query(f"WITH {OBS} SELECT DISTINCT fp, {label_sql('fp')} AS label FROM obs")
def fingerprint_labels(spark, sf_dir):
    return _observed(spark, sf_dir).select("fp").distinct().withColumn("label", _fp(spark).label(F.col("fp")))


@query(f"WITH {OBS} SELECT location, arg_min(fp, ord) AS fp, count(DISTINCT fp) > 1 AS ambiguous FROM obs GROUP BY location")
def one_name_one_secret(spark, sf_dir):
    return audit.one_name_one_secret(_observed(spark, sf_dir))


CUT, LATE = 1704585600, 1706486400  # 2024-01-07, 2024-01-29
SPLIT = OBS + f""", prior AS (SELECT location, arg_max(fp, ord) AS fp, min(ats) AS since, min(ats) % 2 = 0 AS exact FROM obs WHERE ats < {CUT} GROUP BY location),
now AS (SELECT location, arg_max(fp, ord) AS fp, max(ats) AS ats FROM obs WHERE ats >= {CUT} GROUP BY location),
state AS (SELECT n.location, n.fp, CASE WHEN p.fp = n.fp THEN p.since ELSE {CUT} END AS since, CASE WHEN p.fp IS NULL THEN false WHEN p.fp = n.fp THEN p.exact ELSE true END AS exact FROM now n LEFT JOIN prior p USING (location))"""


def _split(spark, sf_dir):
    return _split_of(_kept(_observed(spark, sf_dir), "observed"))


def _split_of(obs):
    prior = obs.filter(F.col("at") < CUT).groupBy("location").agg(F.max_by("fp", "ord").alias("fp"), F.min("at").alias("since")).withColumn("exact", F.col("since") % 2 == 0)
    return prior, obs.filter(F.col("at") >= CUT).groupBy("location").agg(F.max_by("fp", "ord").alias("fp"), F.max("at").alias("at"))


#: What a scan sees where files of some users are gone; those of users that end in 7 are out of sight.
AWAY = "/u[0-9]*[137]/"


@query(f"WITH {SPLIT} SELECT * FROM state")
def observe_state(spark, sf_dir):
    return audit.observe(*_split(spark, sf_dir), F.lit(CUT).cast("long"))


@query(f"WITH {SPLIT} SELECT * FROM state WHERE NOT regexp_matches(location, '{AWAY}') UNION ALL SELECT location, fp, since, exact FROM prior WHERE location LIKE 'env:/srv/u%7/app.env#%'")
def observe_snapshots(spark, sf_dir):
    """Two scans over stored snapshots, and one between them that broke off before its mark."""
    prior, now = _split(spark, sf_dir)
    store = Snapshots(spark, readers.scratch(spark, "state"), 8)
    store.save(prior, "1")
    store.save(prior.withColumn("fp", F.lit("0" * 64)), "2", complete=False)
    store.save(store.observe(now.filter(~F.col("location").rlike(AWAY)), F.lit(CUT).cast("long"), _unseen(prior)), "3")
    return store.latest()


@query(f"WITH {SPLIT}, here AS (SELECT * FROM now WHERE NOT regexp_matches(location, '{AWAY}')), gone AS (SELECT p.* FROM prior p WHERE NOT EXISTS (SELECT 1 FROM here n WHERE n.location = p.location)) SELECT location, fp, since, exact FROM prior WHERE location IN (SELECT location FROM here) UNION ALL SELECT location, fp, since, exact FROM gone WHERE location LIKE 'env:/srv/u%7/app.env#%'")
def prune_state(spark, sf_dir):
    """Folders of users that end in 7 couldn't be looked at for env files, those that end in 3 for ini files, of which none is
    tracked there."""
    prior, now = _split(spark, sf_dir)
    other = prior.select(F.regexp_extract("location", "^env:(/srv/u[0-9]*3)/app", 1).alias("folder")).filter("folder <> ''").distinct()
    other = other.select(F.xxhash64("folder").alias("ord"), F.lit("ini").alias("kind"), F.concat("folder", F.lit("/*.env")).alias("pattern"))
    return audit.prune_state(prior, now.filter(~F.col("location").rlike(AWAY)), _unseen(prior).unionByName(other)).select("location", "fp", "since", "exact")


AGED = SPLIT + ", aged AS (SELECT location, fp, exact, CASE WHEN exact THEN greatest(CAST(floor((1735689600 - since) / 86400.0) AS BIGINT), 0) ELSE greatest(CAST(floor((1735689600 - since) / 86400.0) AS BIGINT), CAST(floor((1735689600 - (since - 8640000)) / 86400.0) AS BIGINT), 0) END AS days FROM state)"


@query(f"WITH {AGED} SELECT location, exact, days FROM aged WHERE days >= 400")
def stale_credentials(spark, sf_dir):
    state = audit.observe(*_split(spark, sf_dir), F.lit(CUT).cast("long")).withColumn("mtime", F.col("since") - 8640000)
    return audit.credential_age(state, F.lit(1735689600)).filter("days >= 400").select("location", "exact", "days")


SAME = LATEST + ", same AS (SELECT CAST(regexp_extract(location, '/u([0-9]+)/', 1) AS BIGINT) // 3 AS group_id, location FROM latest WHERE location LIKE '%#LOGIN_TOKEN' OR location LIKE '%#CLICK_TOKEN')"


def _same(spark, sf_dir):
    now = _latest(spark, sf_dir)
    return now, _groups(now)


def _groups(now):
    group = F.floor(F.regexp_extract("location", "/u([0-9]+)/", 1).cast("long") / 3)
    return now.filter(F.col("location").rlike("#(LOGIN|CLICK)_TOKEN$")).select(group.cast("long").alias("group_id"), "location")


DRIFT = f"c AS (SELECT group_id, location, {label_sql('fp')} AS label FROM latest JOIN same USING (location)), d AS (SELECT group_id FROM c GROUP BY group_id HAVING count(DISTINCT label) > 1), drift AS (SELECT group_id, label, location FROM c JOIN d USING (group_id))"


def _labelled(spark, now):
    return now.select("location", _fp(spark).label(F.col("fp")).alias("label"))


@query(f"WITH {SAME}, {DRIFT} SELECT group_id, label, location FROM drift")
def drifted_copies(spark, sf_dir):
    now, same = _same(spark, sf_dir)
    return audit.drifted(_labelled(spark, now), same)


@query(f"WITH {LATEST}, {REUSED} SELECT {label_sql('fp')} AS label, group_id FROM declared")
def declared_copies(spark, sf_dir):
    now = _latest(spark, sf_dir)
    return audit.declared(now, _pairs(now)).select(_fp(spark).label(F.col("fp")).alias("label"), "group_id")


#: What was seen late; places of users that end in 7 are under a source that couldn't be looked at.
MISSING = f"late AS (SELECT DISTINCT location FROM obs WHERE ats >= {LATE}), missing AS (SELECT DISTINCT group_id, location FROM same WHERE location NOT IN (SELECT location FROM late) AND location NOT LIKE 'env:/srv/u%7/app.env#%')"


def _unseen(now: DataFrame) -> DataFrame:
    """A rule for each folder that couldn't be looked at."""
    folder = F.regexp_extract("location", "^env:(/srv/u[0-9]*7)/app", 1)
    return now.select(folder.alias("folder")).filter("folder <> ''").distinct().select(F.xxhash64("folder").alias("ord"), F.lit("env").alias("kind"), F.concat("folder", F.lit("/*.env")).alias("pattern"))


def _late(spark, sf_dir):
    return _observed(spark, sf_dir).filter(F.col("at") >= LATE)


@query(f"WITH {SAME}, {MISSING} SELECT group_id, location FROM missing")
def missing_copies(spark, sf_dir):
    now, same = _same(spark, sf_dir)
    return audit.missing(_late(spark, sf_dir), same, _unseen(now))


@query(f"WITH {OBS}, l AS (SELECT location, ats, fp, lag(fp) OVER (PARTITION BY location ORDER BY ord) AS before FROM obs) SELECT location, count(*) AS n_rotations, max(ats) AS last_rotation FROM l WHERE before <> fp GROUP BY location")
def rotation_history(spark, sf_dir):
    rows = audit.rotations(_observed(spark, sf_dir).withColumn("ts", F.col("ord")))
    return rows.groupBy("location").agg(F.count(F.lit(1)).alias("n_rotations"), F.max(F.unix_timestamp("ts.ts")).alias("last_rotation"))


ENV = rf"""lines AS ({view_sql('env_lines')}), body AS (SELECT path, line, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^export ', ''), '^\s+', '') AS b FROM lines WHERE NOT regexp_matches(text, '^\s*#')),
kv AS (SELECT path, line, regexp_extract(b, '{T.ENV_PAIR}', 1) AS key, regexp_replace(regexp_extract(b, '{T.ENV_PAIR}', 2), '^\s+|\s+$', '', 'g') AS v FROM body),
kv2 AS (SELECT path, line, key, CASE WHEN length(v) >= 2 AND substr(v, 1, 1) IN ('"', '''') AND right(v, 1) = substr(v, 1, 1) THEN substr(v, 2, length(v) - 2) ELSE v END AS v FROM kv WHERE key <> ''),
s AS (SELECT path, line, key, CASE WHEN regexp_matches(v, '^[A-Za-z0-9+.-]+://[^/:]*:[^/]+@') THEN regexp_extract(v, '^[A-Za-z0-9+.-]+://[^/:]*:([^/]+)@', 1)
WHEN NOT regexp_matches(upper(key), '({'|'.join(T.NOT_SECRET_ENDINGS)})$') AND regexp_matches(upper(key), '{'|'.join(T.SECRET_PARTS)}') THEN v END AS secret FROM kv2),
env AS (SELECT 'env:' || path || '#' || key AS location, arg_max(secret, line) AS secret FROM s WHERE strlen(trim(secret)) >= 8 AND NOT starts_with(trim(secret), '$') AND trim(secret) <> 'changeme' GROUP BY path, key)"""


@query(f"WITH {ENV} SELECT location, {fp_sql('secret')} AS fp FROM env")
def extract_env(spark, sf_dir):
    return extract.extract_env(view(spark, sf_dir, "env_lines")).select("location", _fp(spark).fp(F.col("secret")).alias("fp"))


@query(f"WITH {ENV}, c AS (SELECT location, secret, length(trim(secret)) AS len, concat_ws('+', CASE WHEN regexp_matches(secret, '[a-z]') THEN 'lower' END, CASE WHEN regexp_matches(secret, '[A-Z]') THEN 'upper' END, CASE WHEN regexp_matches(secret, '[0-9]') THEN 'digit' END, CASE WHEN regexp_matches(secret, '[!-/:-@\\[-`{{-~]') THEN 'punct' END) AS classes FROM env) SELECT location, {label_sql(fp_sql('secret'))} AS label, len, classes FROM c")
def secret_shape(spark, sf_dir):
    rows, p = extract.extract_env(view(spark, sf_dir, "env_lines")), _fp(spark)
    return rows.select("location", p.label(p.fp(T.trimmed(F.col("secret")))).alias("label"), F.length(T.trimmed(F.col("secret"))).cast("long").alias("len"), T.character_classes(F.col("secret")).alias("classes"))


@query(rf"""WITH lines AS ({view_sql('ini_lines')}), t AS (SELECT path, line, text AS t FROM lines WHERE NOT regexp_matches(text, '^[;#]')),
s AS (SELECT path, line, t, last_value(CASE WHEN regexp_matches(t, '^\[.*\]$') THEN regexp_extract(t, '^\[(.*)\]$', 1) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM t),
k AS (SELECT path, line, coalesce(section, '') AS section, lower(regexp_extract(t, '^([^=\[]*?)\s*=>?\s*(.*)$', 1)) AS key, trim(regexp_extract(t, '^([^=\[]*?)\s*=>?\s*(.*)$', 2), '"') AS v FROM s)
SELECT 'ini:' || path || '#[' || section || ']' AS location, line, {fp_sql('v')} AS fp FROM k WHERE key IN ('password', 'secret') AND strlen(v) >= 8""")
def extract_ini(spark, sf_dir):
    return extract.extract_ini(view(spark, sf_dir, "ini_lines")).select("location", "line", _fp(spark).fp(F.col("secret")).alias("fp"))


@query(f"WITH l AS ({view_sql('shadow')}), p AS (SELECT string_split(value, ':') AS p FROM l), a AS (SELECT p[1] AS u, p[2] AS h, try_cast(p[3] AS BIGINT) AS c FROM p) SELECT u AS \"user\", 20000 - c AS days FROM a WHERE starts_with(h, '$') AND c > 0 AND 20000 - c >= 180")
def stale_accounts(spark, sf_dir):
    return audit.stale_accounts(view(spark, sf_dir, "shadow"), 20000, 180)


RULES = "rules AS (SELECT n_nationkey AS ord, 'env' AS kind, CASE WHEN n_nationkey % 3 = 0 THEN '/srv/n' || n_nationkey || '/*.env' WHEN n_nationkey % 3 = 1 THEN '/srv/n' || n_nationkey || '/app.env' ELSE '/srv/n' || n_nationkey || '/x*y' END AS pattern FROM nation)"
MATCHED = f"{ENV}, {RULES}, paths AS (SELECT DISTINCT path FROM lines), matched AS (SELECT ord, kind, pattern, path FROM rules JOIN paths ON regexp_extract(pattern, '^(.*)/[^/]*$', 1) = regexp_extract(path, '^(.*)/[^/]*$', 1) AND path LIKE replace(pattern, '*', '%'))"


def _rules(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tail = F.when(F.col("n_nationkey") % 3 == 0, "/*.env").when(F.col("n_nationkey") % 3 == 1, "/app.env").otherwise("/x*y")
    rules = nation.select(F.col("n_nationkey").alias("ord"), F.lit("env").alias("kind"), F.concat(F.lit("/srv/n"), F.col("n_nationkey").cast("string"), tail).alias("pattern"))
    return rules, view(spark, sf_dir, "env_lines").select("path").distinct()


@query(f"WITH {MATCHED} SELECT * FROM matched")
def match_sources(spark, sf_dir):
    return audit.match_sources(*_rules(spark, sf_dir))


FOLDERS = "folders AS (SELECT '/srv/n' || n_nationkey AS folder FROM nation WHERE n_nationkey % 6 <> 5)"


@query(f"WITH {MATCHED}, {FOLDERS} SELECT ord, kind, pattern, regexp_extract(pattern, '^(.*)/[^/]*$', 1) IN (SELECT folder FROM folders) AS could_look FROM rules WHERE ord NOT IN (SELECT ord FROM matched)")
def uncovered_sources(spark, sf_dir):
    rules, files = _rules(spark, sf_dir)
    folders = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey % 6 <> 5").select(F.concat(F.lit("/srv/n"), F.col("n_nationkey").cast("string")).alias("path"))
    return audit.uncovered(rules, audit.match_sources(rules, files), folders)


TREE_RULES = "CASE n_nationkey % 4 WHEN 0 THEN concat('/n', n_nationkey, '/*.env') WHEN 1 THEN concat('/n', n_nationkey, '/c1*.env') WHEN 2 THEN concat('/n', n_nationkey, '/none*.env') ELSE concat('/x', n_nationkey, '/*.env') END"


@query(f"""WITH rules AS (SELECT CAST(n_nationkey AS BIGINT) AS ord, {TREE_RULES} AS pattern FROM nation UNION ALL SELECT 100 + n_nationkey, concat('/n', n_nationkey, '/c*5.env') FROM nation WHERE n_nationkey % 4 = 0),
files AS (SELECT concat('/n', c_nationkey, '/c', c_custkey, '.env') AS path, strlen(c_name) AS size FROM customer), folders AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS folder FROM files),
m AS (SELECT ord, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM rules JOIN files ON path LIKE replace(pattern, '*', '%') GROUP BY ord)
SELECT ord, pattern, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, regexp_extract(pattern, '^(.*)/', 1) IN (SELECT folder FROM folders) AS could_look FROM rules LEFT JOIN m USING (ord)""")
def listed_sources(spark, sf_dir):
    """A file for each customer in the folder of the nation, and what each rule finds of them by listing the folders that rules
    name; those of every fourth nation are named by none."""
    root, customer = readers.scratch(spark, "tree"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    files = customer.select(F.expr("concat('/n', c_nationkey, '/c', c_custkey, '.env')").alias("path"), F.col("c_name").cast("binary").alias("content"), F.lit(1).alias("n_redacted"))
    redacted.write_files(files, root)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rules = nation.select(F.col("n_nationkey").cast("long").alias("ord"), F.lit("env").alias("kind"), F.expr(TREE_RULES).alias("pattern"))
    rules = rules.unionByName(nation.filter("n_nationkey % 4 = 0").selectExpr("cast(100 + n_nationkey as bigint) AS ord", "'env' AS kind", "concat('/n', n_nationkey, '/c*5.env') AS pattern"))
    matched, folders = listing.listed(rules, root)
    found = matched.groupBy("ord").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    looked = folders.select(F.col("path").alias("folder"), F.lit(True).alias("looked"))
    each = rules.withColumn("folder", F.regexp_extract("pattern", "^(.*)/", 1)).join(found, "ord", "left").join(looked, "folder", "left")
    return each.select("ord", "pattern", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("looked", F.lit(False)).alias("could_look"))


#: Every second file, with and without a secret, and a rule that reaches all of them after the others.
COVER = f"{ENV}, cr AS (SELECT n_nationkey AS ord, '/srv/n' || n_nationkey || '/app.env' AS path FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 100, path FROM (SELECT DISTINCT path FROM lines) UNION ALL SELECT 200, '/srv/n' || n_nationkey || '/none.env' FROM nation), cf AS (SELECT cr.ord, cr.path, location FROM cr JOIN env ON split_part(substr(location, 5), '#', 1) = cr.path)"


@query(f"WITH {COVER}, f AS (SELECT location, min(ord) AS ord FROM cf GROUP BY location), fs AS (SELECT ord, count(*) AS secrets FROM f GROUP BY ord) SELECT ord, count(*) AS files, any_value(coalesce(secrets, 0)) AS secrets, coalesce(string_agg(CASE WHEN (ord, path) NOT IN (SELECT (ord, path) FROM cf) THEN regexp_extract(path, '([^/]*)$', 1) END, ', '), '') AS none_in FROM cr LEFT JOIN fs USING (ord) GROUP BY ord UNION ALL SELECT 1000, 1, (SELECT count(*) FROM ({view_sql('shadow')}) WHERE starts_with(split_part(value, ':', 2), '$')), ''")
def coverage(spark, sf_dir):
    path = lambda name: F.concat(F.lit("/srv/n"), F.col("n_nationkey").cast("string"), F.lit(name))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    every = view(spark, sf_dir, "env_lines").select(F.lit(100).alias("ord"), "path").distinct()
    matched = nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("int").alias("ord"), path("/app.env").alias("path")).unionByName(every).unionByName(nation.select(F.lit(200).alias("ord"), path("/none.env").alias("path")))
    found = extract.extract_env(view(spark, sf_dir, "env_lines")).select(T.location_path(F.col("location")).alias("path"), "location")
    return audit.coverage(matched, matched.join(found, "path"), (1000, view(spark, sf_dir, "shadow")))


WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS s FROM documents)"


@query(f"WITH {WORDS} SELECT CASE WHEN strlen(s) < 8 THEN 'too_short' WHEN strlen(s) < 12 AND (regexp_matches(s, '^[0-9]+$') OR (regexp_matches(s, '^([a-z]+|[A-Z]+)$') AND length(regexp_replace(s, '[^aeiouyAEIOUY]', '', 'g')) * 4 >= length(s) AND NOT regexp_matches(s, '(?i)[^aeiouy]{{4}}'))) THEN 'weak' ELSE 'searchable' END AS class, count(*) AS n FROM w GROUP BY 1")
def searchability(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0)).alias("s")).distinct()
    return words.groupBy(T.searchability(F.col("s")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


TOKEN = 'token = "([0-9a-f]{40})"'
TOKENS = f"tok AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{TOKEN}', 1)) AS secret FROM documents)"


def _tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    secrets = docs.select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN), 1)).alias("secret")).distinct()
    p = _fp(spark)
    return secrets.withColumn("label", p.label(p.fp(F.col("secret"))))


@query(f"WITH {TOKENS}, u AS (SELECT d.doc_id, t.secret FROM documents d, LATERAL (SELECT DISTINCT unnest(regexp_extract_all(d.text, '{TOKEN}', 1)) AS secret) t) SELECT {label_sql(fp_sql('secret'))} AS label, count(*) AS n_documents FROM u GROUP BY secret HAVING count(*) > 1")
def reused_document_tokens(spark, sf_dir):
    docs, p = spark.read.parquet(f"{sf_dir}/documents.parquet"), _fp(spark)
    each = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), 1))).alias("secret")).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("location"), p.fp(F.col("secret")).alias("fp"))
    return audit.reused(each).select(p.label(F.col("fp")).alias("label"), F.col("n_locations").alias("n_documents"))


def _b64(o: int) -> str:
    first = -(-8 * o // 6)
    return f"substr(to_base64(unhex('{'00' * o}') || encode(secret)), {first + 1}, CAST(floor((strlen(secret) + {o}) * 8 / 6) AS INT) - {first})"


@query(f"WITH {TOKENS}, f AS (SELECT secret, secret AS needle FROM tok UNION SELECT secret, {_b64(0)} FROM tok UNION SELECT secret, {_b64(1)} FROM tok UNION SELECT secret, {_b64(2)} FROM tok) SELECT sha256(needle) AS needle_sha256, min({label_sql(fp_sql('secret'))}) AS label FROM f GROUP BY needle")
def dictionary_forms(spark, sf_dir):
    return known.dictionary(_tokens(spark, sf_dir)).select(F.sha2("needle", 256).alias("needle_sha256"), "label")


def _spans(spark, sf_dir, table, key, column):
    files = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("path"), F.col(column).alias("content"))
    return files, known.merge_hits(known.find_known(files, known.dictionary(_tokens(spark, sf_dir))))


def _count_sql(table: str, key: str, column: str) -> str:
    # Tokens are 40 hex digits: longer runs hold one at each place.
    return f"WITH {TOKENS}, h AS (SELECT d.{key} AS path, t.secret, (strlen(d.{column}) - strlen(replace(d.{column}, t.secret, ''))) // 40 AS n FROM {table} d, tok t WHERE contains(d.{column}, t.secret)) SELECT path, {label_sql(fp_sql('secret'))} AS label, CAST(n AS BIGINT) AS n FROM h"


@query(_count_sql("documents", "doc_id", "text"))
def count_known_documents(spark, sf_dir):
    return known.count_known(_spans(spark, sf_dir, "documents", "doc_id", "text")[1])


@query(_count_sql("pages", "page_id", "html"))
def count_known_pages(spark, sf_dir):
    return known.count_known(_spans(spark, sf_dir, "pages", "page_id", "html")[1])


_ORDER_LINE = "'order ' || o_orderkey || ' of Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ', ' || o_orderpriority"


@query(f"WITH o AS (SELECT regexp_extract({_ORDER_LINE}, 'Customer#[0-9]*') AS c_name FROM orders) SELECT label, count(*) AS n FROM o JOIN (SELECT DISTINCT c_name, {label_sql(fp_sql('c_name'))} AS label FROM customer) USING (c_name) GROUP BY label")
def known_customers(spark, sf_dir):
    """A dictionary as long as a table, all of whose values begin alike: how often each name occurs in the lines of orders."""
    p = _fp(spark)
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("secret")).distinct()
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("path"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(", "), "o_orderpriority").alias("content"))
    spans = known.merge_hits(known.find_known(lines, known.dictionary(names.withColumn("label", p.label(p.fp(F.col("secret")))))))
    return spans.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH h AS ({_count_sql('documents', 'doc_id', 'text')}) SELECT label, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY label")
def count_known_ranges(spark, sf_dir):
    """The texts of all documents as a few long files, searched by byte ranges that are much smaller than they."""
    folder = readers.scratch(spark, "texts")
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text")).write.text(folder)
    needles = known.dictionary(_tokens(spark, sf_dir))
    files = ranges.read_ranges(spark, folder, needles.agg(F.max(F.octet_length("needle"))).first()[0] or 0, 1 << 20)
    return known.merge_hits(known.find_known(files, needles)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


#: Credentials beside the tokens, most of which can't be searched for: numbers of customers, letters of states, words.
_WORDS_SQL = "SELECT lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS secret FROM orders UNION SELECT o_orderstatus FROM orders UNION SELECT lower(c_mktsegment) FROM customer UNION SELECT c_name FROM customer"


@query(f"WITH h AS ({_count_sql('documents', 'doc_id', 'text')}), x AS ({_WORDS_SQL}), k AS (SELECT DISTINCT secret, CASE WHEN strlen(secret) < 8 THEN 'short' WHEN strlen(secret) < 12 AND (regexp_matches(secret, '^[0-9]+$') OR regexp_matches(secret, '^[a-z]+$') AND length(regexp_replace(secret, '[^aeiouy]', '', 'g')) * 4 >= length(secret) AND NOT regexp_matches(secret, '[^aeiouy]{{4}}')) THEN 'weak' ELSE 'ok' END AS kind FROM x) SELECT (SELECT count(*) FROM documents) AS files, coalesce(CAST(sum(n) AS BIGINT), 0) AS occurrences, count(DISTINCT path) AS files_with_hits, count(DISTINCT label) AS labels, (SELECT count(*) FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{TOKEN}', 1)) FROM documents)) + (SELECT count(*) FROM k WHERE kind = 'ok') AS credentials, (SELECT count(*) FROM k WHERE kind = 'short') AS too_short, (SELECT count(*) FROM k WHERE kind = 'weak') AS weak FROM h")
def search_totals(spark, sf_dir):
    orders, customer = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    words = orders.select(F.explode(F.array(F.lpad(F.col("o_custkey").cast("string"), 9, "0"), "o_orderstatus")).alias("secret")).union(customer.select(F.explode(F.array(F.lower("c_mktsegment"), "c_name"))))
    return known.search_totals(*_spans(spark, sf_dir, "documents", "doc_id", "text"), _tokens(spark, sf_dir).select("secret").union(words))


@query(f"WITH h AS ({_count_sql('documents', 'doc_id', 'text')}), n AS (SELECT path, sum(n) AS n FROM h GROUP BY path) SELECT path, CAST(n AS BIGINT) AS n_redacted, CAST(strlen(d.text) - 40 * n + 22 * n AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS n_left FROM n JOIN documents d ON d.doc_id = path")
def redact_documents(spark, sf_dir):
    """The redacted copies, searched once more: nothing is left."""
    needles = known.dictionary(_tokens(spark, sf_dir))
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    out = known.redact_rows(files, needles).filter("n_redacted > 0")
    left = known.find_known(out.select("path", "content"), needles).groupBy("path").agg(F.count(F.lit(1)).alias("n_left"))
    return out.join(left, "path", "left").select("path", "n_redacted", F.length("content").cast("long").alias("n_bytes"), F.coalesce("n_left", F.lit(0)).alias("n_left"))


@query(f"WITH h AS ({_count_sql('documents', 'doc_id', 'text')}), n AS (SELECT path, sum(n) AS n FROM h GROUP BY path) SELECT 'd' || doc_id % 7 || '/' || doc_id || '.txt' AS name, CAST(strlen(d.text) - 18 * n AS BIGINT) AS n_bytes FROM n JOIN documents d ON d.doc_id = path")
def redacted_files(spark, sf_dir):
    """The redacted copies as files of their own, read again: those without a credential aren't there."""
    folder, needles = readers.scratch(spark, "copies"), known.dictionary(_tokens(spark, sf_dir))
    path = F.concat(F.lit("/srv/d"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(path.alias("path"), F.col("text").alias("content"))
    redacted.write_files(_kept(known.redact_rows(files, needles), "redacted"), folder, "/srv")
    copies = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return copies.select(F.regexp_extract("path", "(d[0-9]+/[^/]*)$", 1).alias("name"), F.length("content").cast("long").alias("n_bytes"))


@query("""WITH h AS (SELECT l_suppkey AS path, CAST(l_partkey % 5000 AS BIGINT) AS start, CAST(l_quantity AS BIGINT) AS len, 'c' || l_linenumber AS label FROM lineitem),
r AS (SELECT *, CASE WHEN start >= max(start + len) OVER w THEN 1 WHEN max(start + len) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM h WINDOW w AS (PARTITION BY path ORDER BY start, len, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY start, len, label ROWS UNBOUNDED PRECEDING) AS span FROM r)
SELECT path, min(start) AS start, max(start + len) - min(start) AS len, arg_min(label, row(start, len, label)) AS label FROM s GROUP BY path, span""")
def merge_hits(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return known.merge_hits(li.select(F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 5000).alias("start"), F.col("l_quantity").cast("long").alias("len"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("label")))


CHANGES = f"changes AS ({view_sql('changes')})"


@query(f"WITH {CHANGES} SELECT DISTINCT \"commit\", path FROM changes WHERE status = 'A' AND regexp_matches(path, '{T.CREDENTIAL_FILE}') AND NOT regexp_matches(path, '{T.HARMLESS_FILE}')")
def credential_files_added(spark, sf_dir):
    return commits.credential_files_added(view(spark, sf_dir, "changes"))


@query(f"WITH {CHANGES} SELECT \"commit\" FROM changes GROUP BY \"commit\" HAVING max(CASE WHEN status <> 'D' AND NOT is_binary AND n_hunks > 0 THEN 1 ELSE 0 END) = 1")
def scannable_commits(spark, sf_dir):
    return commits.scannable_commits(view(spark, sf_dir, "changes"))


@query(f"WITH {CHANGES}, s AS (SELECT DISTINCT \"commit\" FROM changes WHERE status <> 'D' AND NOT is_binary AND n_hunks > 0) SELECT \"commit\" FROM s WHERE \"commit\" NOT IN (SELECT \"commit\" FROM changes WHERE line = 1)")
def scan_completeness(spark, sf_dir):
    rows = view(spark, sf_dir, "changes")
    return commits.unscanned(commits.scannable_commits(rows), rows.filter("line = 1"))


GRANT = "CASE WHEN regexp_matches(t, '(?im)Grant of Patent License') THEN 'Apache-2.0 section 3' WHEN regexp_matches(t, '(?im)^ *11\\. *Patents') THEN 'GPL/AGPL-3.0 section 11' WHEN regexp_matches(t, '(?im)under (its )?Patent Claims') THEN 'MPL-2.0 section 2.1' WHEN regexp_matches(t, '(?im)^#+ *Patents? *$') THEN 'FSL Patents section' END"


@query(f"WITH {CHANGES}, f AS (SELECT c.path || '/' || (hash_ % 97) AS path, c.\"commit\", c.line, c.text FROM (SELECT *, CAST(line AS BIGINT) * 31 + strlen(text) AS hash_ FROM changes) c WHERE status IN ('A', 'M') AND regexp_matches(path, '{T.LICENCE_FILE}')), g AS (SELECT path, string_agg(text, chr(10)) AS t FROM f GROUP BY path) SELECT path, {GRANT} AS \"grant\" FROM g WHERE {GRANT} IS NOT NULL")
def licence_changes(spark, sf_dir):
    rows = view(spark, sf_dir, "changes").filter(F.col("path").rlike(T.LICENCE_FILE) & F.col("status").isin("A", "M"))
    # The operator sees the bucket as a folder; the query shows it last.
    rows = rows.withColumn("path", F.concat(((F.col("line") * 31 + F.length("text")) % 97).cast("string"), F.lit("/"), F.col("path")))
    found = commits.licence_changes(rows, rows.select("commit", F.col("path").alias("file"), "line", "text"))
    return found.withColumn("path", F.regexp_replace("path", "^([0-9]+)/(.*)$", "$2/$1"))


SHAPES = (("phone", r"\+1 \([0-9]{3}\) 555-[0-9]{4}"), ("email", r"[a-z0-9.]+@mail[0-9]*\.example"), ("ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"), ("token", TOKEN), ("number", r"\b[0-9]{16}\b"))
_LINES = "l AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i + 1] AS text FROM documents, LATERAL (SELECT unnest(range(len(string_split(text, chr(10))))) AS i))"


def _document_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


@query(f"WITH {_LINES}, h AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, doc_id FROM l WHERE regexp_matches(text, '{p}')" for n, p in SHAPES) + ") SELECT DISTINCT rule, 'f' || doc_id % 3 AS file, CAST(doc_id AS VARCHAR) AS \"commit\" FROM h")
def pattern_secrets(spark, sf_dir):
    return commits.pattern_secrets(_file_lines(spark, sf_dir), list(SHAPES))


def _file_lines(spark, sf_dir):
    rows = _document_lines(spark, sf_dir)
    return rows.select(F.concat(F.lit("acme/r"), (F.col("doc_id") % 4).cast("string")).alias("repo"), F.col("doc_id").cast("string").alias("commit"), F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("file"), "line", "text")


_DENY = " UNION ALL ".join(f"SELECT 'acme/r' || doc_id % 4 AS repo, '{n}' AS label, CAST(doc_id AS STRING) AS c, 'f' || doc_id % 3 AS f, line FROM l WHERE regexp_matches(text, '{p}')" for n, p in SHAPES)


@query(f"WITH {_LINES}, a AS (SELECT 'acme/r' || n_nationkey AS repo, CASE WHEN n_nationkey % 2 = 0 THEN '{SHAPES[0][0]}' ELSE '{SHAPES[1][0]}' END AS label FROM nation), h0 AS ({_DENY}), h AS (SELECT * FROM h0 WHERE (repo, label) NOT IN (SELECT (repo, label) FROM a)), r AS (SELECT *, row_number() OVER (PARTITION BY repo, label ORDER BY c, f, line) AS n FROM h), p AS (SELECT repo, label, list_sort(list(DISTINCT c || ' ' || f))[1:5] AS p FROM r WHERE n <= 50 GROUP BY repo, label) SELECT repo, label, count(*) AS n_lines, array_to_string(any_value(p.p), ';') AS places FROM h JOIN p USING (repo, label) GROUP BY repo, label")
def denylist_hits(spark, sf_dir):
    """The lines of every repository are held against the list; only labels allowed in a repository are left out of it."""
    allowed = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("acme/r"), F.col("n_nationkey").cast("string")).alias("repo"), F.when(F.col("n_nationkey") % 2 == 0, SHAPES[0][0]).otherwise(SHAPES[1][0]).alias("label"))
    return commits.denylist_hits(_file_lines(spark, sf_dir), list(SHAPES), allowed)


#: A rule for each customer of five nations.
_NAMED = f"x AS (SELECT o_orderkey, regexp_extract({_ORDER_LINE}, 'Customer#([0-9]*)', 1) AS c FROM orders), h AS (SELECT 'acme/r' || o_orderkey % 4 AS repo, 'customer-' || c_custkey AS label, CAST(o_orderkey AS VARCHAR) AS c, 'f' || o_orderkey % 3 AS f FROM x JOIN customer ON x.c = lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHERE c_nationkey < 5)"


@query(f"WITH {_NAMED}, r AS (SELECT *, row_number() OVER (PARTITION BY repo, label ORDER BY c, f) AS n FROM h), p AS (SELECT repo, label, list_sort(list(DISTINCT c || ' ' || f))[1:5] AS p FROM r WHERE n <= 50 GROUP BY repo, label) SELECT repo, label, count(*) AS n_lines, array_to_string(any_value(p.p), ';') AS places FROM h JOIN p USING (repo, label) GROUP BY repo, label")
def denylist_many_rules(spark, sf_dir):
    """A denylist that grows with a table: of its rules only those whose literal part occurs in a line are tried."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_nationkey < 5").select("c_custkey").collect()
    rules = [(f"customer-{r[0]}", rf"(?i)\bCUSTOMER#{r[0]:09d}(?:[^0-9]|$)") for r in names]
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = lambda n: (F.col("o_orderkey") % n).cast("string")
    text = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(", "), "o_orderpriority")
    lines = o.select(F.concat(F.lit("acme/r"), key(4)).alias("repo"), F.col("o_orderkey").cast("string").alias("commit"), F.concat(F.lit("f"), key(3)).alias("file"), F.lit(0).alias("line"), text.alias("text"))
    return commits.denylist_hits(lines, rules)


#: A url for each form that a destination takes; {r} is a number.
URLS = ("https://github.com/Acme/r{r}.git", "git@github.com:acme/r{r}", "/srv/git/r{r}", "https://other.example/x{r}", "https://github.com/acme/new{r}", "https://user@github.com/acme/r{r}/", "ssh://git@github.com/acme/r{r}.git", "file:///srv/x{r}", "../mirror{r}", "./r{r}", "git@other.example:acme/r{r}")
DEST = rf"""push AS (SELECT o_orderkey AS push_id, replace(({list(URLS)})[o_custkey % {len(URLS)} + 1], '{{r}}', CAST(o_custkey % 40 AS VARCHAR)) AS url FROM orders), vis AS (SELECT 'acme/r' || n_nationkey AS slug, CASE WHEN n_nationkey % 2 = 0 THEN 'public' ELSE 'private' END AS visibility FROM nation),
slug AS (SELECT push_id, CASE WHEN url LIKE '%github.com%' THEN rtrim(regexp_replace(rtrim(lower(regexp_extract(url, 'github.com[:/](.*)', 1)), '/'), '\.git$', ''), '/') ELSE url END AS slug, url LIKE '%github.com%' AS hosted FROM push),
placed AS (SELECT push_id, slug, CASE WHEN hosted THEN visibility WHEN regexp_matches(slug, '^(/|\.|file:)') AND slug <> '../mirror7' THEN 'private' ELSE 'public' END AS visibility FROM slug LEFT JOIN vis USING (slug))"""


def _placed(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    url = F.get(F.array(*map(F.lit, URLS)), (F.col("o_custkey") % len(URLS)).cast("int"))
    url = F.replace(url, F.lit("{r}"), (F.col("o_custkey") % 40).cast("string"))
    vis = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("acme/r"), F.col("n_nationkey").cast("string")).alias("slug"), F.when(F.col("n_nationkey") % 2 == 0, "public").otherwise("private").alias("visibility"))
    return commits.classify_destination(o.select(F.col("o_orderkey").alias("push_id"), url.alias("url")), vis, ("../mirror7",))


@query(f"WITH {DEST} SELECT push_id, slug, visibility FROM placed")
def classify_destination(spark, sf_dir):
    return _placed(spark, sf_dir)


ALLOW = "allow AS (SELECT 'acme/r' || n_nationkey AS slug FROM nation WHERE n_nationkey % 4 = 0)"


def _allow(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey % 4 = 0").select(F.concat(F.lit("Acme/R"), F.col("n_nationkey").cast("string")).alias("repo"))


@query(f"WITH {DEST}, {ALLOW} SELECT push_id, slug FROM placed WHERE visibility = 'public' AND slug NOT IN (SELECT slug FROM allow)")
def public_not_allowed(spark, sf_dir):
    return commits.public_not_allowed(_placed(spark, sf_dir), _allow(spark, sf_dir))


@query(f"WITH {DEST}, {ALLOW}, bad AS (SELECT push_id, 'not allowed' AS reason FROM placed WHERE visibility = 'public' AND slug NOT IN (SELECT slug FROM allow) UNION ALL SELECT push_id, 'visibility unknown' FROM placed WHERE visibility IS NULL), why AS (SELECT push_id, concat_ws('; ', CASE WHEN push_id % 10 = 0 THEN 'not scanned' END, string_agg(DISTINCT reason, '; ')) AS reasons FROM placed LEFT JOIN bad USING (push_id) GROUP BY push_id) SELECT push_id, CASE WHEN reasons = '' THEN 'ok' ELSE 'refused' END AS verdict, reasons FROM why")
def push_verdict(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    bad = commits.public_not_allowed(placed, _allow(spark, sf_dir)).select("push_id", F.lit("not allowed").alias("reason"))
    bad = bad.unionByName(placed.filter("visibility is null").select("push_id", F.lit("visibility unknown").alias("reason")))
    return commits.push_verdict(placed, bad, placed.filter("push_id % 10 <> 0"))


EDGES = "e AS (SELECT o_orderkey AS sha, lag(o_orderkey) OVER w AS parent, row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey) AS total, o_custkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


@query(f"WITH {EDGES} SELECT o_custkey AS push_id, sha FROM e WHERE n > total // 2")
def outgoing_commits(spark, sf_dir):
    """Each customer's orders are a branch; the remote has the first half."""
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.col("o_orderkey").alias("sha"), F.lag("o_orderkey").over(w).alias("parent"), F.row_number().over(w).alias("n"), F.count(F.lit(1)).over(W.partitionBy("o_custkey")).alias("total"))
    tips = e.groupBy(F.col("o_custkey").alias("push_id")).agg(F.max_by("sha", "n").alias("sha"), F.max_by(F.when(F.col("n") <= F.floor(F.col("total") / 2), F.col("sha")), F.when(F.col("n") <= F.floor(F.col("total") / 2), F.col("n"))).alias("remote_sha"))
    return commits.outgoing_commits(e.select("sha", "parent"), tips)


#: Eight customers' branches are one repository: every third order also merges what came before it there. Remotes have refs at
#: two fifths and at half of it. A customer with an even number has its own ref on the remote, half way; others push a new branch.
BRANCHES = """o AS (SELECT o_orderkey AS sha, o_custkey, o_custkey // 8 AS remote, row_number() OVER c AS n, count(*) OVER (PARTITION BY o_custkey) AS total, row_number() OVER r AS m, count(*) OVER (PARTITION BY o_custkey // 8) AS every,
lag(o_orderkey) OVER c AS up, CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey) OVER r END AS merged FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), r AS (PARTITION BY o_custkey // 8 ORDER BY o_orderdate, o_orderkey)),
edge AS (SELECT sha, up AS parent FROM o WHERE up IS NOT NULL UNION SELECT sha, merged FROM o WHERE merged IS NOT NULL),
tip AS (SELECT o_custkey AS push_id, any_value(remote) AS remote, arg_max(sha, n) AS sha, max(CASE WHEN o_custkey % 2 = 0 AND n = total // 2 THEN sha END) AS remote_sha FROM o GROUP BY o_custkey),
ref AS (SELECT remote, sha FROM o WHERE m IN (every * 2 // 5, every // 2)),
walk (push_id, own, sha) AS (SELECT * FROM (SELECT push_id, true, sha FROM tip UNION ALL SELECT push_id, false, remote_sha FROM tip WHERE remote_sha IS NOT NULL UNION ALL SELECT push_id, false, ref.sha FROM tip JOIN ref USING (remote) WHERE remote_sha IS NULL)
UNION SELECT push_id, own, parent FROM walk JOIN edge USING (sha))"""


@query(f"WITH RECURSIVE {BRANCHES} SELECT push_id, sha FROM walk GROUP BY push_id, sha HAVING bool_and(own)")
def outgoing_new_branches(spark, sf_dir):
    """Pushes over a history with merges: what no ref of the remote reaches."""
    from pyspark.sql import Window as W

    group = F.expr("o_custkey div 8").alias("remote")
    # A customer has one remote, so all windows and groups are dealt by it, in one shuffle.
    c, r = (W.partitionBy(*k).orderBy("o_orderdate", "o_orderkey") for k in (("remote", "o_custkey"), ("remote",)))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", group)
    o = o.withColumns({"m": F.row_number().over(r), "before": F.lag("o_orderkey").over(r), "every": F.count(F.lit(1)).over(W.partitionBy("remote"))})
    o = o.select(F.col("o_orderkey").alias("sha"), "o_custkey", "remote", F.row_number().over(c).alias("n"), F.count(F.lit(1)).over(W.partitionBy("remote", "o_custkey")).alias("total"), "m", "every", F.lag("o_orderkey").over(c).alias("up"), "before")
    merged = F.when(F.expr("sha % 3 = 0"), F.array(F.struct(F.col("before").alias("parent"), F.lit(1).alias("nth")))).otherwise(F.array())
    edges = o.select("sha", F.inline(F.concat(F.array(F.struct(F.col("up").alias("parent"), F.lit(0).alias("nth"))), merged)))
    tips = o.groupBy(F.col("o_custkey").alias("push_id"), "remote").agg(F.max_by("sha", "n").alias("sha"), F.max(F.when((F.col("o_custkey") % 2 == 0) & (F.col("n") == F.expr("total div 2")), F.col("sha"))).alias("remote_sha"))
    refs = o.filter("m = every * 2 div 5 or m = every div 2").select("remote", "sha")
    return commits.outgoing_commits(edges, tips, refs)


COMMANDS = f"cmd AS ({view_sql('commands')})"
VERDICTS = f"""{COMMANDS}, v AS (SELECT cmd_id, CASE WHEN command LIKE 'git push --no-verify%' THEN 'no-verify on push' WHEN command LIKE '%config --global core.hooksPath%' THEN 'hooks path' WHEN command LIKE '%> ~/.gitconfig' THEN 'config file write'
WHEN command LIKE 'GIT_CONFIG_NOSYSTEM=%' THEN 'config environment' WHEN command LIKE '%--public' THEN 'public repository' WHEN command = 'gh release create v1' THEN 'unnamed release' WHEN command LIKE '%acme/other' THEN 'release' WHEN command LIKE '%npm publish' THEN 'npm publish'
WHEN command LIKE 'git -c core.hooksPath%' THEN 'hooks path override' WHEN command LIKE 'rm %gitconfig' THEN 'config file delete' WHEN command LIKE '%twine upload%' THEN 'twine upload' ELSE '' END AS reason FROM cmd)"""


def _verdicts(spark, sf_dir):
    allow = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey = 0").select(F.lit("ACME/site").alias("repo"))
    return commands.command_verdict(view(spark, sf_dir, "commands"), allow)


@query(f"WITH {VERDICTS} SELECT cmd_id, CASE WHEN reason = '' THEN 'allow' ELSE 'deny' END AS verdict, reason FROM v")
def command_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir)


def _rule_rows(rules) -> str:
    listed = lambda ps: "[" + ", ".join("'(?i)" + p.replace("'", "''") + "'" for p in ps) + "]::VARCHAR[]"
    return ", ".join(f"({ord_}, '{reason}', {listed(every)}, {listed(none)})" for ord_, reason, every, none in rules)


#: The rules as tables that are joined with the commands: every pattern of a rule has to match, and none of the others.
COMPOSED = rf"""cmd AS ({view_sql('composed')}), d AS (SELECT DISTINCT command, translate(command, '"''\', '') AS bare FROM cmd),
segment (ord, reason, every, without) AS (VALUES {_rule_rows(commands.SEGMENT_RULES)}), whole (ord, reason, every, without) AS (VALUES {_rule_rows(commands.COMMAND_RULES)}),
s AS (SELECT command, unnest(range(len(p))) AS seg, trim(regexp_replace(unnest(p), ' +', ' ', 'g')) AS t FROM (SELECT command, string_split_regex(bare, '[;&|(){{}}\n]') AS p FROM d)),
h AS (SELECT command, -1 AS seg, ord, reason FROM d JOIN whole ON len(list_filter(every, lambda p: NOT regexp_matches(regexp_replace(bare, ' +', ' ', 'g'), p))) = 0 AND len(list_filter(without, lambda p: regexp_matches(regexp_replace(bare, ' +', ' ', 'g'), p))) = 0
UNION ALL SELECT command, seg, ord, reason FROM s JOIN segment ON len(list_filter(every, lambda p: NOT regexp_matches(t, p))) = 0 AND len(list_filter(without, lambda p: regexp_matches(t, p))) = 0
UNION ALL SELECT command, seg, 28, 'release' FROM s WHERE regexp_matches(t, '(^| )release +(create|upload|edit)( |$)') AND regexp_extract(t, '(-R|--repo)[= ]+([^ ]+)', 2) <> '' AND lower(regexp_extract(t, '(-R|--repo)[= ]+([^ ]+)', 2)) <> 'acme/site'),
f AS (SELECT command, arg_min(reason, row(seg, ord)) AS reason FROM h GROUP BY command)"""


@query(f"WITH {COMPOSED} SELECT cmd_id, CASE WHEN reason IS NULL THEN 'allow' ELSE 'deny' END AS verdict, coalesce(reason, '') AS reason FROM cmd LEFT JOIN f USING (command)")
def composed_verdict(spark, sf_dir):
    """Commands put together from parts, each rule among them, judged by the rules as a table in SQL."""
    allow = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey = 0").select(F.lit("ACME/site").alias("repo"))
    return commands.command_verdict(view(spark, sf_dir, "composed"), allow)


@query(f"WITH {VERDICTS} SELECT CASE WHEN cmd_id % 2 = 0 THEN 'allow' ELSE 'deny' END AS expected, CASE WHEN reason = '' THEN 'allow' ELSE 'deny' END AS verdict, count(*) AS n FROM v GROUP BY 1, 2")
def replay_verdicts(spark, sf_dir):
    rows = _verdicts(spark, sf_dir)
    return commands.replay(rows, rows.select("cmd_id", F.when(F.col("cmd_id") % 2 == 0, "allow").otherwise("deny").alias("expected")))


@query(f"WITH {COMMANDS}, p AS (SELECT cmd_id, string_split_regex(translate(translate(command, '\"''\\', ''), chr(9), ' '), '[;&|(){{}}\n]') AS p FROM cmd), s AS (SELECT cmd_id, i AS seg, trim(regexp_replace(p[i + 1], ' +', ' ', 'g')) AS text FROM p, LATERAL (SELECT unnest(range(len(p))) AS i)) SELECT cmd_id, CAST(seg AS INT) AS seg, text FROM s WHERE text <> ''")
def command_segments(spark, sf_dir):
    return commands.command_segments(view(spark, sf_dir, "commands"))


SHELL = f"cmd AS ({view_sql('shell_commands')})"


@query(f"""WITH {SHELL}, w (command, target) AS (VALUES ('cp a b /etc/git*', '/etc/git*'), ('rm -rf build dist', 'build'), ('rm -rf build dist', 'dist'), ('sed -i s/a/b/ .git/conf*', 's/a/b/'), ('sed -i s/a/b/ .git/conf*', '.git/conf*'),
('sed s/a/b/ in.txt > out.txt', 'out.txt'), ('dd if=/dev/zero of=disk.img', 'disk.img'), ('ls | tee -a log.txt copy.txt', 'log.txt'), ('ls | tee -a log.txt copy.txt', 'copy.txt'), ('echo x >> /etc/vigil/allow', '/etc/vigil/allow'),
('sed -i "s/.git*//" notes', 's/.git*//'), ('sed -i "s/.git*//" notes', 'notes'), ('make 2>err.log', 'err.log'), ('mv new ~/.gitconfig', '~/.gitconfig'))
SELECT cmd_id, CAST(CASE WHEN command LIKE 'ls |%' THEN 1 ELSE 0 END AS INT) AS seg, target FROM cmd JOIN w USING (command)""")
def write_targets(spark, sf_dir):
    return commands.write_targets(commands.command_segments(view(spark, sf_dir, "shell_commands")))


@query(f"""WITH {SHELL}, r (command, reason) AS (VALUES ('cp a b /etc/git*', 'wildcard write'), ('sed -i s/a/b/ .git/conf*', 'wildcard write'), ('echo x >> /etc/vigil/allow', 'guarded write'),
('gh api -X PUT repos/a/b/contents/x -f m=1', 'contents written'), ('mv new ~/.gitconfig', 'config file copy'), ('git log --since=x --$OPT', 'option built at run time'))
SELECT cmd_id, CASE WHEN reason IS NULL THEN 'allow' ELSE 'deny' END AS verdict, coalesce(reason, '') AS reason FROM cmd LEFT JOIN r USING (command)""")
def write_verdict(spark, sf_dir):
    allow = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("acme/site").alias("repo"))
    return commands.command_verdict(view(spark, sf_dir, "shell_commands"), allow)


LOG = rf"""raw AS ({view_sql('access_log')}), log AS (SELECT CAST(CAST(replace(regexp_extract(value, '{transcripts.LOG_LINE}', 1), 'Z', '') AS TIMESTAMP) AS STRING) AS ts, regexp_extract(value, '{transcripts.LOG_LINE}', 2) AS verb,
nullif(regexp_extract(value, '{transcripts.LOG_LINE}', 3), '-') AS name, CAST(regexp_extract(value, '{transcripts.LOG_LINE}', 4) AS BIGINT) AS pid, CAST(regexp_extract(value, '{transcripts.LOG_LINE}', 5) AS BIGINT) AS uid FROM raw WHERE regexp_matches(value, '{transcripts.LOG_LINE}'))"""


def _log(spark, sf_dir):
    return transcripts.parse_access_log(view(spark, sf_dir, "access_log")).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _inventory(spark, sf_dir):
    """The view has a line for each event, in the order of their ids, which are its pids."""
    return transcripts.vault_inventory(_log(spark, sf_dir).withColumnRenamed("pid", "line"))


@query(f"WITH {LOG} SELECT * FROM log")
def parse_access_log(spark, sf_dir):
    return _log(spark, sf_dir)


@query(f"WITH {LOG} SELECT name, verb, count(*) AS n, max(ts) AS last, CAST(grouping(name) * 2 + grouping(verb) AS BIGINT) AS level FROM log GROUP BY ROLLUP (name, verb)")
def access_rollup(spark, sf_dir):
    return transcripts.access_rollup(_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT verb FROM (VALUES ('init'), ('put'), ('get'), ('list'), ('rm')) t(verb) WHERE verb NOT IN (SELECT verb FROM log)")
def unused_verbs(spark, sf_dir):
    return transcripts.unused_verbs(_log(spark, sf_dir))


INVENTORY = LOG + ", inv AS (SELECT name, arg_max(verb, row(ts, pid)) AS verb, max(ts) AS ts FROM log WHERE verb IN ('put', 'rm') GROUP BY name HAVING arg_max(verb, row(ts, pid)) = 'put')"


@query(f"WITH {INVENTORY} SELECT name, ts FROM inv")
def vault_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir)


HANDLES = rf"turns AS ({view_sql('handle_turns')}), h AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '{transcripts.HANDLE}', 1)) AS name FROM turns)"


@query(f"WITH {INVENTORY}, {HANDLES} SELECT name, conv_id, turn FROM h WHERE name NOT IN (SELECT name FROM inv)")
def unknown_handles(spark, sf_dir):
    handles = transcripts.secret_handles(view(spark, sf_dir, "handle_turns"))
    return transcripts.unknown_handles(handles, _inventory(spark, sf_dir)).select("name", "conv_id", "turn")


@query(f"WITH {LOG} SELECT name, regexp_matches(name, '^[A-Za-z0-9._-]+$') AND NOT contains(name, '..') AS valid, regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)*$') AS kebab, count(*) AS n FROM log WHERE name IS NOT NULL GROUP BY name")
def name_convention(spark, sf_dir):
    rows = _log(spark, sf_dir).filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("name", transcripts.valid_name(F.col("name")).alias("valid"), transcripts.kebab_name(F.col("name")).alias("kebab"), "n")


PASTED = rf"{HANDLES}, p AS (SELECT DISTINCT conv_id, turn, role, unnest(regexp_extract_all(text, '(pw-[0-9]+-longvalue)', 1)) AS secret FROM turns), q AS (SELECT conv_id, turn, role, {label_sql(fp_sql('secret'))} AS label FROM p)"


def _pasted(spark, sf_dir):
    turns, p = view(spark, sf_dir, "handle_turns"), _fp(spark)
    secrets = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("pw-"), (F.col("conv_id") % 40).cast("string"), F.lit("-longvalue")).alias("secret")).distinct()
    secrets = secrets.withColumn("label", p.label(p.fp(F.col("secret"))))
    files = turns.select(F.struct("conv_id", "turn", "role").alias("key"), F.col("text").alias("content")).withColumn("path", F.to_json("key"))
    hits = known.find_known(files, known.dictionary(secrets)).select("path", "label").distinct()
    key = F.from_json("path", "conv_id long, turn long, role string")
    return hits.select(key.alias("key"), "label").select("key.conv_id", "key.turn", "key.role", "label")


@query(f"WITH {PASTED} SELECT conv_id, turn, label FROM q WHERE role = 'user'")
def pasted_secrets(spark, sf_dir):
    return _pasted(spark, sf_dir).filter("role = 'user'").select("conv_id", "turn", "label")


@query(f"WITH {PASTED}, u AS (SELECT conv_id, label, min(turn) AS pasted_turn FROM q WHERE role = 'user' GROUP BY 1, 2) SELECT a.conv_id, a.label, pasted_turn, a.turn AS echoed_turn FROM q a JOIN u USING (conv_id, label) WHERE a.role = 'assistant' AND a.turn > pasted_turn")
def echoed_secrets(spark, sf_dir):
    return transcripts.echoed_secrets(_pasted(spark, sf_dir))


WG = rf"""wl AS ({view_sql('wg_lines')}), wt AS (SELECT path, line, trim(text) AS t FROM wl WHERE NOT regexp_matches(text, '^\s*[;#]')),
ws AS (SELECT *, sum(CASE WHEN starts_with(t, '[') THEN 1 ELSE 0 END) OVER w AS sec, sum(CASE WHEN t = '[Peer]' THEN 1 ELSE 0 END) OVER w AS no, regexp_extract(t, '^([A-Za-z]+) *=', 1) AS k, regexp_extract(t, '^[A-Za-z]+ *= *(.*)$', 1) AS v FROM wt WINDOW w AS (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING)),
wp AS (SELECT path, sec, bool_or(t = '[Peer]') AS is_peer, max(no) AS no, arg_max(split_part(v, ',', 1), line) FILTER (k = 'AllowedIPs') AS allowed FROM ws GROUP BY path, sec)"""


@query(f"WITH {WG} SELECT 'wg:' || path || '#' || CASE WHEN is_peer THEN 'Peer(' || coalesce(allowed, '#' || CAST(wp.no AS BIGINT)) || ').' ELSE '' END || k AS location, {fp_sql('v')} AS fp FROM ws JOIN wp USING (path, sec) WHERE k IN ('PrivateKey', 'PresharedKey')")
def extract_wg(spark, sf_dir):
    return extract.extract_wg(view(spark, sf_dir, "wg_lines")).select("location", _fp(spark).fp(F.col("secret")).alias("fp"))


@query(rf"WITH l AS ({view_sql('token_files')}), t AS (SELECT path, regexp_replace(content, '^\s+|\s+$', '', 'g') AS s FROM l) SELECT 'file:' || path AS location, {fp_sql('s')} AS fp FROM t WHERE s <> ''")
def extract_file(spark, sf_dir):
    return extract.extract_file(view(spark, sf_dir, "token_files")).select("location", _fp(spark).fp(F.col("secret")).alias("fp"))


@query(f"WITH {OBS}, u AS (SELECT DISTINCT fp, {label_sql('fp')} AS label FROM obs) SELECT label, count(*) AS n_fps FROM u GROUP BY label HAVING count(*) > 1")
def shared_labels(spark, sf_dir):
    return audit.shared_labels(_observed(spark, sf_dir).select("fp").distinct().withColumn("label", _fp(spark).label(F.col("fp"))))


@query(f"WITH {MATCHED} SELECT count(*) AS n_rules, count_if(ord NOT IN (SELECT ord FROM matched))::BIGINT AS n_uncovered, count_if(ord NOT IN (SELECT ord FROM matched)) = 0 AS allowed FROM rules")
def search_gate(spark, sf_dir):
    rules, files = _rules(spark, sf_dir)
    return audit.search_gate(rules, audit.match_sources(rules, files))


LIMIT = 360
REPORT = f"""{AGED}, {SAME.removeprefix(OBS + ', ')}, {REUSED}, {DRIFT}, {MISSING}, {MATCHED}, sh AS ({view_sql('shadow')}), acc AS (SELECT p[1] AS u, 20000 - try_cast(p[3] AS BIGINT) AS days FROM (SELECT string_split(value, ':') AS p FROM sh) WHERE starts_with(p[2], '$') AND try_cast(p[3] AS BIGINT) > 0),
f AS (SELECT 0 AS rank, 'uncovered' AS type, kind || ' ' || pattern AS subject, NULL AS label, NULL AS place, NULL::BIGINT AS days, NULL::BOOLEAN AS exact FROM rules WHERE ord NOT IN (SELECT ord FROM matched)
UNION ALL SELECT 1, 'ambiguous', location, NULL, NULL, NULL, NULL FROM obs GROUP BY location HAVING count(DISTINCT fp) > 1
UNION ALL SELECT 2, 'missing', location, NULL, NULL, NULL, NULL FROM missing
UNION ALL SELECT 3, 'drift', CAST(group_id AS VARCHAR), label, location, NULL, NULL FROM drift
UNION ALL SELECT 4, 'reused', {label_sql('r.fp')}, NULL, u.location, NULL, NULL FROM reused r JOIN u ON u.fp = r.fp
UNION ALL SELECT 5, 'stale', location, NULL, NULL, days, exact FROM aged WHERE days >= {LIMIT}
UNION ALL SELECT 6, 'account', u, NULL, NULL, days, NULL FROM acc WHERE days >= {LIMIT}),
g AS (SELECT *, sha256(concat_ws(chr(9), type, subject, coalesce(label, '-'), coalesce(place, '-'), coalesce(CAST(exact AS VARCHAR), '-'))) AS identity FROM f)"""
LINE = f"""CASE type WHEN 'uncovered' THEN 'no file matches ' || subject WHEN 'ambiguous' THEN 'several secrets under the name ' || subject WHEN 'missing' THEN 'no credential at the declared place ' || subject
WHEN 'drift' THEN 'copies of group ' || subject || ' differ: ' || label || ' at ' || place WHEN 'reused' THEN subject || ' is in several places: ' || place WHEN 'stale' THEN subject || CASE WHEN exact THEN ' rotated ' || days || ' days ago' ELSE ' unchanged for ' || days || ' days or more' END || ' (limit {LIMIT})'
ELSE 'account ' || subject || ': password of ' || days || ' days (limit {LIMIT})' END"""


def _report(spark, sf_dir):
    """(report, latest): each stored, so that what asks for several things of a report makes it once."""
    obs = _kept(_observed(spark, sf_dir), "observed")
    now = _kept(_last(obs), "latest")
    same, (rules, files), (prior, seen) = _groups(now), _rules(spark, sf_dir), _split_of(obs)
    aged = audit.credential_age(audit.observe(prior, seen, F.lit(CUT).cast("long")).withColumn("mtime", F.col("since") - 8640000), F.lit(1735689600))
    report = audit.findings(
        uncovered=audit.uncovered(rules, audit.match_sources(rules, files)).select(F.concat_ws(" ", "kind", "pattern").alias("subject")),
        ambiguous=audit.one_name_one_secret(obs).filter("ambiguous").select(F.col("location").alias("subject")),
        missing=audit.missing(obs.filter(F.col("at") >= LATE), same, _unseen(now)).select(F.col("location").alias("subject")),
        drift=audit.drifted(_labelled(spark, now), same).select(F.col("group_id").alias("subject"), "label", F.col("location").alias("place")),
        reused=audit.reused_places(now, _pairs(now)).select(_fp(spark).label(F.col("fp")).alias("subject"), F.col("location").alias("place")),
        stale=aged.filter(F.col("days") >= LIMIT).select(F.col("location").alias("subject"), "days", "exact"),
        account=audit.stale_accounts(view(spark, sf_dir, "shadow"), 20000, LIMIT).select(F.col("user").alias("subject"), "days"),
    )
    return _kept(audit.finding_identity(report), "report"), now


@query(f"WITH {REPORT} SELECT rank, type, subject, label, place, days, exact, identity, {LINE} AS line FROM g")
def audit_report(spark, sf_dir):
    """All kinds of findings in one table, with their identities and lines of text."""
    return audit.report_lines(_report(spark, sf_dir)[0], LIMIT)


@query(f"WITH {REPORT} SELECT type, subject, count(*) AS n_rows FROM g WHERE type IN ('ambiguous', 'reused') GROUP BY type, subject")
def findings(spark, sf_dir):
    """The findings about credentials, one row each."""
    rows = _report(spark, sf_dir)[0].filter(F.col("type").isin("ambiguous", "reused"))
    return rows.groupBy("type", "subject").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH {REPORT}, a AS (SELECT DISTINCT identity, type, subject FROM g WHERE subject NOT LIKE '%/u1%' AND (days IS NULL OR days < {LIMIT} + 500)), b AS (SELECT DISTINCT identity, type, subject FROM g WHERE subject NOT LIKE '%/u2%')
SELECT identity, type, subject, 'new' AS change FROM b WHERE identity NOT IN (SELECT identity FROM a) UNION ALL SELECT identity, type, subject, 'gone' FROM a WHERE identity NOT IN (SELECT identity FROM b)""")
def findings_changed(spark, sf_dir):
    """Between two reports of all kinds: one that doesn't know some users yet and is 10 days younger, one without others."""
    now = _report(spark, sf_dir)[0]
    before = now.filter(~F.col("subject").contains("/u1") & (F.col("days").isNull() | (F.col("days") < LIMIT + 500))).withColumn("days", F.col("days") - 10)
    reports = audit.Reports(spark, readers.scratch(spark, "reports"))
    reports.keep(audit.finding_identity(before.drop("identity")), "1")
    reports.keep(now.filter(~F.col("subject").contains("/u2")), "2")
    return reports.changed("1", "2")


@query(f"WITH {REPORT}, k AS (SELECT DISTINCT type, subject FROM g) SELECT (SELECT count(DISTINCT fp) FROM latest) AS credentials, (SELECT count(*) FROM latest) AS locations, count_if(type = 'reused')::BIGINT AS reused, count_if(type IN ('stale', 'account'))::BIGINT AS stale, count_if(type NOT IN ('reused', 'stale', 'account'))::BIGINT AS other, (SELECT count(*) FROM declared) AS declared FROM k")
def audit_summary(spark, sf_dir):
    report, now = _report(spark, sf_dir)
    return audit.audit_summary(now, report, _pairs(now))


@query(f"WITH h AS ({_count_sql('documents', 'doc_id', 'text')}) SELECT DISTINCT 'raw:' || path AS path, label FROM h")
def leaks(spark, sf_dir):
    """Raw texts and their redacted copies searched alike: only raw ones may show up."""
    needles = known.dictionary(_tokens(spark, sf_dir))
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    name = lambda df, kind: df.select(F.concat(F.lit(f"{kind}:"), F.col("path").cast("string")).alias("path"), "content")
    return known.leaks(name(files, "raw").unionByName(name(known.redact_rows(files, needles), "redacted")), needles)


@query(rf"WITH t AS ({view_sql('tags')}) SELECT push_id, sha, substr(body, instr(body, chr(10) || chr(10)) + 2) AS message FROM t WHERE kind = 'tag' AND (remote_sha IS NULL OR remote_sha <> sha)")
def outgoing_tags(spark, sf_dir):
    return commits.outgoing_tags(view(spark, sf_dir, "tags"))


@query(rf"""WITH p AS (SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS text FROM documents, LATERAL (SELECT unnest(range(len(string_split(text, chr(10))))) AS i))
SELECT doc_id AS "commit", '(commit message)' AS file, CAST(0 AS INT) AS line, 'subject of ' || doc_id AS text FROM documents
UNION ALL SELECT doc_id, 'f' || doc_id % 7, CAST(i + 5 AS INT), regexp_replace(text, '\r$', '') FROM p WHERE i = 0 OR doc_id % 2 = 0""")
def added_lines(spark, sf_dir):
    return commits.added_lines(view(spark, sf_dir, "patches"))


@query(f"WITH h AS ({_count_sql('documents', 'doc_id', 'text')}) SELECT path AS \"commit\", label FROM h")
def known_in_commits(spark, sf_dir):
    return commits.known_in_commits(view(spark, sf_dir, "patches"), known.dictionary(_tokens(spark, sf_dir)))


@query(f"WITH {CHANGES}, t AS (SELECT substr(\"commit\", 1, 3) AS repo, path, text AS t FROM changes WHERE regexp_matches(path, '{T.LICENCE_FILE}')), g AS (SELECT repo, path, {GRANT} AS \"grant\" FROM t) SELECT repo, min(path) AS path, arg_min(\"grant\", row(path, list_position([{', '.join(repr(n) for _, n in T.PATENT_GRANTS)}], \"grant\"))) AS \"grant\" FROM g WHERE \"grant\" IS NOT NULL GROUP BY repo")
def head_licence_grant(spark, sf_dir):
    files = view(spark, sf_dir, "changes").select(F.substring("commit", 1, 3).alias("repo"), "path", "text")
    return commits.head_licence_grant(files)


@query(f"WITH l AS ({view_sql('message_log')}), s AS (SELECT *, last_value(CASE WHEN regexp_matches(text, '^(commit|tag) ') THEN split_part(text, ' ', 2) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line ROWS UNBOUNDED PRECEDING) AS sha FROM l) SELECT doc, line, sha FROM s WHERE hit")
def attribute_message_hit(spark, sf_dir):
    return commits.attribute_hits(view(spark, sf_dir, "message_log"))


@query("SELECT CASE user_id % 4 WHEN 1 THEN '/etc/vigil/' || event_type ELSE '/etc/vigil' END AS file_path, count(*) AS n FROM events WHERE user_id % 4 IN (1, 3) GROUP BY 1")
def config_write_guard(spark, sf_dir):
    calls = readers.read_tool_calls(view(spark, sf_dir, "tool_calls"))
    return commands.guarded_edits(calls).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


PARTS = f"t AS ({view_sql('part_turns')}), k AS (SELECT DISTINCT conv_id, turn, 'sk-' || sha256(CAST(conv_id % 500 AS VARCHAR)) AS secret, 'conv-' || conv_id % 500 AS label FROM t WHERE role = 'user' AND contains(text, 'sk-'))"


@query(f"WITH {PARTS}, p AS (SELECT conv_id, secret, label, min(turn) AS pasted_turn FROM k GROUP BY ALL) SELECT t.conv_id, label, pasted_turn, turn AS echoed_turn FROM t JOIN p USING (conv_id) WHERE role = 'assistant' AND turn > pasted_turn AND contains(text, substr(secret, 21, 24))")
def echoed_parts(spark, sf_dir):
    """Turns that give away a part of a secret that was pasted before, in the middle or at the end of a word."""
    turns = view(spark, sf_dir, "part_turns")
    pasted = turns.filter("role = 'user'").select("conv_id", "turn", F.concat(F.lit("conv-"), (F.col("conv_id") % 500).cast("string")).alias("label"), F.nullif(F.regexp_extract("text", "(sk-[0-9a-f]{64})", 1), F.lit("")).alias("secret"))
    return repeats.echoed_parts(turns, pasted.filter("secret is not null")).drop("n_shared")


@query(f"WITH {HANDLES} SELECT conv_id, turn, name FROM h")
def secret_handles(spark, sf_dir):
    return transcripts.secret_handles(view(spark, sf_dir, "handle_turns"))


@query("WITH d AS (SELECT DISTINCT CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events) SELECT seconds, strftime(make_timestamp(seconds * 1000000), '%Y-%m-%d') AS day FROM d")
def utc_date(spark, sf_dir):
    at = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.unix_timestamp("ts").alias("seconds")).distinct()
    return at.withColumn("day", T.utc_date(F.col("seconds")))


def _stream(spark, sf_dir, table):
    """The given table, a single file or a folder of files, as a stream of its files."""
    rows = spark.read.parquet(path := f"{sf_dir}/{table}.parquet")
    if any(f.endswith(f"/{table}.parquet") for f in rows.inputFiles()):
        return spark.readStream.schema(rows.schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return spark.readStream.schema(rows.schema).parquet(path)


@query(f"""WITH {OBS}, l AS (SELECT location, fp, ats, lag(fp) OVER (PARTITION BY location ORDER BY ats, fp) AS before FROM obs),
m AS (SELECT location, max(ats) AS since, count(before) > 0 AS exact FROM l WHERE before IS NULL OR before <> fp GROUP BY location) SELECT location, arg_max(obs.fp, row(ats, obs.fp)) AS fp, any_value(since) AS since, any_value(exact) AS exact FROM obs JOIN m USING (location) GROUP BY location""")
def observe_stream(spark, sf_dir):
    """Rotation state kept by a stream of scans: the state after all that is there."""
    events = _stream(spark, sf_dir, "events")
    events.createOrReplaceTempView("vigil_events_stream")
    scans = spark.sql(VIEWS["obs"][1].format("vigil_events_stream")).select("location", _fp(spark).fp(F.col("secret")).alias("fp"), F.unix_timestamp("ts").alias("at"))
    return streams.latest_per_location(streams.run_available(streams.observe_stream(scans), readers.scratch(spark, "observe"), "update"))


#: Ends of three scans; from the second on some users are gone, those of 3 until the third, those of 7 are out of sight.
ENDS = (1704931200, 1705795200, 4102444800)
_SCAN = f"CASE WHEN ats <= {ENDS[0]} THEN 1 WHEN ats <= {ENDS[1]} THEN 2 ELSE 3 END"
_GONE = "scan = 2 AND regexp_matches(location, '/u[0-9]*[1379]/') OR scan = 3 AND regexp_matches(location, '/u[0-9]*[179]/')"


@query(f"""WITH {OBS}, o AS (SELECT * FROM (SELECT location, fp, ats, {_SCAN} AS scan FROM obs) WHERE NOT ({_GONE})), hidden AS (SELECT unnest(range(7, 100, 10)) AS u),
seen AS (SELECT DISTINCT location, scan FROM o UNION SELECT DISTINCT location, unnest([2, 3]) FROM o WHERE location IN (SELECT 'env:/srv/u' || u || '/app.env#' || e FROM hidden, (SELECT DISTINCT split_part(location, '#', 2) AS e FROM o))),
run AS (SELECT s.location, max(s.scan) AS last, CASE WHEN bool_or(s.scan = 2) OR NOT bool_or(s.scan = 3) THEN min(s.scan) ELSE 3 END AS first FROM seen s GROUP BY s.location),
alive AS (SELECT o.*, lag(fp) OVER (PARTITION BY location ORDER BY ats, fp) AS before FROM o JOIN run USING (location) WHERE last = 3 AND scan >= first),
m AS (SELECT location, max(ats) AS since, count(before) > 0 AS exact FROM alive WHERE before IS NULL OR before <> fp GROUP BY location)
SELECT location, arg_max(alive.fp, row(ats, alive.fp)) AS fp, any_value(m.since) AS since, any_value(m.exact) AS exact FROM alive JOIN m USING (location) GROUP BY location""")
def prune_stream(spark, sf_dir):
    """Three scans, each processed as it arrives; what one of them no longer sees is given up, but under the ten rules whose
    folders were out of sight. The rows are the kept state, read from the checkpoint."""
    obs = _kept(_observed(spark, sf_dir).drop("ord"), "scans")
    began = (0, ENDS[0] + 1, ENDS[1] + 1)
    away = ("^$", "/u[0-9]*[1379]/", "/u[0-9]*[179]/")
    folder = readers.scratch(spark, "pruned")
    rules = [("env", f"/srv/u{u}/*.env") for u in range(7, 100, 10)] + [("ini", f"/srv/u{u}/*.env") for u in range(9, 100, 10)]
    for first, last, gone in zip(began, ENDS, away, strict=True):
        scan = obs.filter(F.col("at").between(first, last) & ~F.col("location").rlike(gone)).select("location", "fp", "at", F.lit(None).cast("long").alias("began"), F.lit(None).cast("array<struct<kind:string,pattern:string>>").alias("unseen"))
        scan.write.mode("append").parquet(f"{folder}/in")
        spark.createDataFrame([(None, None, last, first, rules)], pruned.SCANS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        arrived = spark.readStream.schema(pruned.SCANS).parquet(f"{folder}/in")
        with pruned.rocksdb(spark):
            streams.run_available(pruned.pruned_stream(arrived, 16), f"{folder}/run", "update")
    return pruned.kept(spark, f"{folder}/run/checkpoint")


@query(f"WITH h AS ({_count_sql('documents', 'doc_id', 'text')}), n AS (SELECT path, sum(n) AS n FROM h GROUP BY path) SELECT doc_id AS path, CAST(coalesce(n, 0) AS BIGINT) AS n_redacted, CAST(strlen(text) - 18 * coalesce(n, 0) AS BIGINT) AS n_bytes FROM documents LEFT JOIN n ON path = doc_id")
def redact_appended(spark, sf_dir):
    """Documents as they arrive, redacted on the way."""
    rows = _stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    out = streams.run_redacted(rows, known.dictionary(_tokens(spark, sf_dir)), readers.scratch(spark, "redact"))
    return out.select("path", "n_redacted", F.length("content").cast("long").alias("n_bytes"))
