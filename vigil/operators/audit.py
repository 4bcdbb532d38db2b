"""The audit: which credentials are reused, old, drifted, missing or ambiguous. Inputs carry fingerprints only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

DAY = 86400


def one_name_one_secret(found: DataFrame) -> DataFrame:
    """found (location, fp, ord) -> per location the first fp, and whether a later one differs (ambiguous)."""
    return found.groupBy("location").agg(F.min_by("fp", F.struct("ord", "fp")).alias("fp"), (F.count_distinct("fp") > 1).alias("ambiguous"))


def observe(state: DataFrame, now: DataFrame, at) -> DataFrame:
    """state (location, fp, since, exact) and what is seen at `at` (location, fp): an equal fp keeps its date, a changed
    one dates from now exactly, a new location from now as an upper bound."""
    old = state.select("location", F.col("fp").alias("old_fp"), "since", "exact")
    same, new = F.col("old_fp") == F.col("fp"), F.col("old_fp").isNull()
    return now.select("location", "fp").join(old, "location", "left").select(
        "location", "fp", F.when(same, F.col("since")).otherwise(at).alias("since"), F.when(new, F.lit(False)).when(same, F.col("exact")).otherwise(F.lit(True)).alias("exact")
    )


def prune_state(state: DataFrame, present: DataFrame, unseen: DataFrame) -> DataFrame:
    """Keep a location that is present, or that lies under a rule of `unseen` (ord, kind, pattern), which matched no file in a
    folder that could not be looked at: of the rule's kind, in a file that its pattern names."""
    here = state.join(present.select("location").distinct(), "location", "left_semi")
    away = state.join(present.select("location"), "location", "left_anti")
    return here.unionByName(under_unseen(away, unseen).select(*state.columns))


def credential_age(state: DataFrame, now) -> DataFrame:
    """Days since the change if it is exact, else the larger of that and the age of the file; never below 0."""
    known = F.greatest(F.floor((now - F.col("since")) / DAY), F.lit(0))
    by_file = F.greatest(F.floor((now - F.col("mtime")) / DAY), F.lit(0))
    return state.withColumn("days", F.when(F.col("exact"), known).otherwise(F.greatest(known, F.coalesce(by_file, F.lit(0)))).cast("long"))


def copies(found: DataFrame) -> DataFrame:
    """(fp, n_locations) of fingerprints in more than one location. Only counts are gathered, so a default password in very
    many locations is one row per map task."""
    return found.select("fp", "location").distinct().groupBy("fp").agg(F.count(F.lit(1)).alias("n_locations")).filter("n_locations > 1")


def reused(found: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(fp, n_locations, first_location) of fingerprints in more than one location, but those that are declared: wholly
    inside one `same` group (group_id, location). `reused_places` lists all locations."""
    each = found.select("fp", "location").distinct()
    out = each.groupBy("fp").agg(F.count(F.lit(1)).alias("n_locations"), F.min("location").alias("first_location")).filter("n_locations > 1")
    return out if same is None else out.join(declared(found, same).select("fp"), "fp", "left_anti")


def reused_places(found: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(fp, location): a row for each place of a reused credential, so that none of any number is left out."""
    return found.select("fp", "location").distinct().join(reused(found, same).select("fp"), "fp", "left_semi")


def declared(found: DataFrame, same: DataFrame) -> DataFrame:
    """Fingerprints all of whose locations lie in one `same` group (relational division): (fp, group_id)."""
    each = found.select("fp", "location").distinct()
    size = each.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    inside = each.join(same.select("group_id", "location").distinct(), "location").groupBy("fp", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return inside.join(size, ["fp", "n"]).groupBy("fp").agg(F.min("group_id").alias("group_id"))


def drifted(found: DataFrame, same: DataFrame) -> DataFrame:
    """`same` groups whose present copies have different labels: (group_id, label, location), a row for each copy. found has
    label and location."""
    each = same.select("group_id", "location").distinct().join(found.select("label", "location").distinct(), "location")
    apart = each.groupBy("group_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("group_id")
    return each.join(apart, "group_id").select("group_id", "label", "location")


def under_unseen(locations: DataFrame, unseen: DataFrame) -> DataFrame:
    """The rows of `locations` (location, ...) that lie under a rule of `unseen` (ord, kind, pattern), which matched no file
    and whose folder could not be looked at."""
    placed = locations.select("location").distinct().select("location", T.location_kind(F.col("location")).alias("k"), T.location_path(F.col("location")).alias("path"))
    named = match_sources(unseen, placed.select("path").distinct()).select("kind", "path").distinct()
    inside = placed.join(named, (F.col("k") == F.col("kind")) & (placed["path"] == named["path"])).select("location")
    return locations.join(inside, "location", "left_semi")


def missing(found: DataFrame, same: DataFrame, unseen: DataFrame | None = None) -> DataFrame:
    """(group_id, location): declared places without a credential, but those under a source that could not be looked at."""
    gone = same.select("group_id", "location").distinct().join(found.select("location").distinct(), "location", "left_anti").select("group_id", "location")
    return gone if unseen is None else gone.join(under_unseen(gone, unseen).select("location").distinct(), "location", "left_anti").select("group_id", "location")


def rotations(found: DataFrame) -> DataFrame:
    """found (location, fp, ts) -> a row per change of fingerprint: (location, ts, fp, before)."""
    w = W.partitionBy("location").orderBy("ts", "fp")
    return found.withColumn("before", F.lag("fp").over(w)).filter("before is not null and before <> fp").select("location", "ts", "fp", "before")


def match_sources(rules: DataFrame, files: DataFrame) -> DataFrame:
    """rules (ord, kind, pattern) with one * in the last component, files (path): an equi-join on the folder, then prefix
    and suffix of the name."""
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    star = F.contains(base("pattern"), F.lit("*"))
    r = rules.select("ord", "kind", "pattern", folder("pattern").alias("folder"), star.alias("star"), F.substring_index(base("pattern"), "*", 1).alias("pre"), F.when(star, F.substring_index(base("pattern"), "*", -1)).otherwise("").alias("post"))
    f = files.select("path", folder("path").alias("folder"), base("path").alias("name"))
    fits = F.when(F.col("star"), F.col("name").startswith(F.col("pre")) & F.col("name").endswith(F.col("post")) & (F.length("name") >= F.length("pre") + F.length("post"))).otherwise(F.col("name") == F.col("pre"))
    return r.join(f, "folder").filter(fits).select("ord", "kind", "pattern", "path")


def uncovered(rules: DataFrame, matched: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Rules that match no file; with `folders` (path) of the folders that are listable and not empty, also `could_look`:
    whether the rule's folder is one of them, so that files are gone rather than out of sight."""
    out = rules.join(matched.select("ord").distinct(), "ord", "left_anti")
    if folders is None:
        return out
    seen = folders.select(F.col("path").alias("folder")).distinct().withColumn("seen", F.lit(True))
    return out.withColumn("folder", F.regexp_extract("pattern", r"^(.*)/[^/]*$", 1)).join(seen, "folder", "left").withColumn("could_look", F.coalesce("seen", F.lit(False))).drop("folder", "seen")


def coverage(matched: DataFrame, found: DataFrame, accounts: tuple[int, DataFrame] | None = None) -> DataFrame:
    """matched (ord, path), found (ord, path, location) -> per rule: files, secrets, and the names of its files without a
    secret. A location counts for the first rule that reaches it; a file is empty for a rule only if nothing is in it.
    accounts: number and rows (value) of the accounts' file, one file whose secrets are the accounts with a password. Where it
    can't be read, leave it out and report `unreadable`."""
    first = found.groupBy("location").agg(F.min("ord").alias("ord")).groupBy("ord").agg(F.count(F.lit(1)).alias("secrets"))
    full = found.select("ord", "path").distinct().withColumn("full", F.lit(True))
    files = matched.select("ord", "path").distinct().join(full, ["ord", "path"], "left")
    each = files.groupBy("ord").agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_list(F.when(F.col("full").isNull(), F.regexp_extract("path", r"([^/]*)$", 1)))).alias("empty"))
    rows = each.join(first, "ord", "left").select("ord", "files", F.coalesce("secrets", F.lit(0)).alias("secrets"), F.array_join("empty", ", ").alias("none_in"))
    if accounts is None:
        return rows
    kind = rows.schema["ord"].dataType
    return rows.unionByName(read_shadow(accounts[1]).agg(F.count(F.lit(1)).alias("secrets")).select(F.lit(accounts[0]).cast(kind).alias("ord"), F.lit(1).cast("long").alias("files"), "secrets", F.lit("").alias("none_in")))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(subject) of the finding that an accounts' file can't be read: a blind spot, not a clean bill. It joins the uncovered
    sources."""
    return spark.createDataFrame([(f"shadow {path}",)], "subject string")




def read_shadow(shadow: DataFrame) -> DataFrame:
    """shadow (value) -> (user, changed) of the accounts with a password: a hash that starts with $. The hash goes no further;
    a date that is no number, or 0, is null."""
    part = F.split("value", ":", 4)
    changed = F.expr("try_cast(split(value, ':', 4)[2] as bigint)")
    return shadow.filter((F.size(part) >= 3) & part[1].startswith("$")).select(part[0].alias("user"), F.when(changed > 0, changed).alias("changed"))


def stale_accounts(shadow: DataFrame, today: int, limit: int) -> DataFrame:
    """shadow (value) -> (user, days) of accounts whose password is unchanged for `limit` days."""
    days = F.greatest(F.lit(today) - F.col("changed"), F.lit(0))
    return read_shadow(shadow).filter(days >= limit).select("user", days.cast("long").alias("days"))


def shared_labels(found: DataFrame) -> DataFrame:
    """found (fp, label) -> labels that stand for several fingerprints. Labels have 24 bits: join on fp, show labels."""
    return found.select("fp", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n_fps")).filter("n_fps > 1")


def search_gate(rules: DataFrame, matched: DataFrame) -> DataFrame:
    """One row (n_rules, n_uncovered, allowed): a search must not run while a rule matches no file, because its
    credentials would be missing from the dictionary."""
    seen = rules.select("ord").join(matched.select("ord").distinct().withColumn("seen", F.lit(1)), "ord", "left")
    return seen.agg(F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col("seen").isNull()).alias("n_uncovered")).withColumn("allowed", F.col("n_uncovered") == 0)


def require_covered(rules: DataFrame, matched: DataFrame) -> None:
    gate = search_gate(rules, matched).first()
    if not gate.allowed:
        raise ValueError(f"{gate.n_uncovered} of {gate.n_rules} sources match no file")


#: The kinds of findings in the order of the report.
FINDINGS = ("uncovered", "ambiguous", "missing", "drift", "reused", "stale", "account")


def findings(**parts: DataFrame) -> DataFrame:
    """Findings by kind, each (subject) and, where it has them, label, place, days and exact -> one table (rank, type,
    subject, label, place, days, exact). A finding of several places has a row for each. Subjects are places or labels, never
    fingerprints."""
    out = None
    for rank, kind in enumerate(FINDINGS):
        if kind not in parts:
            continue
        has = parts[kind].columns
        pick = lambda name, t: (F.col(name) if name in has else F.lit(None)).cast(t).alias(name)  # noqa: B023, E731
        rows = parts[kind].select(F.lit(rank).alias("rank"), F.lit(kind).alias("type"), F.col("subject").cast("string").alias("subject"), pick("label", "string"), pick("place", "string"), pick("days", "long"), pick("exact", "boolean"))
        out = rows if out is None else out.unionByName(rows)
    return out


def finding_identity(rows: DataFrame) -> DataFrame:
    """Adds `identity`: all of a finding's row but its age, so that a finding which only grows older is the same one."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return rows.withColumn("identity", F.sha2(F.concat_ws("\t", "type", "subject", part("label"), part("place"), part("exact")), 256))


def findings_changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """Two tables with identities -> (identity, type, subject, change) of what is new or gone; no rows: nobody is told."""
    a, b = before.select("identity", "type", "subject").distinct(), now.select("identity", "type", "subject").distinct()
    return b.join(a, "identity", "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, "identity", "left_anti").withColumn("change", F.lit("gone")))


def digests(report: DataFrame) -> DataFrame:
    """report (type, identity, ...) -> (type, n, one, two): per kind the number of distinct identities and two sums over their
    hashes, which no order changes. Reports with equal rows here hold the same findings."""
    part = lambda first: F.conv(F.substring("identity", first, 15), 16, 10).cast("decimal(20,0)")
    each = report.select("type", "identity").distinct()
    return each.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).cast("decimal(38,0)").alias("one"), F.sum(part(16)).cast("decimal(38,0)").alias("two"))


class Reports:
    """Reports of scans in a folder, each beside its digests. A report is complete once its digests are there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def keep(self, report: DataFrame, scan_id: str) -> None:
        report.write.mode("overwrite").parquet(f"{self.folder}/report/{scan_id}")
        whole = self.spark.read.schema(report.schema).parquet(f"{self.folder}/report/{scan_id}")
        digests(whole).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/digests/{scan_id}")

    def changed_kinds(self, before: str, now: str) -> list[str]:
        """The kinds whose digests differ: a few rows of each scan are all that is read."""
        rows = [{tuple(r) for r in self.spark.read.parquet(f"{self.folder}/digests/{scan}").select("type", "n", "one", "two").collect()} for scan in (before, now)]
        return sorted({r[0] for r in rows[0] ^ rows[1]})

    def changed(self, before: str, now: str) -> DataFrame:
        """As `findings_changed`; only kinds whose digests differ are joined, and none if nothing has changed."""
        kinds = self.changed_kinds(before, now)
        a, b = (self.spark.read.parquet(f"{self.folder}/report/{scan}").filter(F.col("type").isin(kinds) if kinds else F.lit(False)) for scan in (before, now))
        return findings_changed(a, b)


def audit_summary(found: DataFrame, report: DataFrame, same: DataFrame) -> DataFrame:
    """One row: credentials, locations, and how many findings are reused, stale, of other kinds, and how many reuses are
    declared. Accounts count as stale."""
    one = found.agg(F.count_distinct("fp").alias("credentials"), F.count_distinct("location").alias("locations"))
    each = report.select("type", "subject").distinct()
    kinds = each.agg(F.count_if(F.col("type") == "reused").alias("reused"), F.count_if(F.col("type").isin("stale", "account")).alias("stale"), F.count_if(~F.col("type").isin("reused", "stale", "account")).alias("other"))
    return one.crossJoin(kinds).crossJoin(declared(found, same).agg(F.count(F.lit(1)).alias("declared")))


def report_lines(rows: DataFrame, limit: int) -> DataFrame:
    """Adds `line`, one line of text per row."""
    s, label, place, days = F.col("subject"), F.col("label"), F.col("place"), F.col("days")
    text = {
        "uncovered": F.format_string("no file matches %s", s),
        "ambiguous": F.format_string("several secrets under the name %s", s),
        "missing": F.format_string("no credential at the declared place %s", s),
        "drift": F.format_string("copies of group %s differ: %s at %s", s, label, place),
        "reused": F.format_string("%s is in several places: %s", s, place),
        "stale": F.when(F.col("exact"), F.format_string("%s rotated %d days ago (limit %d)", s, days, F.lit(limit))).otherwise(F.format_string("%s unchanged for %d days or more (limit %d)", s, days, F.lit(limit))),
        "account": F.format_string("account %s: password of %d days (limit %d)", s, days, F.lit(limit)),
    }
    line = F
    for kind in FINDINGS:
        line = line.when(F.col("type") == kind, text[kind])
    return rows.withColumn("line", line)
