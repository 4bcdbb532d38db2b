"""Screening of outgoing commits: a table of pushes, commits, changed files and added lines against rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import history, known
from .rules import rule_hits
from .scan import running


def classify_destination(pushes: DataFrame, visibility: DataFrame, declared_public: tuple[str, ...] = ()) -> DataFrame:
    """pushes (push_id, url), visibility (slug, visibility) -> slug and visibility. Any url that holds github.com and then :
    or / is looked up, and null where it isn't found; a path on this machine is private unless it is declared public; other
    hosts are public."""
    hosted, local = F.col("url").rlike(r"github\.com[:/]"), F.col("url").rlike(r"^(/|file://|\./|\.\./|~)")
    slug = F.lower(F.regexp_replace(F.regexp_replace("url", r"^.*github\.com[:/]+", ""), r"(\.git)?/*$", ""))
    rows = pushes.select("push_id", "url", F.when(hosted, slug).otherwise(F.col("url")).alias("slug"), hosted.alias("hosted"), local.alias("local"))
    known = rows.join(visibility, "slug", "left")
    here = F.when(F.col("url").isin(*declared_public) if declared_public else F.lit(False), "public").otherwise("private")
    return known.select("push_id", "slug", F.when(F.col("hosted"), F.col("visibility")).when(F.col("local"), here).otherwise("public").alias("visibility"))


def public_not_allowed(placed: DataFrame, allow: DataFrame) -> DataFrame:
    return placed.filter("visibility = 'public'").join(allow.select(F.lower("repo").alias("slug")), "slug", "left_anti").select("push_id", "slug")


def outgoing_commits(edges: DataFrame | history.CommitIndex, tips: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """edges (sha, parent), or an index of them; tips (push_id, sha, remote_sha), refs (remote, sha) with a column remote in
    tips -> (push_id, sha) of the commits that leave with a push; see `history.outgoing`."""
    return history.outgoing(edges, tips, refs)


def added_lines(patches: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """patches (commit, patch), tags (sha, message) as `outgoing_tags` gives them -> (commit, file, line, text) of added lines
    and of the lines of messages, in patch order. The file that a line belongs to is a blocked scan, so a huge patch is spread
    over tasks."""
    rows = patches.select("commit", F.posexplode(F.split("patch", "\r?\n")).alias("line", "t"))
    diff = F.when(F.col("t").startswith("diff --git "), 1)
    file = F.when(F.col("t").startswith("+++ "), F.regexp_replace(F.expr("substring(t, 5)"), "^b/", ""))
    rows = running(rows, ["commit"], "line", ["line"], diff=("max", diff), file=("last", file))
    message = rows.filter("diff is null").select("commit", F.lit("(commit message)").alias("file"), "line", F.col("t").alias("text"))
    added = rows.filter(F.col("diff").isNotNull() & F.col("t").startswith("+") & ~F.col("t").startswith("+++ ")).select("commit", "file", "line", F.expr("substring(t, 2)").alias("text"))
    lines = message.unionByName(added)
    if tags is None:
        return lines
    said = tags.select(F.col("sha").alias("commit"), F.lit("(tag message)").alias("file"), F.posexplode(F.split("message", "\r?\n")).alias("line", "text"))
    return lines.unionByName(said.select(F.col("commit").cast(rows.schema["commit"].dataType), "file", "line", "text"))


def scannable_commits(changes: DataFrame) -> DataFrame:
    """changes (commit, path, status, is_binary, n_hunks) -> commits with a file that a scanner can read."""
    ok = (F.col("status") != "D") & ~F.col("is_binary") & (F.col("n_hunks") > 0)
    return changes.groupBy("commit").agg(F.max(ok.cast("int")).alias("ok")).filter("ok = 1").select("commit")


def unscanned(expected: DataFrame, scanned: DataFrame) -> DataFrame:
    """Expected commits that the scan does not report; any row refuses the push."""
    return expected.join(scanned.select("commit").distinct(), "commit", "left_anti")


def credential_files_added(changes: DataFrame) -> DataFrame:
    new = changes.filter(F.col("status").isin("A", "R"))
    return new.filter(F.col("path").rlike(T.CREDENTIAL_FILE) & ~F.col("path").rlike(T.HARMLESS_FILE)).select("commit", "path").distinct()


def licence_changes(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """Added, changed or renamed licence files whose added lines carry a patent grant: (path, grant). A grant is a matter
    of single lines, so no file's text is put together again."""
    files = changes.filter(F.col("status").isin("A", "M", "R") & F.col("path").rlike(T.LICENCE_FILE)).select("commit", F.col("path").alias("file")).distinct()
    ranked = lines.select("commit", "file", T.patent_grant_rank(F.col("text")).alias("rank")).filter("rank is not null")
    best = ranked.join(files, ["commit", "file"], "left_semi").groupBy("file").agg(F.min("rank").alias("rank"))
    return best.select(F.col("file").alias("path"), T.patent_grant_name(F.col("rank")).alias("grant"))


def head_licence_grant(files: DataFrame) -> DataFrame:
    """files (repo, path, text) at the head -> per repository the first licence file, by path, that carries a grant."""
    rows = files.filter(F.col("path").rlike(T.LICENCE_FILE)).select("repo", F.struct("path", T.patent_grant_rank(F.col("text")).alias("rank")).alias("at")).filter("at.rank is not null")
    return rows.groupBy("repo").agg(F.min("at").alias("at")).select("repo", "at.path", T.patent_grant_name(F.col("at.rank")).alias("grant"))


def outgoing_tags(tags: DataFrame) -> DataFrame:
    """tags (push_id, sha, remote_sha, kind, body) -> annotated tags that the push changes: (push_id, sha, message). The
    message is what follows the first blank line; deletions have a sha of zeros."""
    changed = (F.col("kind") == "tag") & ~F.col("sha").eqNullSafe(F.col("remote_sha")) & ~F.col("sha").rlike("^0+$")
    return tags.filter(changed).select("push_id", "sha", F.regexp_extract("body", r"(?s)^.*?\n\n(.*)$", 1).alias("message"))


def known_in_commits(patches: DataFrame, needles: DataFrame) -> DataFrame:
    """patches (commit, patch), messages included -> (commit, label) of the known credentials in them."""
    hits = known.find_known(patches.select(F.col("commit").alias("path"), F.col("patch").alias("content")), needles)
    return hits.select(F.col("path").alias("commit"), "label").distinct()


def denylist_hits(lines: DataFrame, rules: list[tuple[str, str]], allowed: DataFrame | None = None, first: int = 50, shown: int = 5, public: DataFrame | None = None) -> DataFrame:
    """lines (repo, commit, file, line, text) -> per repository and label the number of matching lines and up to five
    distinct places among the first fifty. allowed (repo, label): labels that a repository may have. public (repo): the
    repositories whose lines are held against the list, all if it isn't given; `added_lines` has those of tags too.

    The first fifty are taken by salted row numbers, which Spark limits before the shuffle, and then by label, so a label
    with very many lines is never sorted or gathered as a whole."""
    if public is not None:
        lines = lines.join(public.select("repo").distinct(), "repo", "left_semi")
    hits = rule_hits(lines, rules)
    if allowed is not None:
        hits = hits.join(allowed.select("repo", "label").distinct(), ["repo", "label"], "left_anti")
    totals = hits.groupBy("repo", "label").agg(F.count(F.lit(1)).alias("n_lines"))
    by = lambda *keys: F.row_number().over(W.partitionBy("repo", "label", *keys).orderBy("commit", "file", "line"))
    top = hits.select("repo", "label", "commit", "file", "line", F.pmod(F.xxhash64("commit", "file", "line"), F.lit(64)).alias("salt"))
    top = top.withColumn("nth", by("salt")).filter(F.col("nth") <= first).withColumn("nth", by()).filter(F.col("nth") <= first)
    places = F.slice(F.array_sort(F.collect_set(F.concat_ws(" ", "commit", "file"))), 1, shown)
    return totals.join(top.groupBy("repo", "label").agg(F.array_join(places, ";").alias("places")), ["repo", "label"])


def pattern_secrets(lines: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """lines (commit, file, text) -> distinct (rule, file, commit) of the lines that a rule matches."""
    return rule_hits(lines, rules).select(F.col("label").alias("rule"), "file", "commit").distinct()


def attribute_hits(lines: DataFrame) -> DataFrame:
    """lines (doc, line, text, hit) -> hits with the nearest `commit|tag <sha>` header above (as-of), by a blocked scan."""
    head = F.when(F.col("text").rlike("^(commit|tag) [0-9a-f]+"), F.regexp_extract("text", "^(?:commit|tag) ([0-9a-f]+)", 1))
    # The text ends here: what is scanned is a header or nothing.
    rows = lines.select("doc", "line", "hit", head.alias("head")).filter("hit or head is not null")
    return running(rows, ["doc"], "line", ["line"], sha=("last", F.col("head"))).filter("hit").select("doc", "line", "sha")


def push_verdict(pushes: DataFrame, problems: DataFrame, evidence: DataFrame) -> DataFrame:
    """pushes (push_id), problems (push_id, reason), evidence (push_id) -> refused with all reasons; a push without
    evidence is refused too."""
    why = problems.groupBy("push_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
    rows = pushes.select("push_id").join(why, "push_id", "left").join(evidence.select("push_id").distinct().withColumn("seen", F.lit(True)), "push_id", "left")
    reasons = F.concat_ws("; ", F.when(F.col("seen").isNull(), F.lit("not scanned")), F.col("reasons"))
    return rows.select("push_id", F.when(reasons == "", "ok").otherwise("refused").alias("verdict"), reasons.alias("reasons"))
