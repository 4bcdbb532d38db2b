"""An index of a commit graph, and which commits a push sends that its remote doesn't have.

The first parents of all commits are a forest. It falls into chains: each commit goes on to the child with the most commits
below it. What a commit reaches on a chain is all of the chain up to some place, so a set of commits that is closed under
parents is one number per chain, however long the chain is. Parents that lie on another chain are the crossings of the graph.

Building takes a number of steps that grows with the logarithm of the longest chain, and each step writes a row per commit at
most; a table is deleted once the next one is there. A question is answered on chains and crossings alone: from the pushed commits down, only above what the remote has,
and from the remote's refs down, only as far back as the question goes. The commits themselves are read for the answer only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import scratch
from .scan import running

#: Places of a chain that one row of a join covers.
STEP = 64
#: Spark then deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: it cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _drop(*tables: DataFrame) -> None:
    """Deletes the folders of tables that `_stored` gave, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _tree_sizes(tree: DataFrame) -> DataFrame:
    """tree (sha, up) -> (sha, size): commits from which each one is reached by first parents. After the k-th step a size
    counts those nearer than 2^k, and `far` is the ancestor at 2^k; those who name it add what they have counted so far."""
    state, last = tree.select("sha", F.lit(1).cast("long").alias("size"), F.col("up").alias("far")), []
    while not state.filter("far is not null").isEmpty():
        more = state.filter("far is not null").groupBy(F.col("far").alias("sha")).agg(F.sum("size").alias("more"))
        further = state.filter("far is not null").select(F.col("sha").alias("far"), F.col("far").alias("further"))
        state = state.join(more, "sha", "left").join(further, "far", "left").select("sha", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.col("further").alias("far"))
        state = _stored(state, "sizes")
        _drop(*last)
        last = [state]
    return state.select("sha", "size")


def _chains(tree: DataFrame) -> DataFrame:
    """tree (sha, up) -> (sha, chain, pos): a chain is named by its first commit, which has place 0. Links are followed by
    doubling."""
    sizes = _tree_sizes(tree)
    heir = tree.filter("up is not null").join(sizes, "sha").groupBy("up").agg(F.max(F.struct("size", "sha")).alias("heir")).select(F.col("heir.sha").alias("sha"), F.col("up").alias("to"))
    state = tree.select("sha").join(heir, "sha", "left").select("sha", F.coalesce("to", "sha").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("to").isNull().alias("ended"))
    last = [sizes] if sizes.inputFiles() != tree.inputFiles() else []
    while True:
        state = _stored(state, "chains")
        _drop(*last)
        last = [state]
        if state.filter("not ended").isEmpty():
            return state.select("sha", F.col("to").alias("chain"), F.col("steps").alias("pos"))
        ahead = state.select(F.col("sha").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"), F.col("ended").alias("end"))
        going = state.filter("not ended").join(ahead, "to").select("sha", F.col("then").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("ended"))
        state = state.filter("ended").unionByName(going)


class CommitIndex:
    """commits (sha, chain, pos, level) and crossings (chain, pos, to_chain, to_pos, to_level).

    level: the highest place on a chain that starts at a root among all that a commit reaches. Ancestors never have a higher
    one, so what reaches a commit can be looked for at its level and above only."""

    def __init__(self, edges: DataFrame):
        """edges (sha, parent), and nth if the order of a commit's parents is known; else the least parent counts as its
        first. A null parent is none. Repeated rows count once."""
        nth = F.col("nth") if "nth" in edges.columns else F.lit(0)
        edges = _stored(edges.filter("sha is not null").select("sha", "parent", nth.alias("nth")), "edges")
        real = edges.filter("parent is not null")
        named = edges.select("sha", F.when(F.col("parent").isNotNull(), F.struct("nth", "parent")).alias("up"))
        named = named.unionByName(real.select(F.col("parent").alias("sha"), F.lit(None).cast(named.schema["up"].dataType).alias("up")))
        tree = _stored(named.groupBy("sha").agg(F.min("up").alias("up")).select("sha", F.col("up.parent").alias("up")), "tree")
        chains = _chains(tree)
        placed = _stored(chains.join(tree, "sha"), "placed")
        _drop(chains, tree)
        at = lambda name, *more: placed.select(F.col("sha").alias(name), F.col("chain").alias(f"{name}_chain"), F.col("pos").alias(f"{name}_pos"), *more)
        # Above its first place a chain goes on from the first parent.
        links = real.select("sha", "parent").join(at("sha", "up"), "sha").filter("not (sha_pos > 0 and parent = up)").join(at("parent"), "parent")
        links = links.select(F.col("sha_chain").alias("chain"), F.col("sha_pos").alias("pos"), F.col("parent_chain").alias("to_chain"), F.col("parent_pos").alias("to_pos")).distinct()
        links = _stored(links, "links")
        _drop(edges)
        self._levels(placed, links)
        _drop(placed)

    def _levels(self, placed: DataFrame, given: DataFrame) -> None:
        """Levels spread along crossings until no crossing raises its chain; the longest row of chains that bring each other
        something new bounds the rounds. What a chain gets from crossings is a blocked scan along it."""
        roots = placed.filter("up is null and pos = 0").select("chain", F.lit(True).alias("root"))
        links = given.join(roots, "chain", "left").join(roots.select(F.col("chain").alias("to_chain"), F.col("root").alias("to_root")), "to_chain", "left")
        own = F.when(F.col("to_root"), F.col("to_pos")).otherwise(F.lit(-1)).cast("long")
        links = _stored(links.select("chain", "pos", "to_chain", "to_pos", F.coalesce("root", F.lit(False)).alias("root"), own.alias("least"), own.alias("to_level")), "links")
        _drop(given)
        while True:
            gives = links.filter("to_level > if(root, pos, -1)").select("chain", "pos", F.lit(0).alias("asks"), F.col("to_level").alias("gives"), *[F.lit(None).cast(links.schema[c].dataType).alias(f"from_{c}") for c in ("chain", "pos")])
            asks = links.select(F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("gives"), F.col("chain").alias("from_chain"), F.col("pos").alias("from_pos")).distinct()
            heard = running(gives.unionByName(asks), ["chain"], "pos", ["pos", "asks"], level=("max", F.col("gives"))).filter("asks = 1")
            heard = heard.select(F.col("from_chain").alias("chain"), F.col("from_pos").alias("pos"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"), "level")
            raised = F.greatest("least", F.coalesce("level", F.lit(-1)), "to_level")
            after = _stored(links.join(heard, ["chain", "pos", "to_chain", "to_pos"], "left").select("chain", "pos", "to_chain", "to_pos", "root", "least", raised.alias("to_level"), (raised > F.col("to_level")).alias("moved")), "links")
            _drop(links)
            links, moved = after.drop("moved"), not after.filter("moved").isEmpty()
            if not moved:
                break
        self.crossings = links.select("chain", "pos", "to_chain", "to_pos", "to_level", F.floor(F.col("pos") / STEP).alias("near"), F.floor(F.col("to_level") / STEP).alias("deep"))
        # A commit comes after what it hears itself; `root` is heard from the first place on.
        gives = links.groupBy("chain", "pos").agg(F.max("to_level").alias("gives")).withColumns({"sha": F.lit(None).cast(placed.schema["sha"].dataType), "last": F.lit(0), "first": F.lit(False)})
        rows = placed.select("sha", "chain", "pos", F.lit(None).cast("long").alias("gives"), F.lit(1).alias("last"), (F.col("up").isNull() & (F.col("pos") == 0)).alias("first"))
        rows = running(rows.unionByName(gives), ["chain"], "pos", ["pos", "last"], heard=("max", F.col("gives")), root=("max", F.col("first"))).filter("last = 1")
        self.commits = _stored(rows.select("sha", "chain", "pos", F.greatest(F.when(F.col("root"), F.col("pos")), F.coalesce("heard", F.lit(-1))).alias("level")), "commits")

    def places(self, shas: DataFrame) -> DataFrame:
        """(…, sha) with chain, pos and level. A commit that the graph doesn't hold is a chain of its own."""
        at = shas.join(self.commits, "sha", "left")
        return at.withColumns({"chain": F.coalesce("chain", "sha"), "pos": F.coalesce("pos", F.lit(0)).cast("long"), "level": F.coalesce("level", F.lit(-1)).cast("long")})

    def between(self, above: DataFrame, below: DataFrame) -> DataFrame:
        """above (push, set, sha), below (set, sha) -> (push, sha): what a push's commits reach and its set's don't.

        Sets are spread first, down to the lowest level that the pushes' open parts of chains begin at; then pushes take one
        step over the crossings of what is newly open. Parts only end, and never begin, further down, so both come to rest."""
        own = self._top(self.places(above).select("push", "set", "chain", "pos", "level"), ["push", "set", "chain"], "own")
        cut = self._top(self.places(below).select("set", "chain", "pos", "level"), ["set", "chain"], "cut")
        while True:
            bounds = self._open(own, cut).groupBy("set").agg(F.min("bottom").alias("bound"))
            bounds = _stored(bounds.filter("bound is not null"), "bounds")
            grown = cut  # the bounds may lie lower than before, so all of a set is spread again
            while True:
                more, last = self._spread(grown, bounds), cut
                cut = self._top(cut, ["set", "chain"], "cut", more)
                _drop(last)
                grown = cut.filter("fresh")
                if grown.isEmpty():
                    break
            open_, last = _stored(self._open(own, cut), "open"), own
            own = self._top(own, ["push", "set", "chain"], "own", self._crossed(open_.filter("fresh")))
            _drop(bounds, last)
            if own.filter("fresh").isEmpty():
                break
            _drop(open_)
        _drop(own, cut)
        # Commits of an open part, and those that the graph doesn't hold.
        every = open_.select("push", "chain", F.explode(F.sequence("low", "pos")).alias("pos"))
        alone = open_.filter("bottom is null").select("push", F.col("chain").alias("sha"))
        return every.join(self.commits.select("sha", "chain", "pos"), ["chain", "pos"]).select("push", "sha").unionByName(alone)

    @staticmethod
    def _top(rows: DataFrame, keys: list[str], name: str, more: DataFrame | None = None) -> DataFrame:
        """By key the highest place and its level; `fresh` where `more` has raised it, or for all rows if there is no `more`, and
        `old` the place before."""
        columns = [*keys, "pos", "level"]
        both = rows.select(*columns, F.lit(None).cast("long").alias("old"))
        if more is not None:
            both = rows.select(*columns, F.col("pos").alias("old")).unionByName(more.select(*columns, F.lit(None).cast("long").alias("old")))
        at = both.groupBy(*keys).agg(F.max(F.struct("pos", "level")).alias("at"), F.max("old").alias("old"))
        return _stored(at.select(*keys, "at.pos", "at.level", "old", F.coalesce(F.col("at.pos") > F.col("old"), F.lit(True)).alias("fresh")), name)

    def _open(self, own: DataFrame, cut: DataFrame) -> DataFrame:
        """(push, set, chain, low, pos, new, fresh, bottom): the parts of chains that pushes reach and their sets don't, as far as
        is known; where what is new in a fresh one begins; and the level of the lowest commit, null where the graph doesn't
        hold it."""
        rows = own.join(cut.select("set", "chain", F.col("pos").alias("had")), ["set", "chain"], "left")
        rows = rows.withColumn("low", F.coalesce("had", F.lit(-1)) + 1).filter("low <= pos")
        rows = rows.select("push", "set", "chain", "low", "pos", F.greatest("low", F.coalesce("old", F.lit(-1)) + 1).alias("new"), "fresh")
        lowest = self.commits.select("chain", F.col("pos").alias("low"), F.col("level").alias("bottom"))
        return rows.join(lowest, ["chain", "low"], "left")

    def _spread(self, cut: DataFrame, bounds: DataFrame) -> DataFrame:
        """What sets reach over crossings to commits at their bounds or above."""
        rows = cut.join(bounds, "set").filter("level >= bound")
        floor = lambda c: F.floor(F.col(c) / STEP)
        rows = rows.select("set", "chain", F.col("pos").alias("top"), "bound", F.explode(F.sequence(floor("bound"), floor("level"))).alias("deep"))
        hit = rows.join(self.crossings, ["chain", "deep"]).filter("pos <= top and to_level >= bound")
        return hit.select("set", F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), F.col("to_level").alias("level"))

    def _crossed(self, open_: DataFrame) -> DataFrame:
        floor = lambda c: F.floor(F.col(c) / STEP)
        rows = open_.select("push", "set", "chain", "new", F.col("pos").alias("top"), F.explode(F.sequence(floor("new"), floor("pos"))).alias("near"))
        hit = rows.join(self.crossings, ["chain", "near"]).filter("pos between new and top")
        return hit.select("push", "set", F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), F.col("to_level").alias("level"))


def outgoing(edges: DataFrame | CommitIndex, tips: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """tips (push_id, sha, remote_sha, and remote if `refs` is given), refs (remote, sha) -> (push_id, sha).

    A push sends what its tips reach. Where the remote has a ref already, at a commit that is known here, that commit and what
    it reaches stay; a new ref, or one at an unknown commit, is held against all refs of the remote. A tip of zeros or null
    deletes a ref and sends nothing. Several tips of one push send together what none of its remote commits reaches."""
    index = edges if isinstance(edges, CommitIndex) else CommitIndex(edges)
    remote = F.col("remote") if refs is not None else F.lit(None).cast("string")
    # Zeros are no commit where ids are text; a number is an id like any other.
    real = lambda rows, c: F.col(c).isNotNull() & (~F.col(c).rlike("^0+$") if rows.schema[c].dataType.typeName() == "string" else F.lit(True))
    rows = tips.filter(real(tips, "sha")).select("push_id", "sha", F.when(real(tips, "remote_sha"), F.col("remote_sha")).alias("remote_sha"), remote.alias("remote"))
    known = index.commits.select(F.col("sha").alias("remote_sha"), F.lit(True).alias("known"))
    rows = rows.join(known, "remote_sha", "left").withColumn("new", F.col("known").isNull())
    # Pushes that are held against the same commits share the work: a set is named by one of its pushes.
    kinds = rows.groupBy("push_id").agg(F.array_sort(F.collect_set(F.when(~F.col("new"), F.col("remote_sha").cast("string")))).alias("shas"), F.array_sort(F.collect_set(F.when(F.col("new"), F.col("remote")))).alias("remotes"))
    kinds = _stored(kinds, "kinds")
    sets = _stored(kinds.groupBy("shas", "remotes").agg(F.min("push_id").alias("set")), "sets")
    named = kinds.join(sets, ["shas", "remotes"]).select("push_id", "set")
    below = sets.select("set", F.explode("shas").alias("sha")).select("set", F.col("sha").cast(index.commits.schema["sha"].dataType).alias("sha"))
    if refs is not None:
        below = below.unionByName(sets.select("set", F.explode("remotes").alias("remote")).join(refs.filter(real(refs, "sha")).select("remote", "sha"), "remote").select("set", "sha"))
    above = rows.join(named, "push_id").select(F.col("push_id").alias("push"), "set", "sha").distinct()
    out = index.between(above, below.distinct()).select(F.col("push").alias("push_id"), "sha")
    _drop(kinds, sets, *[] if index is edges else [index.crossings])
    return out
