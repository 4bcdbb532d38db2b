"""Rotation state of a stream of scans that gives up what is gone: once a scan has ended, places that it didn't see are
dropped, but those under a source that couldn't be looked at.

Places are kept in buckets of a hash, so no folder, host or user is one task, and an end of a scan reaches every bucket. A
bucket is a map in RocksDB on the executor; its changes are in the checkpoint, from which a lost executor's buckets are read
again. `kept` reads the state itself."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 256
#: A sighting has location, fp and at; an end has null there but for `at`, and began and unseen.
SCANS = "location string, fp string, at long, began long, unseen array<struct<kind:string,pattern:string>>"
OUT = "location string, fp string, since long, exact boolean, gone boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Unseen:
    """The rules of sources that couldn't be looked at, found by kind and folder. One * may stand in the last component."""

    def __init__(self, rules: list | None):
        self.by_folder: dict[tuple[str, str], list[str]] = {}
        for kind, pattern in rules or []:
            folder, _, name = pattern.rpartition("/")
            self.by_folder.setdefault((kind, folder), []).append(name)

    def holds(self, location: str) -> bool:
        kind, _, rest = location.partition(":")
        folder, _, name = rest.partition("#")[0].rpartition("/")
        for pattern in self.by_folder.get((kind, folder), ()):
            before, star, _ = pattern.partition("*")
            after = pattern.rpartition("*")[2]
            if name == pattern if not star else len(name) >= len(before) + len(after) and name.startswith(before) and name.endswith(after):
                return True
        return False


class PrunedState(StatefulProcessor):
    """A bucket's places, and when the last scan ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "location string", "fp string, since long, exact boolean, seen long")
        self.ended = handle.getValueState("ended", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ended = self.ended.get()[0] if self.ended.exists() else None
        changed: dict[str, Row] = {}
        touched: dict[str, tuple] = {}
        # Of one time, what was seen comes before the end of the scan.
        for row in sorted(rows, key=lambda r: (r.at, r.location is None, r.location or "", r.fp or "")):
            if ended is not None and row.at <= ended:
                continue
            if row.location is not None:
                self._see(row, touched)
                continue
            changed |= self._put(touched)
            touched.clear()
            ended = row.at
            self.ended.update((ended,))
            changed |= {gone.location: gone for gone in self._prune(row)}
        changed |= self._put(touched)
        yield from changed.values()

    def _see(self, row: Row, touched: dict[str, tuple]) -> None:
        old = touched.get(row.location) or self.places.getValue((row.location,))
        if old is None:
            touched[row.location] = (row.fp, row.at, False, row.at)
        elif row.at >= old[3]:
            same = old[0] == row.fp
            touched[row.location] = (row.fp, old[1] if same else row.at, old[2] if same else True, row.at)

    def _put(self, touched: dict[str, tuple]) -> dict[str, Row]:
        """A place is read and written once for all that was seen of it."""
        for location, value in touched.items():
            self.places.updateValue((location,), value)
        return {location: Row(location=location, fp=v[0], since=v[1], exact=v[2], gone=False) for location, v in touched.items()}

    def _prune(self, end: Row) -> list[Row]:
        if not self.places.exists():
            return []
        unseen = Unseen(end.unseen)
        out = [Row(location=place[0], fp=v[0], since=v[1], exact=v[2], gone=True) for place, v in self.places.iterator() if v[3] < end.began and not unseen.holds(place[0])]
        for row in out:
            self.places.removeKey((row.location,))
        return out


def pruned_stream(scans: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of SCANS rows -> (location, fp, since, exact, gone): a row for each place that a batch touched or gave up.

    An end says that all of the scan from `began` to `at` has arrived, in its batch or earlier ones, and names the rules that
    couldn't be looked at; they are those of a rule file, so they fit a row. What comes later for a time up to an ended scan is
    ignored, ends that come again too. Rows without a time, and sightings without fp, are no sightings. Within a batch rows
    count in order of `at`, then of location and fp, and a place that comes and goes has its last row only. The part of a batch
    that falls into a bucket is sorted in memory, so `buckets` has to grow with a batch."""
    good = scans.filter("at is not null and (location is null and began is not null or location is not null and fp is not null)")
    place = F.pmod(F.xxhash64("location"), F.lit(buckets)).cast("int")
    each = F.when(F.col("location").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(place))
    # Pairs instead of structs, which reach the processor as dicts.
    rules = F.transform(F.filter("unseen", lambda r: r["kind"].isNotNull() & r["pattern"].isNotNull()), lambda r: F.array(r["kind"], r["pattern"]))
    rows = good.select(F.explode(each).alias("bucket"), "location", "fp", "at", "began", rules.alias("unseen"))
    return rows.groupBy("bucket").transformWithState(PrunedState(), OUT, "update", "none")


def kept(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(location, fp, since, exact): the state itself, as of the last batch that the checkpoint holds."""
    rows = spark.read.format("statestore").option("stateVarName", "places").load(checkpoint)
    return rows.select("user_map_key.location", "user_map_value.fp", "user_map_value.since", "user_map_value.exact")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started in here keep their state in RocksDB, which maps need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
