"""Repository status as keyed streaming state, with timers that tell when a repository is due.

Each (repository, tag) has its status and its history in state of its own (RocksDB), so that a micro-batch costs the
keys it touches, whatever the number of repositories.  An event-time timer per key stands at the moment from which the
repository is worth a check; when the stream's clock passes it, the repository is emitted for the work list and the timer
moves on, until a check resets it.  No scan over all rows takes place.

The output is one table of changes: a row of kind ``status`` for every key that a batch touched, one of kind ``due`` for
every key that came due.  The status table is read from the state itself.  ``run_keyed_crawl`` reloads the repositories
whose checks asked for an update into a bucketed package table and keeps the index of reverse dependencies up with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reverse_index import ReverseIndex
from ..operators.status import HISTORY, KEY
from ..sources.buckets import Buckets, parted
from ..sources.scratch import new_folder, remove_folder
from .status_stream import OBSERVATION

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = (
    "ref_seen string, ref_name string, digest string, error_count int, prefix string, last_check long, last_seq long, seen long, seen_seq long, timer long, updates int"
)
ENTRY = "n int, `when` long, digest string"
OUTPUT = (
    "kind string, repository string, tag string, ref_name string, digest string, error_count int, prefix string, last_check long, last_seq long, "
    "updates array<struct<`when`: long, digest: string>>, changed boolean, at long"
)
#: Rows of this repository are ticks: they move the clock and have no state.
CLOCK = ""


@dataclass(frozen=True)
class ScanRule:
    """When repositories are due, and which of them are taken: as ``due`` and ``scan_plan`` have it."""

    minimum_seconds: int
    rate: float = 1.0
    seed: int = 0
    lateness_seconds: int = 600  # the clock is the latest time seen; rows older than it by more are dropped


def _processor(rule: ScanRule | None, history: int, clock: str):
    """The processor's class is made here so that it travels with its code: executors need no copy of this package."""
    import hashlib

    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    state_type, entry_type = STATE, ENTRY
    minimum = rule.minimum_seconds * 1_000_000 if rule else 0
    late_ms = rule.lateness_seconds * 1000 if rule else 0
    fields = [f.split()[0] for f in STATE.split(", ")]

    def chosen(repository: str, tag: str) -> bool:
        name = f"{rule.seed}:{repository}@{tag}" if tag else f"{rule.seed}:{repository}"
        return int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / float(1 << 52) < (rule.rate or 1.0)

    class Status(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.status = handle.getValueState("status", state_type)
            self.history = handle.getListState("history", entry_type)

        def _load(self):
            if not self.status.exists():
                return dict.fromkeys(fields) | {"error_count": 0, "prefix": "", "updates": 0}, []
            stored = dict(zip(fields, self.status.get(), strict=True))
            return stored, sorted(tuple(e) for e in self.history.get()) if stored["updates"] else []

        def _store(self, s, entries):
            self.status.update(tuple(s[f] for f in fields))
            if entries is not None:
                if entries:
                    self.history.put([(k, when, digest) for k, (_, when, digest) in enumerate(entries)])
                else:
                    self.history.clear()

        def _row(self, kind, key, s, entries, changed, at):
            updates = [Row(when=w, digest=d) for _, w, d in entries]
            return Row(kind=kind, repository=key[0], tag=key[1], ref_name=s["ref_name"], digest=s["digest"], error_count=s["error_count"], prefix=s["prefix"],
                       last_check=s["last_check"], last_seq=s["last_seq"], updates=updates, changed=changed, at=at)

        def _due_at(self, s, entries):
            """The first millisecond at which the repository is due."""
            if minimum == 0 or s["last_check"] is None:
                return 0
            first = -(-(s["last_check"] + minimum) // 1000)
            if entries:
                mean = (entries[-1][1] - entries[0][1]) // len(entries)
                first = max(first, (s["last_check"] + mean) // 1000 + 1)
            return first

        def _arm(self, s, at):
            """One timer for each key; ``at`` is on the clock, which is ahead of the watermark by the lateness."""
            if s["timer"] is not None:
                self.handle.deleteTimer(s["timer"])
            s["timer"] = max(at - late_ms, 1)
            self.handle.registerTimer(s["timer"])

        def handleInputRows(self, key, rows, timerValues):
            if key[0] == clock:
                return
            s, entries = self._load()
            fresh = changed = False
            for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
                if s["seen"] is not None and (r["at"], r["seq"]) <= (s["seen"], s["seen_seq"]):
                    continue
                s["seen"], s["seen_seq"] = r["at"], r["seq"]
                ref = r["ref"].rpartition("/")[2] if r["ref"] is not None else None
                if ref is not None:
                    if s["ref_seen"] is not None and ref != s["ref_seen"]:
                        s["digest"] = None
                    s["ref_seen"] = ref
                s["prefix"] = r["prefix"] or s["prefix"]
                if r["failed"]:
                    s["error_count"] += 1
                    continue
                if s["digest"] is not None and r["digest"] != s["digest"]:
                    entries = [*entries, (len(entries), s["last_check"], s["digest"])][-history:]
                    fresh = True
                changed |= r["digest"] != s["digest"]
                s |= {"digest": r["digest"], "last_check": r["at"], "last_seq": r["seq"], "error_count": 0}
                s["ref_name"] = r["ref"] if r["ref"] is not None else s["ref_name"]
            s["updates"] = len(entries)
            if rule:
                self._arm(s, max(self._due_at(s, entries), -(-s["seen"] // 1000)) - 1)
            self._store(s, entries if fresh else None)
            yield self._row("status", key, s, entries, changed, s["seen"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentWatermarkInMs() + late_ms
            s, entries = self._load()
            s["timer"] = None  # it has gone off
            first = max(self._due_at(s, entries), -(-s["seen"] // 1000))
            if first > now:
                self._arm(s, first)
                self._store(s, None)
                return
            self._arm(s, now + 1)  # again with the next movement of the clock, unless a check comes first
            self._store(s, None)
            if chosen(*key):
                yield self._row("due", key, s, entries, False, now * 1000)

        def close(self):
            pass

    return Status()


def keyed_changes(observations: DataFrame, rule: ScanRule | None = None) -> DataFrame:
    """The stream of changes of a stream of observations (and ticks); rows of one key within a batch are put in order there."""
    prefix = F.coalesce("prefix", F.lit("")) if "prefix" in observations.columns else F.lit("")
    rows = observations.select(*KEY, "ref", "digest", "failed", F.unix_micros("ts").alias("at"), "seq", prefix.alias("prefix"), "ts")
    if rule:
        rows = rows.withWatermark("ts", f"{rule.lateness_seconds} seconds")
    return rows.groupBy(*KEY).transformWithState(_processor(rule, HISTORY, CLOCK), OUTPUT, "Update", "EventTime" if rule else "None")


def run_keyed_status(spark: SparkSession, source: str, root: str, rule: ScanRule | None = None, files_per_batch: int = 1, each=None) -> None:
    """Take up the stream over a folder of observation files and run it until all of them are in the state.

    ``root`` holds the state and the changes.  A batch that is delivered again writes its changes again under its own
    number.  ``each(changes, number)`` is called with a batch's written changes.
    """
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_batch).parquet(source)

        def keep(batch: DataFrame, number: int) -> None:
            path = f"{root}/changes/batch={number}"
            batch.write.mode("overwrite").partitionBy("kind").parquet(path)
            if each:
                each(spark.read.schema(OUTPUT).option("basePath", path).parquet(path), number)

        query = keyed_changes(rows, rule).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_keyed_crawl(
    spark: SparkSession, source: str, root: str, packages: Buckets, manifests: DataFrame, index: ReverseIndex | None = None, rule: ScanRule | None = None, files_per_batch: int = 1
) -> None:
    """The crawl over a folder of check results: each batch folds them into the state once, and rewrites the buckets of changed repositories.

    ``manifests`` holds package rows of any repositories; only those of changed ones are taken.  The index takes a
    batch's difference before the package table changes, under the batch's number; a batch that is delivered again
    repeats the rest.  Ranks are another matter: they change with every edge anywhere, so they belong in a table of
    their own, made from ``packages.read()`` when they are wanted.
    """

    def each(changed: DataFrame, number: int) -> None:
        repositories = changed.filter("kind = 'status' AND changed").select("repository").distinct()
        folder = new_folder(spark, "loaded")
        repositories.write.parquet(f"{folder}/repositories")
        loaded = parted(manifests, spark.read.schema(repositories.schema).parquet(f"{folder}/repositories"))[0].select(*packages.read().columns)
        loaded.write.parquet(f"{folder}/rows")
        loaded = spark.read.schema(loaded.schema).parquet(f"{folder}/rows")
        if index is not None:
            index.apply(number, packages.replaced(loaded), loaded)
        packages.apply(loaded, reset=True)
        remove_folder(spark, folder)

    run_keyed_status(spark, source, root, rule, files_per_batch, each)


def changes(spark: SparkSession, root: str) -> DataFrame:
    """All changes so far, with the number of their batch."""
    return spark.read.schema(f"{OUTPUT}, batch long").option("basePath", f"{root}/changes").parquet(f"{root}/changes")


def _times(rows: DataFrame) -> DataFrame:
    entry = lambda e: F.struct(F.timestamp_micros(e["when"]).alias("when"), e["digest"].alias("digest"))
    return rows.withColumns({"last_check": F.timestamp_micros("last_check"), "updates": F.transform("updates", entry)})


def keyed_status(spark: SparkSession, root: str) -> DataFrame:
    """The status table, as ``fold`` gives it, read from the stream's state."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{root}/checkpoint")
    status = read("status").select("key.*", "value.*").drop("updates")
    entries = read("history").select("key.*", F.col("list_element").alias("e"))
    entries = entries.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["when"].alias("when"), e["digest"].alias("digest"))).alias("updates"))
    none = F.array().cast("array<struct<when: bigint, digest: string>>")
    rows = status.join(entries, list(KEY), "left").withColumn("updates", F.coalesce("updates", none))
    return _times(rows).select(*KEY, "ref_name", "digest", "error_count", "prefix", "last_check", "last_seq", "updates")


def due_changes(spark: SparkSession, root: str) -> DataFrame:
    """(repository, tag, ref_name, at): what came due, and when, as the clock passed."""
    return changes(spark, root).filter("kind = 'due'").select(*KEY, "ref_name", F.timestamp_micros("at").alias("at"), "batch")


def tick(spark: SparkSession, source: str, at) -> None:
    """Move the stream's clock by a file of its own."""
    row = spark.createDataFrame([(CLOCK, "", None, None, True, at, 0)], OBSERVATION)
    row.coalesce(1).write.mode("append").parquet(source)
