"""The status fold and the crawl as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintain import apply_ranks, upsert_reset
from ..operators.rank import pagerank, scaled
from ..operators.status import KEY, fold, needs_update
from ..sources.schema import STATUS
from ..sources.scratch import Rounds, Snapshots, owned_folders

OBSERVATION = "repository string, tag string, ref string, digest string, failed boolean, ts timestamp, seq long"


def _state(store: Snapshots) -> DataFrame:
    return store.current() if store.exists() else store.spark.createDataFrame([], STATUS)


def _folded(store: Snapshots, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(before, after): the status rows that a batch touches, as stored, and with the batch; both written."""
    rounds = Rounds(store.spark, "touched")
    batch = batch.select(*[f.split()[0] for f in OBSERVATION.split(", ")])
    before = rounds.write(_state(store).join(batch.select(*KEY).distinct(), list(KEY), "left_semi"), keep=True)
    return before, rounds.write(fold(batch, before), keep=True)


def _publish(store: Snapshots, touched: DataFrame, note: dict) -> None:
    rest = _state(store).join(touched.select(*KEY), list(KEY), "left_anti")
    store.publish(rest.unionByName(touched), "repository", note)


def fold_batch(store: Snapshots, batch: DataFrame, number: int | None = None, stream: str = "") -> None:
    """Fold a micro-batch into the stored status table and publish the new version.

    A stream may deliver a batch again: the number of the last one is noted with the table, for each stream, and
    a batch that is in the table already changes nothing.  The published version is the whole table anew.
    """
    note = store.note()
    if number is not None and note.get(stream, -1) >= number:
        return
    with owned_folders(store.spark):
        _publish(store, _folded(store, batch)[1], note | ({} if number is None else {stream: number}))


def _run(rows: DataFrame, each, checkpoint: str) -> None:
    query = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_status_stream(spark: SparkSession, source: str, store: Snapshots, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """Fold all observation files of a folder, in order of arrival, and return the status table."""
    rows = spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    _run(rows, lambda batch, number: fold_batch(store, batch, number, checkpoint), checkpoint)
    return _state(store)


def changed_repositories(status: DataFrame, observations: DataFrame) -> DataFrame:
    """(repository): those whose last successful check among the observations asks for an update, given the status before them."""
    return _changed(status, fold(observations, status))


def _changed(status: DataFrame, seen: DataFrame) -> DataFrame:
    before = status.select(*KEY, F.col("digest").alias("_before"), F.col("last_check").alias("_when"))
    now = seen.join(before, list(KEY), "left").filter(F.col("last_check").isNotNull() & ~F.col("digest").eqNullSafe(F.col("_before")))
    return now.select("repository").distinct()


def crawl_batch(packages: DataFrame, observations: DataFrame, manifests: DataFrame, iterations: int = 0) -> DataFrame:
    """One round: repositories whose last check asks for an update are reloaded from their manifests, then all is ranked anew.

    ``manifests`` holds package rows of any repositories; only those of changed ones are taken.
    """
    checks = needs_update(observations)
    last = checks.groupBy(*KEY).agg(F.max_by("needs_update", F.struct("ts", "seq")).alias("changed"))
    changed = last.filter("changed").select("repository").distinct()
    return apply_ranks(*_reloaded(packages, changed, manifests, iterations))


def _reloaded(packages: DataFrame, changed: DataFrame, manifests: DataFrame, iterations: int) -> tuple[DataFrame, DataFrame]:
    rounds = Rounds(packages.sparkSession, "reloaded")  # both are read several times
    loaded = rounds.write(manifests.join(changed, "repository", "left_semi").select(*packages.columns), keep=True)
    updated = rounds.write(upsert_reset(packages, loaded), keep=True)
    return updated, scaled(pagerank(updated, iterations))


def run_crawl_stream(
    spark: SparkSession, source: str, status: Snapshots, packages: Snapshots, manifests: DataFrame, checkpoint: str, iterations: int = 0, files_per_batch: int = 1
) -> DataFrame:
    """Crawl as a stream of check results: each batch reloads the repositories that changed, ranks all packages and folds the status.

    The package table is published before the status table, each with the batch's number: a batch that is delivered again
    repeats only what had not been published, and reloading a repository twice gives the same rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        if status.note().get(checkpoint, -1) >= number:
            return  # the package table is published first
        with owned_folders(spark):
            before, after = _folded(status, batch)  # one fold tells what changed and what is stored
            if packages.note().get(checkpoint, -1) < number:
                updated = apply_ranks(*_reloaded(packages.current(), _changed(before, after), manifests, iterations))
                packages.publish(updated, "import_path", packages.note() | {checkpoint: number})
            _publish(status, after, status.note() | {checkpoint: number})

    rows = spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    _run(rows, each, checkpoint)
    return packages.current()
