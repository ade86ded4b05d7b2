"""Exact deduplication with streaming state.

A Structured Streaming query reads the digests of normalised texts and keeps, per digest and without
expiry, the smallest identifier, where its content lies and how many rows had it.  The state is on disk
(RocksDB) and goes on from one run to the next, so that later deliveries are deduplicated against all
earlier ones.  A digest seen more than once is a *hit*: its rows are fetched by their locators (file and
identifier) and their full bytes compared, by grouping on digest and text (combined before the shuffle, so that
a text with very many copies moves once per task).  Rows whose bytes differ under one digest are separated again.

All of it is DataFrame operations; no Python runs on the executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, Scratch, free_names

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BROADCAST_ROWS = 100_000  # digests (32 bytes each) and places (16 bytes) of hits are broadcast up to this many, shuffled beyond


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"{WS_CLASS}+", " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


DIGESTS = "doc_id long, locator string, digest binary, text_sha256 string"
CONTENTS = "doc_id long, text string, digest binary, text_sha256 string, delivery string"


def update_state(digests_dir: str, schema: str, scratch: Scratch, state_dir: str, out: str | None = None) -> DataFrame:
    """Run the keyed state over all files of ``digests_dir`` that it has not seen: (digest, keep_id, locator, group_size).

    ``state_dir`` holds the stream's checkpoint; with the same one, a later call takes up the state.  The rows are those
    of the digests that this call touched, or, where ``out`` names a folder that calls share, of all digests.
    Without a column locator, a row's content lies in the file of ``digests_dir`` that holds it.
    """
    spark = scratch.spark
    out = out or scratch.path("state")
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        # a store is closed once its task has committed: an executor's disk holds the open ones only
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).parquet(digests_dir)
        if "locator" not in rows.columns:
            rows = rows.select("doc_id", "digest", F.input_file_name().alias("locator"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "locator"))
        state = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("locator"), "group_size").write.mode(
                "overwrite"
            ).parquet(f"{out}/batch={number}")

        query = (
            state.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True)
            .option("checkpointLocation", state_dir).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    changes = "digest binary, keep_id long, locator string, group_size long, batch int"
    table = spark.read.schema(changes).parquet(out)
    # a digest appears in every batch that touched it; the last one has its whole group
    last = table.groupBy("digest").agg(F.max(F.struct("batch", "keep_id", "locator", "group_size")).alias("s"))
    return last.select("digest", "s.keep_id", "s.locator", "s.group_size")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def deduplicate(docs: DataFrame, state_dir: str | None = None, digest=sha256_digest, every_delivery: bool = False) -> DataFrame:
    """Which row of equal texts stays: doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    docs: doc_id, text and any other columns (ignored).  Texts are equal when identical after each run of
    ASCII white space became one space; null counts as empty.  Of equal texts the smallest doc_id stays; a
    null doc_id stays only where its whole group has none, and keep_id is then null.  Rows that repeat the
    smallest doc_id with the same text are one document and are all marked kept.  An empty table gives an
    empty table.  ``digest`` may be replaced by a weaker function; the result does not change.

    Locators of rows that do not come from files are empty: their content is then found by doc_id alone.

    With ``state_dir`` the state goes on from call to call: docs are a delivery, compared with all earlier ones.
    Their normalised texts are kept below it, so that a locator, the file of a text, stays valid and full bytes
    can be compared over deliveries.  ``every_delivery`` asks for the rows of all of them.  Calling again with
    the same documents delivers them again.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    own_id, text = F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text")
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    if state_dir is None:
        key = docs.select(own_id, text, F.input_file_name().alias("locator"))
        folder = scratch.path("digests")
        key.select("doc_id", "locator", digest(F.col("text")).alias("digest"), sha).write.parquet(folder)
        store = ours = spark.read.schema(DIGESTS).parquet(folder)
        state = scratch.write(update_state(folder, DIGESTS, scratch, scratch.path("checkpoint")), "groups")
    else:
        folder, delivery = f"{state_dir}/documents", uuid.uuid4().hex
        key = docs.select(own_id, text).select("doc_id", "text", digest(F.col("text")).alias("digest"), sha, F.lit(delivery).alias("delivery"))
        key.write.mode("append").parquet(folder)
        store = spark.read.schema(CONTENTS).parquet(folder).withColumn("locator", F.input_file_name())
        ours = store if every_delivery else store.filter(F.col("delivery") == delivery)
        state = scratch.write(update_state(folder, CONTENTS, scratch, f"{state_dir}/checkpoint", f"{state_dir}/groups"), "groups")

    hits = _few(state.filter("group_size > 1").select("digest"))
    # where the hits' contents are: their rows' files (hashed) and identifiers; digests are compared once more below
    found = store.select("digest", "doc_id", "locator").join(hits, "digest", "left_semi").select(F.xxhash64("locator").alias("at"), F.col("doc_id").alias("id"))
    found = _few(scratch.write(found.distinct(), "hits"))
    if state_dir is None:
        source = docs.select(own_id, "text", F.input_file_name().alias("locator"))
    else:
        source = store.select("doc_id", "text", "locator")
    there = (F.xxhash64("locator") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("id"))
    same = source.join(found, there, "left_semi").select("doc_id", text).withColumn("digest", digest(F.col("text"))).join(hits, "digest", "left_semi")
    same = same.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    same = same.select("digest", sha, "keep_id", "group_size")
    checked = scratch.write(same, "checked")
    # under a digest whose rows are all equal, the state already has the answer
    torn = checked.groupBy("digest").count().filter("count > 1").select("digest")
    apart = checked.join(torn, "digest", "left_semi").select(
        "digest", "text_sha256", F.col("keep_id").alias("own_id"), F.col("group_size").alias("own_size"), F.lit(True).alias("own")
    )
    out = ours.select("doc_id", "digest", "text_sha256").join(state.select("digest", "keep_id", "group_size"), "digest", "left")
    if not apart.isEmpty():
        out = out.join(apart, ["digest", "text_sha256"], "left").withColumns(
            {"keep_id": F.when(F.col("own"), F.col("own_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("own_size", "group_size")}
        )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each group of equal texts.

    Of rows that repeat both doc_id and text, one stays.  Rows to drop are fewer than rows to keep, so the
    former are looked up: broadcast where they are few, else by a shuffle.
    """
    scratch = Scratch(docs.sparkSession, "keep-first")
    verdict = scratch.write(deduplicate(docs).select("doc_id", "kept", "text_sha256"), "verdicts")
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    keys = free_names(docs, "unnamed", "own_id", "own_sha")
    named = [F.col("doc_id").isNull().alias(keys[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(keys[1])]
    rows = docs.select("*", *named, digest.alias(keys[2]))
    verdict = verdict.select(*named, F.col("text_sha256").alias(keys[2]), "kept")
    gone = verdict.filter(~F.col("kept")).select(*keys).distinct()
    again = verdict.filter("kept").groupBy(*keys).count().filter("count > 1").select(*keys)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    out = rows.join(gone, keys, "left_anti")
    if not again.isEmpty():
        out = out.join(again, keys, "left_anti").unionByName(out.join(again, keys, "left_semi").dropDuplicates(keys))
    return out.select(*docs.columns)
