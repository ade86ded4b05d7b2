"""A package table in hash buckets, of which a batch rewrites those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintain import one_per_key, upsert
from .scratch import Rounds, new_folder, remove_folder

BUCKETS = 64
BROADCAST_ROWS = 1_000_000  # hashes of a batch's repositories (8 bytes each) are broadcast up to this many


def parted(rows: DataFrame, repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of these repositories, all others); ``repositories`` is a written table of distinct ones.

    Rows whose repository has another hash than any of them stay where they are; the others are compared in full.
    """
    if repositories.count() > BROADCAST_ROWS:
        return rows.join(repositories, "repository", "left_semi").select(*rows.columns), rows.join(repositories, "repository", "left_anti").select(*rows.columns)
    hashes = F.broadcast(repositories.select(F.xxhash64("repository").alias("_h")).distinct())
    marked = rows.withColumn("_h", F.xxhash64("repository"))
    near, far = (marked.join(hashes, "_h", how).select(*rows.columns) for how in ("left_semi", "left_anti"))
    own, other = (near.join(repositories, "repository", how).select(*rows.columns) for how in ("left_semi", "left_anti"))
    return own, far.unionByName(other)


class Buckets:
    """Rows dealt by their repository's hash, a folder for each bucket, sorted by import path within.

    A batch of new rows touches the buckets of its repositories, and those that hold rows of its import paths under
    another repository.  Only these are read whole and overwritten (Spark's dynamic partition overwrite); the files of
    all others stay as they are.  Applying a batch again gives the same table, so a batch that was interrupted, or is
    delivered twice, is simply applied again; a reader in the meantime may see some buckets before and some after it.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("repository"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, mode: str) -> None:
        """Ranges of (bucket, import path): a repository of very many rows is written by several tasks."""
        dealt = rows.withColumn("bucket", self._bucket()).repartitionByRange("bucket", "import_path").sortWithinPartitions("bucket", "import_path")
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)

    def create(self, rows: DataFrame) -> None:
        self._write(rows, "errorifexists")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.root)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _moved(self, batch: DataFrame) -> DataFrame:
        """(import_path, repository, bucket) of stored rows whose import path the batch has under another repository."""
        stored = self._stored().select("import_path", "repository", "bucket")
        elsewhere = stored.join(batch.select("import_path", F.col("repository").alias("_new")), "import_path")
        return elsewhere.filter(~F.col("repository").eqNullSafe(F.col("_new"))).select("import_path", "repository", "bucket")

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets that a batch changes; at most all of them."""
        own = batch.select(self._bucket().alias("bucket")).distinct()
        return sorted(r["bucket"] for r in own.union(self._moved(batch).select("bucket").distinct()).distinct().collect())

    def replaced(self, batch: DataFrame, reset: bool = True) -> DataFrame:
        """The stored rows that the batch will replace: those of its import paths, and with ``reset`` those of its repositories."""
        old = self._stored().filter(F.col("bucket").isin(self.touched(batch))).drop("bucket")
        same = old.join(batch.select("import_path").distinct(), "import_path", "left_semi")
        if not reset:
            return same
        rounds = Rounds(self.spark, "replaced")
        repositories = rounds.write(batch.select("repository").distinct(), keep=True)
        moved = rounds.write(self._moved(batch).select("import_path").distinct(), keep=True)
        own, other = parted(old, repositories)
        return own.unionByName(other.join(moved, "import_path", "left_semi").select(*old.columns))

    def apply(self, batch: DataFrame, reset: bool = False, order: str | None = None) -> list[int]:
        """Upsert a batch, with ``reset`` after removing its repositories' rows; returns the buckets that were rewritten."""
        staging = new_folder(self.spark, "buckets")
        columns = self.read().columns
        one_per_key(batch, "import_path", order).select(*columns).write.parquet(f"{staging}/batch")
        batch = self.spark.read.schema(self.read().schema).parquet(f"{staging}/batch")
        buckets = self.touched(batch)
        if not buckets:
            return []
        old = self._stored().filter(F.col("bucket").isin(buckets)).drop("bucket")
        if reset:  # one of each key already; rows of the batch's import paths elsewhere are few, and keys tell which
            batch.select("repository").distinct().write.parquet(f"{staging}/repositories")
            self._moved(batch).select("import_path").distinct().write.parquet(f"{staging}/moved")
            repositories, moved = (self.spark.read.schema(f"{c} string").parquet(f"{staging}/{n}") for c, n in (("repository", "repositories"), ("import_path", "moved")))
            left = parted(old, repositories)[1]
            if not moved.isEmpty():
                left = left.join(moved, "import_path", "left_anti").select(*old.columns)
            new = left.unionByName(batch.select(*old.columns))
        else:
            new = upsert(old, batch)
        new.write.parquet(f"{staging}/rows")  # complete before anything is overwritten
        rows = self.spark.read.schema(batch.schema).parquet(f"{staging}/rows")
        left = {r["bucket"] for r in rows.select(self._bucket().alias("bucket")).distinct().collect()}
        self._write(rows, "overwrite")
        for bucket in set(buckets) - left:  # all their rows went elsewhere
            remove_folder(self.spark, f"{self.root}/bucket={bucket}")
        remove_folder(self.spark, staging)
        return buckets
