"""Tables of an iteration in the cluster's shared folder, and published snapshots."""

from __future__ import annotations

import contextlib
import contextvars
import json
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset in a local session (tests), a new local one.

    On a cluster the setting is required: executors do not see each other's local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)


#: Folders that the current caller will remove; each thread has its own.
_OWNED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned_folders", default=None)


@contextlib.contextmanager
def owned_folders(spark: SparkSession) -> Iterator[list[str]]:
    """Removes, at its end, the intermediate tables of the operators called within, and no one else's.

    For callers that have written what was made of them by then.  Operators called from other threads, or outside,
    keep theirs; contexts may be nested, the innermost one owns.
    """
    folders: list[str] = []
    token = _OWNED.set(folders)
    try:
        yield folders
    finally:
        _OWNED.reset(token)
        for path in folders:
            remove_folder(spark, path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A name for a folder of intermediate tables, noted for whoever owns what is being made."""
    path, owner = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}", _OWNED.get()
    if owner is not None:
        owner.append(path)
    return path


class Rounds:
    """Writes the state of each round of an iteration, which cuts its lineage, and drops the one before last.

    What remains is read by the result; ``owned_folders`` removes it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths = spark, new_folder(spark, label), []

    def write(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{len(self.paths):03d}"
        df.write.parquet(path)
        for old in self.paths[-2:-1]:
            if old:
                remove_folder(self.spark, old)
        self.paths.append(None if keep else path)
        return self.spark.read.schema(df.schema).parquet(path)


class Snapshots:
    """Versions of a table under one folder; a small pointer file names the current one and carries a note.

    A version is written in full before the pointer changes, so readers see whole tables only.  The version before
    the current one stays for readers that began with it; older ones are removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> dict | None:
        fs, pointer = _filesystem(self.spark, f"{self.root}/CURRENT")
        if not fs.exists(pointer):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first()[0])

    def exists(self) -> bool:
        return self._pointer() is not None

    def note(self) -> dict:
        """What was noted with the current version."""
        return (self._pointer() or {}).get("note", {})

    def publish(self, df: DataFrame, sort_by: str | None = None, note: dict | None = None) -> str:
        before = self._pointer() or {}
        name = f"v-{uuid.uuid4().hex[:12]}"
        if sort_by:  # range-sorted files make key ranges and prefixes prunable
            df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
        df.write.parquet(f"{self.root}/{name}")
        fs, pointer = _filesystem(self.spark, f"{self.root}/CURRENT")
        out = fs.create(pointer, True)
        out.write(bytearray(json.dumps({"name": name, "before": before.get("name"), "note": note or {}}).encode()))
        out.close()
        if before.get("before"):
            remove_folder(self.spark, f"{self.root}/{before['before']}")
        return name

    def current(self) -> DataFrame:
        found = self._pointer()
        if found is None:
            raise FileNotFoundError(f"no table has been published in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{found['name']}")
