"""A table of sums that batches change by differences: a sorted base, and what has been added to it since."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Snapshots, remove_folder

MAX_DELTAS = 20


class Differences:
    """Rows of keys and numbers; the numbers of a key add up over the base and the differences.

    A batch writes its difference under its number, and nothing where that number is there already, so that it may be
    delivered again.  All parts are range-sorted by ``sort_by``, so that predicates on it prune their files.  Beyond
    ``most`` differences, or when asked, they are merged into a new base.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...], sort_by: str, most: int | None = None):
        self.spark, self.root, self.keys, self.sort_by = spark, root.rstrip("/"), keys, sort_by
        self.most = MAX_DELTAS if most is None else most
        self.base = Snapshots(spark, f"{self.root}/base")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def build(self, rows: DataFrame) -> None:
        """Begin anew; numbers begin at 0 again."""
        remove_folder(self.spark, f"{self.root}/deltas")
        self.base.publish(rows, self.sort_by, {"upto": -1})

    def numbers(self) -> list[int]:
        """Numbers of the complete differences that the base lacks."""
        fs, path = self._path("deltas")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n) for n in names if fs.exists(self._path(f"deltas/{n}/_SUCCESS")[1])]
        return sorted(n for n in done if n > self.upto)

    @property
    def upto(self) -> int:
        """The last number that the base contains."""
        return self.base.note().get("upto", -1)

    def has(self, number: int) -> bool:
        return number <= self.upto or number in self.numbers()

    def add(self, number: int, rows: DataFrame) -> None:
        if self.has(number):
            return
        rows.repartitionByRange(self.sort_by).sortWithinPartitions(self.sort_by).write.mode("overwrite").parquet(f"{self.root}/deltas/{number}")
        if len(self.numbers()) > self.most:
            self.compact()

    def parts(self) -> list[DataFrame]:
        base = self.base.current()
        return [base, *(self.spark.read.schema(base.schema).parquet(f"{self.root}/deltas/{n}") for n in self.numbers())]

    def sums(self, narrow=lambda part: part) -> DataFrame:
        """The sums by key, of what ``narrow`` leaves of each part."""
        rows = reduce(DataFrame.unionByName, [narrow(p) for p in self.parts()])
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in self.keys])

    def compact(self, keep=lambda rows: rows) -> None:
        numbers = self.numbers()
        if numbers:
            self.base.publish(keep(self.sums()), self.sort_by, {"upto": numbers[-1]})
            for n in numbers:
                remove_folder(self.spark, f"{self.root}/deltas/{n}")
