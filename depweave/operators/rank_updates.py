"""PageRank that follows changes of the graph.

A round is linear in the weights: with ``c(0) = 1`` for every node and ``c(k) = damping * sum(c(k-1)(source) / links(source))``
over the edges, the weight after ``r`` rounds is ``(1 - damping) * (c(0) + ... + c(r-1)) + c(r) / n``.  The terms ``c(k)`` do
not depend on the number of nodes, so a change of some rows changes them only where it can be reached in so many steps,
and ever less.  They are kept for every round; an update pushes their differences along the edges, from the
changed rows and from nodes whose term changed in the round before, and from nowhere else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.differences import Differences
from ..sources.scratch import new_folder, remove_folder
from .rank import DAMPING, ITERATIONS

BROADCAST_ROWS = 100_000  # changed nodes (some 50 bytes each) are broadcast up to this many, shuffled beyond
TOLERANCE = 1e-14  # differences below do not travel on


class RankState:
    """The terms c0 to c<rounds> of every node, kept by differences."""

    def __init__(self, spark: SparkSession, root: str, rounds: int = ITERATIONS, damping: float = DAMPING, most: int | None = None):
        if not 0 <= damping <= 1:
            raise ValueError(f"damping {damping} is not within 0..1")
        self.spark, self.rounds, self.damping = spark, rounds, damping
        self.columns = [f"c{k}" for k in range(rounds + 1)]
        self.table = Differences(spark, root, ("import_path",), "import_path", most)
        self.moved: list[int] = []  # nodes whose term changed, by round of the last update

    def _wide(self, rounds: list[DataFrame]) -> DataFrame:
        """One row for each node from a table (import_path, d) of each round."""
        rows = reduce(DataFrame.unionByName, [r.select("import_path", F.lit(k).alias("k"), "d") for k, r in enumerate(rounds)])
        term = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("d"))), F.lit(0.0)).alias(f"c{k}")
        return rows.groupBy("import_path").agg(*[term(k) for k in range(self.rounds + 1)])

    def _few(self, rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    def _pushed(self, rows: DataFrame, value: str) -> DataFrame:
        """(import_path, d): what rows (directs and a value) push along their links."""
        share = rows.filter(F.size("directs") > 0).select(F.explode("directs").alias("import_path"), (F.lit(self.damping) * F.col(value) / F.size("directs")).alias("d"))
        return share.groupBy("import_path").agg(F.sum("d").alias("d"))

    def build(self, packages: DataFrame) -> None:
        """All terms of a whole package table; updates are numbered from 0."""
        folder = new_folder(self.spark, "rank-terms")
        rows = packages.select("import_path", "directs")
        ends = rows.select(F.explode("directs").alias("import_path"))
        now = rows.select("import_path").unionByName(ends).distinct().withColumn("d", F.lit(1.0))
        found, inner = [], rows
        for k in range(self.rounds + 1):
            if k == 1:  # every row has 1
                now = self._pushed(rows.withColumn("d", F.lit(1.0)), "d")
            elif k:
                if k == 2:  # from here on only rows that something links to have a term
                    rows.join(found[1], "import_path", "left_semi").write.parquet(f"{folder}/inner")
                    inner = self.spark.read.schema(rows.schema).parquet(f"{folder}/inner")
                now = self._pushed(inner.join(found[-1], "import_path"), "d")
            now.write.parquet(f"{folder}/{k}")
            found.append(self.spark.read.schema("import_path string, d double").parquet(f"{folder}/{k}"))
        self.table.build(self._wide(found))
        remove_folder(self.spark, folder)

    def _node_changes(self, old: DataFrame, new: DataFrame, packages: DataFrame) -> DataFrame:
        """(import_path, d): 1 for nodes that appear with the new rows, -1 for those that nothing names any more."""
        names = lambda rows: rows.select("import_path").unionByName(rows.select(F.explode("directs").alias("import_path"))).distinct()
        before, after = names(old), names(new)
        known = self.table.sums(lambda part: part.select("import_path", "c0").join(self._few(after), "import_path", "left_semi"))
        known = known.filter("c0 > 0.5").select("import_path")
        come = after.join(known, "import_path", "left_anti")
        lost = self._few(before.join(after, "import_path", "left_anti"))
        still = packages.select("import_path").unionByName(packages.select(F.explode("directs").alias("import_path"))).join(lost, "import_path", "left_semi").distinct()
        gone = lost.join(still, "import_path", "left_anti")
        return come.withColumn("d", F.lit(1.0)).unionByName(gone.withColumn("d", F.lit(-1.0)))

    def update(self, number: int, old: DataFrame, new: DataFrame, packages: DataFrame) -> None:
        """Batch ``number`` turned ``old`` rows into ``new`` ones; ``packages`` is the table after it.

        A batch that is there already changes nothing.
        """
        if self.table.has(number):
            return
        folder = new_folder(self.spark, "rank-update")

        def written(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{folder}/{name}")
            return self.spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

        old, new = (written(r.select("import_path", "directs"), n) for r, n in ((old, "old"), (new, "new")))
        sources = written(old.select("import_path").unionByName(new.select("import_path")).distinct(), "sources")
        terms = written(self.table.sums(lambda part: part.join(self._few(sources), "import_path", "left_semi")), "terms")
        links, inner = packages.select("import_path", "directs"), None
        steps = [written(self._node_changes(old, new, links), "0")]
        self.moved = [steps[0].count()]
        for k in range(1, self.rounds + 1):
            change = steps[-1]
            few = F.broadcast(change) if self.moved[-1] <= BROADCAST_ROWS else change
            own = terms.select("import_path", F.col(f"c{k - 1}").alias("c"))
            before = old.join(own, "import_path").withColumn("c", -F.col("c"))
            now = new.join(own, "import_path", "left").join(few, "import_path", "left").withColumn("c", F.coalesce("c", F.lit(0.0)) + F.coalesce("d", F.lit(0.0)))
            if k > 1 and inner is None and self.moved[-1] > BROADCAST_ROWS:
                # many terms changed, which are of targets from the first round on: rows that nothing links to are left out once
                ends = self.table.sums(lambda part: part.select("import_path", "c1")).filter("c1 <> 0").select("import_path").unionByName(steps[1].select("import_path"))
                inner = links = written(links.join(ends, "import_path", "left_semi"), "inner")
            rest = links.join(few.join(sources, "import_path", "left_anti"), "import_path").withColumnRenamed("d", "c")
            pushes = reduce(DataFrame.unionByName, [self._pushed(r, "c") for r in (before, now, rest)])
            pushes = pushes.groupBy("import_path").agg(F.sum("d").alias("d")).filter(F.abs("d") > TOLERANCE)
            steps.append(written(pushes, str(k)))
            self.moved.append(steps[-1].count())
        self.table.add(number, self._wide(steps))
        remove_folder(self.spark, folder)

    def weights(self) -> DataFrame:
        """(import_path, weight) as ``pagerank`` over the whole table gives it."""
        rows = self.table.sums().filter("c0 > 0.5")
        n = rows.agg(F.count("*")).scalar()
        total = reduce(lambda a, b: a + b, [F.col(c) for c in self.columns[:-1]])
        return rows.select("import_path", (F.lit(1 - self.damping) * total + F.col(self.columns[-1]) / n).alias("weight"))
