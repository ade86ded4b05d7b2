"""Reverse dependencies from an in-edge table that is kept up with the package table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.differences import Differences
from .reverse import SET_PATTERNS, matches

_EDGE = ("target", "source", "repository")


def _edges(rows: DataFrame, n: int) -> DataFrame:
    return rows.select(F.explode("directs").alias("target"), F.col("import_path").alias("source"), "repository", F.lit(n).cast("long").alias("n"))


def signed_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(target, source, repository, n): how often each edge comes (n > 0) or goes where ``old`` rows become ``new`` ones."""
    return _edges(old, -1).unionByName(_edges(new, 1)).groupBy(*_EDGE).agg(F.sum("n").alias("n")).filter("n <> 0")


class ReverseIndex:
    """(target, source, repository, n) range-sorted by target, kept by differences.

    A query filters the base and all differences by target, which reaches the files' row groups, and adds up what is left.
    """

    def __init__(self, spark: SparkSession, root: str, most: int | None = None):
        self.table = Differences(spark, root, _EDGE, "target", most)

    def build(self, packages: DataFrame) -> None:
        """Begin anew with the edges of a whole package table; one that a row lists twice is two rows, which readers add up."""
        self.table.build(_edges(packages, 1))

    def apply(self, number: int, old: DataFrame, new: DataFrame) -> None:
        """Note that batch ``number`` turns ``old`` rows into ``new`` ones; call it before the package table changes."""
        if not self.table.has(number):
            self.table.add(number, signed_edges(old, new))

    def edges(self, patterns: list[str] | None = None) -> DataFrame:
        """(target, source, repository, n) of the edges whose target matches any pattern; all of them without patterns.

        At most SET_PATTERNS patterns: they are predicates on the sorted tables.
        """
        if patterns is None:
            return self.table.sums().filter("n <> 0")
        if len(patterns) > SET_PATTERNS:
            raise ValueError(f"more than {SET_PATTERNS} patterns: use reverse()")
        return self.table.sums(lambda part: part.filter(matches(F.col("target"), patterns))).filter("n <> 0")

    def reverse(self, patterns: list[str]) -> DataFrame:
        """(target, source) as ``reverse`` gives them: an edge that a row lists twice appears twice."""
        return self.edges(patterns).select("target", "source", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k")).drop("k")

    def count(self, patterns: list[str]) -> DataFrame:
        """(num_imports): the number of these edges."""
        return self.edges(patterns).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("num_imports"))
