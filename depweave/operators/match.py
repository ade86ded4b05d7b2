"""Lookups, scans and pattern matches over the package table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.paths import fix_repo_url, matches

PAGE_SIZE = 100


def lookup(packages: DataFrame, path: str) -> DataFrame:
    return packages.filter(F.col("import_path") == path)


def lookup_one(packages: DataFrame, path: str) -> Row:
    """The row of exactly this key; KeyError if there is none."""
    row = lookup(packages, path).first()
    if row is None:
        raise KeyError(path)
    return row


def scan_from(packages: DataFrame, start: str = "") -> DataFrame:
    """Rows from a key on, in key order."""
    return packages.filter(F.col("import_path") >= start).orderBy("import_path")


def match(packages: DataFrame, package: str = "", repository: str = "", start: str = "", include_files: bool = False, include_directs: bool = True) -> DataFrame:
    """Rows of a package pattern and a repository, from a start key on; columns left out are never read."""
    out = packages.filter(matches(F.col("import_path"), package))
    if repository:
        out = out.filter(F.col("repository") == fix_repo_url(F.lit(repository)))
    if start:
        out = out.filter(F.col("import_path") >= start)
    drop = [c for c, keep in (("source_files", include_files), ("directs", include_directs)) if not keep]
    return out.drop(*drop)


def match_count(packages: DataFrame, **args) -> DataFrame:
    """Number of matching rows; any limit is ignored."""
    return match(packages, **args).agg(F.count("*").alias("num_rows"))


def match_page(packages: DataFrame, limit: int = PAGE_SIZE, page_key: str = "", **args) -> DataFrame:
    """At most ``limit`` rows in key order from ``page_key``, each with the page's next key (null on the last page)."""
    limit = limit if limit > 0 else PAGE_SIZE
    found = match(packages, **(args | {"start": page_key or args.get("start", "")})).orderBy("import_path").limit(limit + 1)
    # the page and one row more: a bounded result, so that one window partition is enough
    from pyspark.sql import Window

    order = Window.orderBy("import_path")
    ranked = found.withColumn("_n", F.row_number().over(order))
    ranked = ranked.withColumn("next_page", F.max(F.when(F.col("_n") == limit + 1, F.col("import_path"))).over(Window.partitionBy(F.lit(0))))
    return ranked.filter(F.col("_n") <= limit).drop("_n")


def match_limit(packages: DataFrame, limit: int = 0, **args) -> DataFrame:
    """All pages one after the other, cut at ``limit`` rows (0: no limit)."""
    out = match(packages, **args).orderBy("import_path")
    return out.limit(limit) if limit > 0 else out


def match_importers(packages: DataFrame, predicate) -> DataFrame:
    """(import_path, target): for each importer its first direct, in order, that satisfies the predicate."""
    hits = F.filter("directs", predicate)
    return packages.filter(F.size(hits) > 0).select("import_path", F.element_at(hits, 1).alias("target"))
