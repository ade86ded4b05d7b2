"""Missing packages, histograms, duplicates and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name, domain, has_domain
from ..sources.derived import edges


def missing(packages: DataFrame, domain_only: bool = False) -> DataFrame:
    """(import_path): targets that have no row of their own."""
    targets = packages.select(F.explode("directs").alias("import_path"))
    if domain_only:
        targets = targets.filter(has_domain(F.col("import_path")))
    return targets.distinct().join(packages.select("import_path"), "import_path", "left_anti")


def all_nodes(packages: DataFrame) -> DataFrame:
    """(import_path): rows and targets."""
    return packages.select("import_path").union(packages.select(F.explode("directs"))).distinct()


def graph_stats(packages: DataFrame) -> DataFrame:
    """One row: packages, edges, nodes with the link-only ones, and missing nodes."""
    own = packages.select("import_path", F.lit(1).alias("own"), F.size("directs").alias("links"))
    ends = packages.select(F.explode("directs").alias("import_path"), F.lit(0).alias("own"), F.lit(0).alias("links"))
    node = own.union(ends).groupBy("import_path").agg(F.max("own").alias("own"), F.sum("links").alias("links"))
    return node.agg(
        F.sum("own").cast("long").alias("packages"), F.sum("links").alias("edges"), F.count("*").alias("nodes"), F.count_if(F.col("own") == 0).alias("missing")
    )


def domain_totals(packages: DataFrame) -> DataFrame:
    """One row: packages, edges, and edges to targets without a domain."""
    plain = F.size(F.filter("directs", lambda t: ~has_domain(t)))
    return packages.agg(F.count("*").alias("packages"), F.sum(F.size("directs")).alias("edges"), F.sum(plain).alias("non_domain"))


def domain_histogram(packages: DataFrame) -> DataFrame:
    """Per target domain: edges, importing packages, the share of each in all, and edges per package."""
    hits = edges(packages).filter(has_domain(F.col("target"))).select("source", domain(F.col("target")).alias("domain"))
    # a package's edges to a domain first: the second step counts packages without a distinct
    per_package = hits.groupBy("domain", "source").agg(F.count("*").alias("n"))
    hist = per_package.groupBy("domain").agg(F.sum("n").alias("deps"), F.count("*").alias("pkgs"))
    totals = domain_totals(packages)
    deps, pkgs = totals.select("edges").scalar(), totals.select("packages").scalar()
    return hist.select(
        "domain", "deps", (100.0 * F.col("deps") / deps).alias("pct_deps"), "pkgs", (100.0 * F.col("pkgs") / pkgs).alias("pct_pkgs"),
        (F.col("deps") / F.col("pkgs")).alias("deps_per_pkg"),
    )


def domain_top(packages: DataFrame, limit: int, minimum: int = 0) -> DataFrame:
    """The histogram's largest domains, cut to ``limit`` first and then to those of ``minimum`` packages."""
    hist = domain_histogram(packages).orderBy(F.desc("deps"), "domain")
    return (hist.limit(limit) if limit > 0 else hist).filter(F.col("pkgs") >= minimum)


def duplicate_files(files: DataFrame) -> DataFrame:
    """(digest, file, repository, import_path) of files whose content is in more than one place.

    Digests are counted and joined back, so that no group is gathered, however large.
    """
    many = files.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    return files.join(many, "digest", "left_semi").select("digest", base_name(F.col("repo_path")).alias("file"), "repository", "import_path")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """(digest, locations, repositories) of every such content."""
    per_repo = files.groupBy("digest", "repository").agg(F.count("*").alias("n"))
    return per_repo.groupBy("digest").agg(F.sum("n").alias("locations"), F.count("*").alias("repositories")).filter("locations > 1")
