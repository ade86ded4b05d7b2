"""Reverse dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, source_filter
from ..sources.derived import edges
from ..sources.scratch import Rounds

INLINE_PATTERNS = 100  # longer lists are looked up in a set, along the path
SET_PATTERNS = 1000  # longer ones become a join
PAGE_SIZE = 100


def _split(patterns: list[str]) -> tuple[list[str], list[str]]:
    """Exact paths, and the roots of subtree patterns (which count as exact paths too)."""
    roots = [p[:-4] for p in patterns if p.endswith("/...") and len(p) > 4]
    return [p for p in patterns if not (p.endswith("/...") and len(p) > 4)] + roots, roots


def matches(target, patterns: list[str]):
    """Whether a target matches any pattern, as a predicate that reaches files sorted by target."""
    exact, roots = _split(patterns)
    out = target.isin(exact)
    if len(patterns) > INLINE_PATTERNS:
        return out | F.exists(ancestors(target), lambda a: a.isin(roots) & (a != target) & (F.length(target) > F.length(a) + 1))
    for r in roots:
        out = out | (target.startswith(r + "/") & (target != r + "/"))
    return out


def reverse(packages: DataFrame, patterns: list[str], other_repository: bool = False, matching: str = "", complete: bool = False) -> DataFrame:
    """(target, source) edges whose target matches any pattern; duplicate directs count each.

    ``other_repository`` drops edges within one repository (a missing target's is unknown: kept).
    ``matching`` filters sources by regular expression.  ``complete`` adds the importing row's columns.
    A short list is a predicate, one of up to SET_PATTERNS a lookup of the target and its ancestors in sets; a longer
    one is an equi-join of the distinct targets, written once, with paths and of their ancestors with subtree
    roots, instead of a nested loop.  An empty list gives no rows.
    """
    carried = [c for c in packages.columns if c not in ("import_path", "source_files")] if complete else (["repository"] if other_repository else [])
    rows = packages
    if matching:
        rows = rows.filter(source_filter(F.col("import_path"), matching))
    found = rows.select(F.explode("directs").alias("target"), F.col("import_path").alias("source"), *carried)
    if len(patterns) <= SET_PATTERNS:
        found = found.filter(matches(F.col("target"), patterns))
    else:
        spark = packages.sparkSession
        exact, roots = _split(patterns)
        wanted = spark.createDataFrame([(p, False) for p in set(exact)] + [(r, True) for r in set(roots)], "key string, subtree boolean")
        found = Rounds(spark, "reverse").write(found, keep=True)  # read for its targets and for its edges
        targets = found.select("target").distinct()
        keys = targets.withColumn("key", F.explode(ancestors(F.col("target"))))
        whole = F.col("key") == F.col("target")
        below = F.col("subtree") & ~whole & (F.length("target") > F.length("key") + 1)
        hit = keys.join(wanted, "key").filter(~F.col("subtree") & whole | below).select("target").distinct()
        found = found.join(hit, "target", "left_semi")
    if other_repository:
        owners = packages.select(F.col("import_path").alias("target"), F.col("repository").alias("_owner"))
        found = found.join(owners, "target", "left").filter(~F.coalesce(F.col("_owner") == F.col("repository"), F.lit(False))).drop("_owner")
        if not complete:
            found = found.drop("repository")
    return found


def hits_by_row(packages: DataFrame, patterns: list[str], matching: str = "", **args) -> DataFrame:
    """(source, targets) of the rows with edges after the filters, several rows for a source that has several."""
    if len(patterns) <= SET_PATTERNS and not args.get("other_repository"):  # a row's hits lie in the row
        rows = packages.filter(source_filter(F.col("import_path"), matching)) if matching else packages
        found = rows.select(F.col("import_path").alias("source"), F.filter("directs", lambda t: matches(t, patterns)).alias("targets"))
        return found.filter(F.size("targets") > 0)
    found = reverse(packages, patterns, matching=matching, **args)
    return found.groupBy("source").agg(F.collect_list("target").alias("targets"))  # part of the row's own array


def reverse_count(packages: DataFrame, patterns: list[str], start: str = "", **args) -> DataFrame:
    """Number of edges after the filters, from a source key on."""
    return reverse(packages.filter(F.col("import_path") >= start), patterns, **args).agg(F.count("*").alias("num_imports"))


def reverse_page(packages: DataFrame, patterns: list[str], limit: int = PAGE_SIZE, page_key: str = "", matching: str = "", **args) -> DataFrame:
    """A page of whole rows' edges, in source order: (target, source, next_page).

    Rows are taken while the edges fit in ``limit``; the first row with any is taken whatever its number.
    ``next_page`` is the first row left out; where the first row alone was too large, the next row that
    passes ``matching``, with edges or not.
    """
    rows = packages.filter(F.col("import_path") >= page_key)
    passing = rows.filter(source_filter(F.col("import_path"), matching)) if matching else rows
    per_row = hits_by_row(rows, patterns, matching, **args)
    # every row with hits adds at least one, so limit + 1 rows decide the page
    top = Rounds(packages.sparkSession, "reverse-page").write(per_row.orderBy("source").limit(limit + 1), keep=True)
    order = Window.orderBy("source")
    hits = top.withColumn("run", F.sum(F.size("targets")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order))
    first = hits.orderBy("n").first()
    if first is None:
        return top.select(F.lit("").alias("target"), "source", F.lit("").alias("next_page")).filter("false")
    if first["run"] > limit:
        next_page = passing.filter(F.col("import_path") > first["source"]).agg(F.min("import_path"))
    else:
        next_page = hits.filter(F.col("run") > limit).agg(F.min("source"))
    taken = hits.filter((F.col("run") <= limit) | (F.col("n") == 1))
    return taken.select(F.explode("targets").alias("target"), "source").withColumn("next_page", next_page.scalar())


def affected(packages: DataFrame, patterns: list[str], other_repository: bool = True) -> DataFrame:
    """(repository, packages): per importing repository, the distinct packages that import a target, sorted.

    A repository is one row; ``affected_edges`` gathers nothing.
    """
    found = reverse(packages, patterns, other_repository=other_repository, complete=True)
    return found.groupBy("repository").agg(F.array_sort(F.collect_set("source")).alias("packages"))


def affected_edges(packages: DataFrame, patterns: list[str], other_repository: bool = True) -> DataFrame:
    """(repository, package), distinct: the flat form of ``affected``, for repositories of any size; sort it where it is written."""
    found = reverse(packages, patterns, other_repository=other_repository, complete=True)
    return found.select("repository", F.col("source").alias("package")).distinct()


def affected_targets(packages: DataFrame, patterns: list[str], other_repository: bool = True) -> DataFrame:
    return reverse(packages, patterns, other_repository=other_repository).select("target").distinct()


def affected_by_repository_edges(packages: DataFrame, repository: str) -> DataFrame:
    """(repository, package), distinct: importers elsewhere of any of a repository's packages; nothing is gathered."""
    own = packages.filter(F.col("repository") == repository).select(F.col("import_path").alias("target"))
    found = packages.filter(F.col("repository") != repository).select("repository", F.col("import_path").alias("package"), F.explode("directs").alias("target"))
    return found.join(own, "target", "left_semi").select("repository", "package").distinct()


def affected_by_repository(packages: DataFrame, repository: str) -> DataFrame:
    """Impact of a repository: importers of any of its packages elsewhere, by repository, a row for each; the flat form gathers nothing."""
    found = affected_by_repository_edges(packages, repository)
    return found.groupBy("repository").agg(F.array_sort(F.collect_set("package")).alias("packages"))


__all__ = ["affected", "affected_by_repository", "affected_by_repository_edges", "affected_edges", "affected_targets", "edges", "matches", "reverse", "reverse_count", "reverse_page"]
