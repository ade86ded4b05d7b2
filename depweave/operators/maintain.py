"""Changes to the package and status tables, as functions from table to table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import fix_repo_url


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key within a batch; ``order`` is dropped."""
    value = F.struct(*[c for c in rows.columns if c not in (key, order)])
    return rows.groupBy(key).agg(F.max_by(value, F.col(order)).alias("_v")).select(key, "_v.*")


def one_per_key(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """The batch's rows, one of each key: the last by ``order``, or, without it, an error where a key is repeated."""
    if order is not None:
        return last_per_key(rows, key, order)
    value = F.struct(*[c for c in rows.columns if c != key])
    one = rows.groupBy(key).agg(F.first(value).alias("_v"), F.count("*").alias("_n"))
    repeated = F.raise_error(F.concat(F.lit(f"{key} is repeated in a batch without an order: "), F.col(key).cast("string")))
    return one.select(key, F.when(F.col("_n") == 1, F.col("_v")).otherwise(repeated).alias("_v")).select(key, "_v.*").select(*rows.columns)


def upsert(current: DataFrame, new: DataFrame, key: str = "import_path", order: str | None = None) -> DataFrame:
    """Replace by key; rows of the same repository that the batch does not name stay.

    The last write wins: of a batch's rows of one key, the one with the largest ``order`` (a column of the batch, which
    the result does not have) is stored.  Without an order no key may be repeated: computing the result fails then.
    """
    new = one_per_key(new, key, order).select(*current.columns)
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_reset(current: DataFrame, new: DataFrame, repository: str = "repository", order: str | None = None) -> DataFrame:
    """Remove every row of the batch's repositories first, then upsert."""
    kept = current.join(new.select(repository).distinct(), repository, "left_anti").select(*current.columns)
    return upsert(kept, new, order=order)


def remove_packages(packages: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining, removed) for a table of import paths; unknown ones are ignored."""
    keys = paths.select("import_path").distinct()
    return packages.join(keys, "import_path", "left_anti"), packages.join(keys, "import_path", "left_semi")


def remove_repositories(status: DataFrame, packages: DataFrame, urls: DataFrame, keep_packages: bool = False) -> tuple[DataFrame, DataFrame]:
    """(status, packages) without the repositories of the URLs (column url), all tags.

    Packages go with the repositories that were really in the status table, unless they are to be kept.
    """
    keys = urls.select(fix_repo_url(F.col("url")).alias("repository")).distinct()
    gone = status.join(keys, "repository", "left_semi").select("repository").distinct()
    left = status.join(keys, "repository", "left_anti")
    return left, packages if keep_packages else packages.join(gone, "repository", "left_anti").select(*packages.columns)


def update_where(packages: DataFrame, values: DataFrame, changed: Column, column: str, new: str = "new") -> DataFrame:
    """Set ``column`` from ``values`` (import_path and the column that ``new`` names) in the rows for which ``changed`` holds."""
    if new in packages.columns:
        raise ValueError(f"packages have a column {new!r}; give the new values another name")
    joined = packages.join(values, "import_path", "left")
    return joined.withColumn(column, F.when(F.coalesce(changed, F.lit(False)), F.col(new)).otherwise(F.col(column))).select(*packages.columns)


def apply_ranks(packages: DataFrame, ranks: DataFrame) -> DataFrame:
    """Write new rankings back where they differ from the stored ones."""
    new = ranks.select("import_path", F.col("ranking").alias("_new_ranking"))
    changed = F.col("_new_ranking").isNotNull() & ~F.col("_new_ranking").eqNullSafe(F.col("ranking"))
    return update_where(packages, new, changed, "ranking", "_new_ranking")
