"""From import paths to repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, resolve_from_page, resolve_known_host
from ..sources.scratch import Rounds
from .stats import missing


def resolve(paths: DataFrame) -> DataFrame:
    """(import_path, repository, prefix, error) by well-known hosts."""
    return paths.withColumn("_r", resolve_known_host(F.col("import_path"))).select("import_path", "_r.repository", "_r.prefix", "_r.error")


def resolve_pages(pages: DataFrame) -> DataFrame:
    """(page_id, import_path, repository, prefix, error) from fetched pages (status, html)."""
    out = pages.withColumn("_r", resolve_from_page(F.col("status"), F.col("html")))
    return out.select("page_id", "import_path", "_r.repository", "_r.prefix", "_r.error")


def resolve_distinct(paths: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """(repository, prefix), one per repository, of paths not covered by a known prefix (at a slash)."""
    todo = paths.select("import_path").distinct()
    if prefixes is not None:
        above = todo.withColumn("prefix", F.explode(ancestors(F.col("import_path"))))
        covered = above.join(prefixes.select("prefix"), "prefix", "left_semi").select("import_path").distinct()
        todo = todo.join(covered, "import_path", "left_anti")
    found = resolve(todo).filter(F.col("repository").isNotNull())
    return found.groupBy("repository").agg(F.min("prefix").alias("prefix"))


def resolve_unknown(resolved: DataFrame, status: DataFrame) -> DataFrame:
    """Resolved repositories without a status row."""
    return resolved.join(status.select("repository"), "repository", "left_anti")


def crawl_frontier(packages: DataFrame, status: DataFrame) -> DataFrame:
    """Repositories to visit next: of missing packages, resolved, not known yet."""
    return resolve_unknown(resolve_distinct(missing(packages, domain_only=True)), status)


def nearest_label(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, label, anchor) of the closest labelled path above each, itself included; null where there is none."""
    above = paths.select("path").distinct().withColumn("anchor", F.explode(ancestors(F.col("path"))))
    hit = above.join(labels.select(F.col("path").alias("anchor"), "label"), "anchor")
    best = hit.groupBy("path").agg(F.max_by(F.struct("label", "anchor"), F.length("anchor")).alias("b"))
    return paths.select("path").distinct().join(best, "path", "left").select("path", "b.label", "b.anchor")


def _sweeper():
    """The sweep is made here so that it travels with its code: executors need no copy of this package."""

    def sweep(batches):
        """One pass over rows sorted by path, '/' first: the deepest open label above each path; labels are rows with a label.

        Labels that are not above a path are closed for good, since what they lead to has passed.  The first path of the
        task comes out as a row of its own.
        """
        import pyarrow as pa
        from pyspark import TaskContext

        part, open_, began = TaskContext.get().partitionId(), [], False
        schema = pa.schema([("path", pa.string()), ("label", pa.string()), ("anchor", pa.string()), ("part", pa.int32()), ("first", pa.bool_())])
        for batch in batches:
            rows = []
            for path, label in zip(batch.column("path").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if not began:
                    rows.append((path, None, None, part, True))
                    began = True
                while open_ and path != open_[-1][0] and not path.startswith(open_[-1][0] + "/"):
                    open_.pop()
                if label is not None:
                    open_.append((path, label))
                else:
                    anchor, above = open_[-1] if open_ else (None, None)
                    rows.append((path, above, anchor, part, False))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return sweep


def nearest_label_sorted(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """As ``nearest_label``, by one sort of paths and labels together instead of a row for each ancestor of each path.

    Both are range-partitioned by path, each folder before what lies in it, and swept once with a stack of open labels.  A
    path that no label of its own partition covers can only lie below one that is also above the partition's first
    path: these few, at most one for each level of that path, are looked up for each partition and joined by its number.
    Null labels label nothing; of several labels of one path the largest counts, as null paths get none.
    """
    marks = labels.filter("label is not null and path is not null").groupBy("path").agg(F.max("label").alias("label"))
    rows = marks.unionByName(paths.select("path").filter("path is not null").distinct().withColumn("label", F.lit(None).cast("string")))
    order = (F.translate("path", "/", "\1"), F.col("label").isNull())
    keyed = rows.select("path", "label", order[0].alias("_key"), order[1].alias("_late")).repartitionByRange("_key", "_late").sortWithinPartitions("_key", "_late")
    swept = keyed.select("path", "label").mapInArrow(_sweeper(), "path string, label string, anchor string, part int, first boolean")
    swept = Rounds(paths.sparkSession, "labels").write(swept, keep=True)
    above = swept.filter("first").select("part", F.explode(ancestors(F.col("path"))).alias("path")).join(marks, "path")
    carried = above.groupBy("part").agg(F.array_sort(F.collect_list(F.struct(F.length("path").alias("n"), "path", "label"))).alias("open"))
    found = swept.filter("not first").join(F.broadcast(carried), "part", "left")  # a row for each partition
    below = F.filter("open", lambda x: (F.col("path") == x["path"]) | F.col("path").startswith(F.concat(x["path"], F.lit("/"))))
    best = F.element_at(F.when(F.size(below) > 0, below), -1)
    local = F.col("anchor").isNotNull()
    out = found.select("path", F.when(local, F.col("label")).otherwise(best["label"]).alias("label"), F.when(local, F.col("anchor")).otherwise(best["path"]).alias("anchor"))
    none = paths.select("path").filter("path is null").distinct().withColumns({"label": F.lit(None).cast("string"), "anchor": F.lit(None).cast("string")})
    return out.unionByName(none)
