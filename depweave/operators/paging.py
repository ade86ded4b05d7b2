"""All pages of reverse dependencies in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.order import numbered
from ..sources.scratch import Rounds
from .reverse import PAGE_SIZE, hits_by_row

_WITHIN = (1 << 33) - 1

#: Rows, about, whose pages are followed by one call, and read at once by its task.
RUN_ROWS = 1 << 16


def _placed(rows: DataFrame, *by: str) -> DataFrame:
    """Rows in range partitions, sorted: part is the partition, at the place in it."""
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id())
    return rows.withColumns({"part": F.shiftright("m", 33), "at": F.col("m").bitwiseAND(_WITHIN)}).drop("m")


def _carried(rows: DataFrame, column: str) -> DataFrame:
    """Fills a column that grows along the order with its last value before, from earlier partitions too."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    before = rows.groupBy("part").agg(F.max(column).alias("_m")).select("part", F.max("_m").over(ahead).alias("_carry"))
    own = F.last(column, ignorenulls=True).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(column, own).join(F.broadcast(before), "part").withColumn(column, F.coalesce(column, "_carry")).drop("_carry")


def _follower(limit: int, numbering: bool):
    """A function over the rows of a run, given as a table of n and c, the number of a row's edges.

    It gives each beginning by which pages may enter the run (the edges before it), with the edges before the end of the last page
    that begins here, and the number of these pages; with ``numbering``, the page of each row, from the run's own
    beginning and first page in the columns entry and page.
    """

    def follow(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("n")
        n, c = table["n"].to_numpy(), table["c"].to_numpy()
        ends = np.cumsum(c)
        sums, rows, total = ends - c, len(c), int(ends[-1])
        # the last row whose edges begin within the page is cut off by it, or is a first row that is too large alone
        reach = np.searchsorted(sums, sums + limit, side="right") - 1
        following = np.where(sums + limit < total, np.maximum(reach, np.arange(rows) + 1), rows)
        if numbering:
            entry, page = table["entry"][0].as_py(), table["page"][0].as_py()
            begins = np.zeros(rows, "int64")
            at = rows if entry is None else int(np.searchsorted(sums, entry))
            while at < rows:
                begins[at] = 1
                at = int(following[at])
            return pa.table({"n": n, "page": page - 1 + np.cumsum(begins)})
        to, count, after = np.append(following, rows), np.append(np.ones(rows, "int64"), 0), np.append(np.maximum(sums + limit, total), 0)
        while (to[:-1] < rows).any():  # pointer jumping; a row's after holds once it points behind the run
            after, count, to = np.where(to < rows, after[to], after), count + count[to], to[to]
        into = int(np.searchsorted(sums, limit))  # a page leaves the run before with fewer than limit edges of this one
        return pa.table({"run": pa.repeat(table["run"][0], into), "entry": sums[:into], "after": after[:into], "pages": count[:into]})

    return follow


def reverse_pages(packages: DataFrame, patterns: list[str], limit: int = PAGE_SIZE, **args) -> DataFrame:
    """(page, target, source): the edges of all pages, numbered from 0, as ``reverse_page`` would give them one after the other.

    Rows with their hits are sorted by source once, and go by their numbers from there.  They are taken in runs of some RUN_ROWS,
    each by one call that holds two numbers of a row: a page that begins in an earlier run ends among the first
    ``limit`` edges of the one it ends in, so that for each of these few beginnings the call tells how many pages begin in the
    run and where the last one ends.  Where that is, is a lookup among the beginnings, by one sort of both; pointer jumping
    over them, in as many rounds as the number of runs has bits, finds those that are met, and a second
    call numbers the pages of each run.  No window spans all rows.
    """
    if limit < 1:
        raise ValueError(f"limit {limit} is not positive")
    spark = packages.sparkSession
    rounds = Rounds(spark, "reverse-pages")
    hits = rounds.write(hits_by_row(packages, patterns, **args).filter("source is not null"), keep=True)
    found = numbered(hits, "source", rounds, ties=True)
    run = F.floor(F.col("n") / RUN_ROWS).cast("long")
    rows = rounds.write(found.groupBy("n").agg(F.sum(F.size("targets")).cast("long").alias("c")).withColumn("run", run), keep=True)
    ahead = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # over one row per run
    runs = rounds.write(rows.groupBy("run").agg(F.sum("c").alias("edges")).select("run", "edges", F.coalesce(F.sum("edges").over(ahead), F.lit(0)).alias("start")), keep=True)
    edges = runs.agg(F.coalesce(F.sum("edges"), F.lit(0))).first()[0]

    entries = rows.groupBy("run").applyInArrow(_follower(limit, False), "run long, entry long, after long, pages long").join(F.broadcast(runs), "run")
    entries = rounds.write(entries.select("run", "entry", (F.col("start") + F.col("entry")).alias("i"), (F.col("start") + F.col("after")).alias("after"), "pages"), keep=True)
    nothing = F.lit(None).cast("long")
    sums = entries.select(F.col("i").alias("value"), F.lit(0).alias("kind"), F.col("i").alias("j"), nothing.alias("i"), nothing.alias("pages"))
    ends = entries.select(F.col("after").alias("value"), F.lit(1).alias("kind"), nothing.alias("j"), "i", "pages")
    sorted_ = rounds.write(_placed(sums.unionByName(ends), "value", "kind"), keep=True)
    jump = rounds.write(_carried(sorted_, "j").filter("kind = 1").filter(F.col("value") < edges).select("i", F.col("j").alias("next"), "pages"), keep=True)
    met = spark.range(1 if edges else 0).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("page"))
    while True:
        more = rounds.write(met.join(jump, "i").select(F.col("next").alias("i"), (F.col("page") + F.col("pages")).alias("page")), keep=True)
        if more.isEmpty():
            break
        met = rounds.write(met.unionByName(more), keep=True)
        far = jump.select(F.col("i").alias("next"), F.col("next").alias("then"), F.col("pages").alias("more"))
        jump = rounds.write(jump.join(far, "next").select("i", F.col("then").alias("next"), (F.col("pages") + F.col("more")).alias("pages")), keep=True)
    met = entries.join(met, "i").select("run", "entry", "page", (F.col("page") + F.col("pages")).alias("after"))
    # a run without a beginning of its own lies within the last page before
    known = runs.join(met, "run", "left").select("run", "entry", F.coalesce("page", F.max("after").over(ahead)).alias("page"))
    known = rounds.write(known, keep=True)
    pages = rows.join(F.broadcast(known), "run").groupBy("run").applyInArrow(_follower(limit, True), "n long, page long")
    return found.join(pages, "n").select("page", F.explode("targets").alias("target"), "source")
