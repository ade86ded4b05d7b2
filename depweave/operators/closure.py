"""Transitive dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import STDLIB, matches
from ..sources.scratch import Rounds


BROADCAST_ROWS = 100_000  # paths of a frontier are broadcast up to this many, joined by a shuffle beyond
MERGE_ROUNDS = 8


def closure(packages: DataFrame, roots: list[str], skip_stdlib: bool = False) -> DataFrame:
    """(import_path) of the rows that the roots (patterns allowed) lead to, the roots included.

    A frontier is joined with the edges and freed from what was visited, round by round; cycles end
    there. Targets without a row are not part of the result. ``skip_stdlib`` leaves standard-library rows
    out of the result, though paths through them count.

    Keys, types and edges are written once, without the other columns, so that a round reads a slim table
    however the packages came about.  A frontier of few rows is broadcast: then a round shuffles the targets
    it reached and nothing else.  What was visited is written anew every MERGE_ROUNDS rounds, so that a round of a deep
    graph reads few tables.
    """
    rounds = Rounds(packages.sparkSession, "closure")
    start = F.lit(False)
    for r in roots:
        start = start | matches(F.col("import_path"), r)
    rows = rounds.write(packages.select("import_path", "type", "directs"), keep=True)
    nodes = rows.select("import_path")
    frontier = rounds.write(rows.filter(start).select("import_path"), keep=True)
    visited, parts = frontier, 1
    while count := frontier.count():
        step = F.broadcast(frontier) if count <= BROADCAST_ROWS else frontier
        reached = rows.join(step, "import_path", "left_semi").select(F.explode("directs").alias("import_path")).distinct()
        reached = rounds.write(reached, keep=True)
        some = F.broadcast(reached) if reached.count() <= BROADCAST_ROWS else reached
        fresh = nodes.join(some, "import_path", "left_semi").join(visited, "import_path", "left_anti")
        frontier = rounds.write(fresh, keep=True)
        visited, parts = visited.union(frontier), parts + 1
        if parts == MERGE_ROUNDS:
            visited, parts = rounds.write(visited, keep=True), 1
    if skip_stdlib:
        visited = rows.filter(F.col("type") != STDLIB).select("import_path").join(visited, "import_path", "left_semi")
    return visited


WORD = 64  # root sets that one number stands for


def _numbered(roots: DataFrame, rounds: Rounds) -> DataFrame:
    """(root, word, bit): distinct root sets, numbered by range partitions and one count per partition."""
    placed = roots.select("root").distinct().repartitionByRange("root").sortWithinPartitions("root").withColumn("m", F.monotonically_increasing_id())
    placed = rounds.write(placed, keep=True).withColumn("part", F.shiftright("m", 33))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    number = F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), "part").select("root", F.floor(number / WORD).alias("word"), (number % WORD).cast("int").alias("bit"))


def closures(packages: DataFrame, roots: DataFrame, skip_stdlib: bool = False) -> DataFrame:
    """(root, import_path): the closure of every root set of ``roots`` (root, import_path), all in one search.

    Which sets have reached a row is a bitmap, a number for every WORD sets; a round carries the new bits along the
    edges, joined by ``bit_or`` (combined before the shuffle), and keeps those that the row had not.  So the jobs depend
    on the depth of the graph only, not on the number of sets, and sets that meet travel on together.  Root
    paths without a row lead nowhere; null ones are ignored.  Rows that are neither a root nor a target can't be reached:
    they are left out before the rounds.
    """
    rounds = Rounds(packages.sparkSession, "closures")
    ends = packages.select(F.explode("directs").alias("import_path")).unionByName(roots.select("import_path")).distinct()
    rows = rounds.write(packages.select("import_path", "type", "directs").join(ends, "import_path", "left_semi"), keep=True)
    numbers = rounds.write(_numbered(roots, rounds), keep=True)
    few = F.broadcast(numbers) if numbers.count() <= BROADCAST_ROWS else numbers
    bit = F.expr("shiftleft(1L, bit)")
    start = roots.join(few, "root").join(rows.select("import_path"), "import_path", "left_semi").groupBy("import_path", "word").agg(F.bit_or(bit).alias("fresh"))
    state = rounds.write(start.select("import_path", "word", F.col("fresh").alias("bits"), "fresh"))
    while not (frontier := state.filter("fresh <> 0")).isEmpty():
        carried = rows.join(frontier.select("import_path", "word", "fresh"), "import_path").select(F.explode("directs").alias("import_path"), "word", "fresh")
        reached = carried.groupBy("import_path", "word").agg(F.bit_or("fresh").alias("got")).join(rows.select("import_path"), "import_path", "left_semi")
        both = state.select("import_path", "word", "bits").join(reached, ["import_path", "word"], "full")
        had, got = F.coalesce("bits", F.lit(0)), F.coalesce("got", F.lit(0))
        state = rounds.write(both.select("import_path", "word", had.bitwiseOR(got).alias("bits"), got.bitwiseAND(F.bitwise_not(had)).alias("fresh")))
    if skip_stdlib:
        state = rows.filter(F.col("type") != STDLIB).select("import_path").join(state, "import_path")
    sets = state.select("import_path", "word", F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit("bits", k) == 1)).alias("bit"))
    return sets.join(few, ["word", "bit"]).select("root", "import_path")
