"""Partial rewrites of the package table and the index of reverse dependencies against whole recomputation."""

import os
import random

import pytest

from depweave.operators import reverse_index
from depweave.operators.maintain import upsert, upsert_reset
from depweave.operators.rank import pagerank
from depweave.operators.rank_updates import RankState
from depweave.operators.reverse import reverse
from depweave.sources.buckets import Buckets
from depweave.sources.scratch import new_folder

SCHEMA = "import_path string, repository string, directs array<string>, type int, ranking double"


def plain(df):
    return sorted(map(str, df.collect()))


def files(table):
    root = table.root.removeprefix("file:").replace("//", "/")
    return {d: sorted(f for f in os.listdir(f"{root}/{d}") if f.endswith(".parquet")) for d in os.listdir(root) if d.startswith("bucket=")}


def rows(rnd, n, repos=30):
    out = {}
    for _ in range(n):
        path = f"h.io/{rnd.choice('abc')}{rnd.randrange(60)}"
        out[path] = (path, f"https://r{rnd.randrange(repos)}", [f"h.io/{rnd.choice('abc')}{rnd.randrange(60)}" for _ in range(rnd.randrange(5))], 2, 0.0)
    return list(out.values())


@pytest.mark.parametrize("reset", [False, True])
def test_batches_rewrite_what_they_touch(spark, reset):
    rnd = random.Random(3)
    table = Buckets(spark, f"{new_folder(spark, 'buckets')}/t", 16)
    want = spark.createDataFrame(rows(rnd, 150), SCHEMA)
    table.create(want)
    assert plain(table.read()) == plain(want)
    for _ in range(3):
        batch = spark.createDataFrame(rows(rnd, 3), SCHEMA)
        want = spark.createDataFrame((upsert_reset if reset else upsert)(want, batch).collect(), SCHEMA)
        before, touched = files(table), table.touched(batch)
        assert table.apply(batch, reset) == touched and len(touched) < 16
        after = files(table)
        assert plain(table.read()) == plain(want)
        names = {f"bucket={b}" for b in touched}
        assert {d: f for d, f in before.items() if d not in names} == {d: f for d, f in after.items() if d not in names}
        table.apply(batch, reset)  # delivered again
        assert plain(table.read()) == plain(want)


def test_a_bucket_whose_rows_all_move_is_emptied(spark):
    table = Buckets(spark, f"{new_folder(spark, 'buckets')}/t", 50)
    table.create(spark.createDataFrame([("a", "r1", [], 2, 0.0), ("b", "r2", [], 2, 0.0)], SCHEMA))
    table.apply(spark.createDataFrame([("a", "r2", ["x"], 2, 0.0)], SCHEMA))
    assert plain(table.read().select("import_path", "repository")) == plain(spark.createDataFrame([("a", "r2"), ("b", "r2")], "import_path string, repository string"))
    assert table.apply(spark.createDataFrame([], SCHEMA)) == []


def test_the_index_equals_a_rebuild(spark):
    rnd, root = random.Random(8), new_folder(spark, "index")
    table, index = Buckets(spark, f"{root}/t", 8), reverse_index.ReverseIndex(spark, f"{root}/i", most=2)
    table.create(spark.createDataFrame(rows(rnd, 80), SCHEMA))
    index.build(table.read())
    patterns = ["h.io/a1/...", "h.io/b7", "h.io/c..."]
    for number in range(4):
        batch = spark.createDataFrame(rows(rnd, 4), SCHEMA)
        old = table.replaced(batch)
        index.apply(number, old, batch)
        index.apply(number, old, batch.limit(0))  # a repeated delivery changes nothing
        table.apply(batch, reset=True)
        now = table.read()
        fresh = reverse_index.signed_edges(now.limit(0), now)
        assert plain(index.edges()) == plain(fresh)
        for some in (patterns, ["h.io/a12"], ["none/..."]):
            assert plain(index.reverse(some)) == plain(reverse(now, some))
            assert index.count(some).first()[0] == reverse(now, some).count()
    assert index.table.upto >= 2 and len(index.table.numbers()) <= 2


def test_a_prefix_reaches_the_index_files(spark):
    root = new_folder(spark, "index")
    index = reverse_index.ReverseIndex(spark, root)
    packages = spark.createDataFrame(rows(random.Random(1), 60), SCHEMA)
    index.build(packages)
    index.apply(0, packages.limit(1), packages.limit(0))
    plan = index.reverse(["h.io/a1/..."])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StringStartsWith(target,h.io/a1/)") >= 2  # the base's scan and the difference's
    with pytest.raises(ValueError):
        index.edges(["x"] * 2000)


def far(spark, got, want):
    """The largest difference of two tables of weights over the same nodes."""
    a, b = ({r["import_path"]: r["weight"] for r in t.collect()} for t in (got, want))
    assert a.keys() == b.keys()
    return max(abs(a[k] - b[k]) for k in a)


def test_ranks_follow_changes(spark):
    """After random updates the weights are those of a full run; nodes come and go, and a repeated delivery changes nothing."""
    rnd, root = random.Random(4), new_folder(spark, "ranks")
    table, state = Buckets(spark, f"{root}/t", 8), RankState(spark, f"{root}/r", rounds=4, most=2)
    table.create(spark.createDataFrame(rows(rnd, 70), SCHEMA))
    state.build(table.read())
    assert far(spark, state.weights(), pagerank(table.read(), 4)) < 1e-9
    for number in range(3):
        batch = spark.createDataFrame([*rows(rnd, 4), (f"h.io/new{number}", "https://r1", [f"h.io/leaf{number}", f"h.io/leaf{number}", "h.io/a1"], 2, 0.0)], SCHEMA)
        old = spark.createDataFrame(table.replaced(batch).collect(), SCHEMA)
        table.apply(batch, reset=True)
        state.update(number, old, batch, table.read())
        state.update(number, old, batch, table.read())
        assert far(spark, state.weights(), pagerank(table.read(), 4)) < 1e-9


def test_a_small_change_moves_few_nodes(spark):
    """In many separate chains, a change of one row reaches its own chain only."""
    root = new_folder(spark, "ranks")
    chain = [(f"c{k}/n{i}", f"r{k}", [f"c{k}/n{i + 1}"], 2, 0.0) for k in range(60) for i in range(5)]
    packages = spark.createDataFrame(chain, SCHEMA)
    state = RankState(spark, root, rounds=4)
    state.build(packages)
    old, new = packages.filter("import_path = 'c7/n1'"), spark.createDataFrame([("c7/n1", "r7", ["c7/n4"], 2, 0.0)], SCHEMA)
    now = packages.filter("import_path <> 'c7/n1'").unionByName(new)
    state.update(0, old, new, now)
    assert max(state.moved) <= 6
    assert far(spark, state.weights(), pagerank(now, 4)) < 1e-9
