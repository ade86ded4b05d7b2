"""Vocabulary and adjacency lists in ids against a plain walk over the records."""

import random

import pytest

from depweave.sources import export
from depweave.sources.scratch import Rounds

SCHEMA = "import_path string, directs array<string>"


def graph(spark, seed):
    rnd = random.Random(seed)
    names = [f"p{k:02d}" for k in range(40)]
    rows = [(n, [rnd.choice([*names, "q/x", "é", "z;\""]) for _ in range(rnd.choice([0, 1, 3, 9]))]) for n in names if rnd.random() < 0.8]
    rows += [(rows[1][0], ["only/second", rows[0][0]]), ("none", None), ("zz", ["zz", "zz"])]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_of_records(spark, seed):
    rows, packages = graph(spark, seed)
    places = sorted((r, pos, path) for r, directs in rows if directs is not None for pos, path in enumerate([r, *directs]))
    first = {}
    for r, pos, path in places:
        first.setdefault(path, (r, pos))
    # the second row of a repeated key may begin at the place of the first one's target: such ties may go either way
    got = {x["path"]: x["id"] for x in export.csv_vocabulary(packages).collect()}
    assert sorted(got.values()) == list(range(1, len(first) + 1))
    spots = [first[path] for path in sorted(got, key=got.get)]
    assert spots == sorted(spots)
    lines = {}
    for r, pos, path in places:
        lines.setdefault(r, []).append((pos, got[path]))
    want = sorted(";".join(str(i) for _, i in sorted(x)) for x in lines.values())
    assert sorted(x["value"] for x in export.csv_by_id(packages, spark.createDataFrame(list(got.items()), "path string, id long")).collect()) == want
    own = [x["value"] for x in export.csv_by_id(packages).collect()]
    assert sorted(len(x.split(";")) for x in own) == sorted(len(x.split(";")) for x in want)
    assert {x.split(";")[0] for x in own} == {x.split(";")[0] for x in want}


def test_records_go_by_numbers(spark, monkeypatch):
    """No aggregate sorts keys and positions of all places; lists are put together by the rows' numbers."""
    plans, write = [], Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, df, keep=False: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df, keep))
    packages = graph(spark, 1)[1]
    lists = export.csv_by_id(packages, export.csv_vocabulary(packages))
    plans.append(lists._jdf.queryExecution().executedPlan().toString())
    assert not any("SortAggregate" in p for p in plans)
    assert "xxhash64(path" in plans[-1]
