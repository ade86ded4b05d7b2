"""All pages at once against one page after the other."""

import random

import pytest

from depweave.operators import paging
from depweave.operators.paging import reverse_pages
from depweave.operators.reverse import reverse_page
from depweave.sources.scratch import Rounds

SCHEMA = "import_path string, repository string, directs array<string>, type int, ranking double"


@pytest.mark.parametrize("limit", [1, 3, 7, 1000])
def test_pages_equal_repeated_calls(spark, limit):
    rnd = random.Random(limit)
    rows = [(f"s{k:03d}", "r", [f"h.io/{rnd.choice('ab')}/{rnd.randrange(4)}" for _ in range(rnd.choice([0, 1, 1, 2, 5, 12]))], 2, 0.0) for k in range(60 if limit > 1 else 25)]
    packages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, key, page = [], "", 0
    while key is not None:
        found = reverse_page(packages, ["h.io/a/..."], limit, key).collect()
        if found:
            want += [(page, r["target"], r["source"]) for r in found]
            page += 1
        following = {r["next_page"] for r in found}
        key = following.pop() if following else None
    got = reverse_pages(packages, ["h.io/a/..."], limit)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert page > 1 or limit == 1000


def test_no_pages(spark):
    empty = spark.createDataFrame([("a", "r", ["x"], 2, 0.0)], SCHEMA)
    assert reverse_pages(empty, ["none/..."]).count() == 0
    with pytest.raises(ValueError):
        reverse_pages(empty, ["x"], 0)


def pages_of(rows, limit):
    """All pages by walking over the sources in order."""
    hits = {}
    for source, _, directs, *_ in rows:
        hits.setdefault(source, []).extend(t for t in directs if t.startswith("h.io/a/"))
    out, page, room = [], -1, 0
    for source in sorted(s for s in hits if s is not None and hits[s]):
        if page < 0 or len(hits[source]) > room:
            page, room = page + 1, limit
        out += [(page, t, source) for t in hits[source]]
        room -= len(hits[source])
    return sorted(out)


@pytest.mark.parametrize("limit, run", [(1, 4), (3, 5), (7, 3), (20, 2), (7, 1 << 16), (10000, 7)])
def test_pages_over_many_runs(spark, monkeypatch, limit, run):
    """Pages that end in the next run, span runs or are longer than all; sources of several rows and a null one."""
    monkeypatch.setattr(paging, "RUN_ROWS", run)
    rnd = random.Random(limit)
    rows = [(f"s{rnd.randrange(150):03d}", "r", [f"h.io/{rnd.choice('ab')}/{rnd.randrange(4)}" for _ in range(rnd.choice([0, 1, 1, 2, 5, 12]))], 2, 0.0) for _ in range(200)]
    rows.append((None, "r", ["h.io/a/1"], 2, 0.0))
    got = reverse_pages(spark.createDataFrame(rows, SCHEMA).repartition(5), ["h.io/a/..."], limit)
    assert sorted(map(tuple, got.collect())) == pages_of(rows, limit)


def test_rounds_do_not_grow_with_the_pages(spark, monkeypatch):
    """Pages of one run are followed by one call, not by joins of all rows."""
    written = []
    write = Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, df, keep=False: written.append(1) or write(self, df, keep))
    rows = [(f"s{k:04d}", "r", ["h.io/a/1"], 2, 0.0) for k in range(300)]
    got = reverse_pages(spark.createDataFrame(rows, SCHEMA), ["h.io/a/..."], 1)
    assert got.agg({"page": "max"}).first()[0] == 299
    assert len(written) <= 10
