"""Every query with an oracle, on the smallest tables."""

import pytest

from compare import oracle_rows, plain, rows_of
from depweave.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert rows_of(df) == oracle_rows(duck, ORACLES[name])
    elif name == "crawl_batch":  # the same packages and links as the stream over the same checks; ranks are scaled integers
        rows = df.collect()
        got = sorted(str([plain(r[c]) for c in ("import_path", "links", "repository")]) for r in rows)
        assert got == oracle_rows(duck, ORACLES["crawl_stream"])[1]
        assert all(0 <= r["ranking"] < 10**4 and r["ranking"] == int(r["ranking"]) for r in rows) and len({r["ranking"] for r in rows}) > 3
    else:
        assert name in ("pagerank_scaled", "rank_diff_rows")  # held against SQL below


def test_scaled_rank_is_within_one_of_sql(spark, sf_dir, duck):
    from depweave.plans.catalog import RANKED

    want = dict(duck.sql(RANKED + "SELECT node, floor(10000 * w / (1 + (SELECT max(w) FROM r10))) FROM r10").fetchall())
    got = {r["import_path"]: r["ranking"] for r in QUERIES["pagerank_scaled"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1 for k in got)
    stored = {r["import_path"] for r in duck.sql(RANKED + "SELECT import_path FROM packages").to_df().to_dict("records")}
    rows = {r["import_path"]: (r["old"], r["new"]) for r in QUERIES["rank_diff_rows"](spark, sf_dir).collect()}
    assert all(old == 0 and new != 0 and abs(new - want[k]) <= 1 for k, (old, new) in rows.items())
    assert rows.keys() <= stored and all(k in rows for k in stored if want[k] >= 2)
