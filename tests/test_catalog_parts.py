"""Registered queries gather no group into one row."""

from depweave.plans import catalog
from depweave.sources import derived


def test_files_of_a_package_are_written_in_parts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "PART_ROWS", 10)
    files = derived.source_files(spark, sf_dir)
    rows = catalog.with_files(files).selectExpr("size(source_files) AS n").collect()
    assert sum(r["n"] for r in rows) == files.count()
    assert max(r["n"] for r in rows) <= 20
    total = sum(r["files"] for r in catalog.QUERIES["rows_json"](spark, sf_dir).collect())
    assert total == files.count()


def test_file_quads_gather_nothing(spark, sf_dir):
    plan = catalog.QUERIES["rdf_files"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
