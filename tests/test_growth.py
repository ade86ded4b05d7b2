"""Steps that grew faster than their input."""

import pytest
from pyspark.sql import functions as F

from depweave.operators import status
from depweave.sources import buckets, derived, ingest


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_parted(spark, monkeypatch, most):
    monkeypatch.setattr(buckets, "BROADCAST_ROWS", most)
    rows = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("c", None), ("d", "r1")], "import_path string, repository string")
    own, other = buckets.parted(rows, spark.createDataFrame([("r1",), (None,)], "repository string"))
    assert sorted(r[0] for r in own.collect()) == ["a", "d"] and sorted(r[0] for r in other.collect()) == ["b", "c"]


def test_a_fold_on_a_state_reads_tables(spark):
    rows = spark.range(4).select(F.lit("r").alias("repository"), F.lit("").alias("tag"), F.lit("x").alias("ref"), F.lit("d").alias("digest"), F.lit(False).alias("failed"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
    out = status.fold(rows.filter("seq > 1"), status.fold(rows.filter("seq <= 1")))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 16
    assert out.first()["last_seq"] == 3


def test_packages_are_joined_by_numbers_of_rows(spark, sf_dir, tmp_path):
    """Files far below Spark's limit for broadcasts may hold very many rows; only tables of few rows go through the driver."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for name in ("supplier", "lineitem", "nation"):
        read(name).write.parquet(f"{tmp_path}/{name}.parquet")
    read("part").crossJoin(spark.range(600)).withColumn("p_partkey", F.col("p_partkey") + 100_000 * F.col("id")).drop("id").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    read("orders").crossJoin(spark.range(100)).withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000 * F.col("id")).drop("id").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    plan = derived.packages(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join [" in line]
    assert len(joined) == 5 and [line for line in joined if "BroadcastHashJoin" in line] == [line for line in joined if "[l_suppkey" in line]


def test_files_are_read_once(spark, monkeypatch):
    """Labels of module files come with the pass that cuts the source files; nothing else reads or makes the files again."""
    plans = []
    write = ingest.Rounds.write
    monkeypatch.setattr(ingest.Rounds, "write", lambda self, df, keep=False: plans.append(df) or write(self, df, keep))
    files = [("m", "https://h.io/m", "go.mod", "module m.io/mod\n"), ("m", "https://h.io/n", "sub/s.go", "package s\n"), ("m", "https://h.io/m", "two/a.go", "package a"), ("m", "https://h.io/m", "two/b.go", "package b"), ("m", "https://h.io/m", "two/go.mod", "module m.io/two"), ("m", "https://h.io/m", "two/in/c.go", "package c")]
    files = spark.createDataFrame(files, "repository string, remote string, repo_path string, content string")
    got = ingest.ingest_sources(files, prefixes=spark.createDataFrame([("m", "alias.io/m")], "repository string, prefix string"))
    assert sorted((r["import_path"], r["repository"]) for r in got.collect()) == [("m.io/mod/sub", "https://h.io/n"), ("m.io/two/in", "https://h.io/m")]
    reads = [df for df in [*plans, got] if "content#" in df._jdf.queryExecution().optimizedPlan().toString()]
    assert len(reads) == 1
