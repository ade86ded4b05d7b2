"""The status fold on the hand-worked feed, and as a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from depweave.operators import status as S
from depweave.sources.scratch import Snapshots, shared_dir
from depweave.streaming import status_stream

T0 = dt.datetime(2024, 1, 1)
OBS = status_stream.OBSERVATION


def minute(m):
    return T0 + dt.timedelta(minutes=m)


FEED = [(0, "d1"), (10, "d1"), (20, None), (30, "d2"), (50, "d3")]


def feed(spark, rows=FEED, repo="https://r", ref="refs/heads/master"):
    return spark.createDataFrame([(repo, "", ref, d, d is None, minute(m), k) for k, (m, d) in enumerate(rows)], OBS)


def test_needs_update(spark):
    assert [r["needs_update"] for r in S.needs_update(feed(spark)).orderBy("seq").collect()] == [True, False, True, True]


def test_fold(spark):
    row = S.fold(feed(spark)).first()
    assert (row["digest"], row["error_count"], row["last_check"]) == ("d3", 0, minute(50))
    assert [(u["when"], u["digest"]) for u in row["updates"]] == [(minute(10), "d1"), (minute(30), "d2")]
    assert S.fold(feed(spark, FEED[:3])).first()["error_count"] == 1


def test_history_is_capped(spark):
    row = S.fold(feed(spark, [(k, f"d{k}") for k in range(40)])).first()
    assert [u["digest"] for u in row["updates"]] == [f"d{k}" for k in range(19, 39)]


def test_changed_ref_clears_the_digest(spark):
    rows = feed(spark, FEED[:2]).unionByName(feed(spark, [(60, "d1")], ref="refs/heads/dev").withColumn("seq", F.lit(9).cast("long")))
    assert [r["needs_update"] for r in S.needs_update(rows).orderBy("ts").collect()] == [True, False, True]
    assert S.fold(rows).first()["updates"] == []
    short = feed(spark, FEED[:1]).unionByName(feed(spark, [(60, "d1")], ref="master").withColumn("seq", F.lit(9).cast("long")))
    assert [r["needs_update"] for r in S.needs_update(short).orderBy("ts").collect()] == [True, False]


@pytest.mark.parametrize("now, minimum, want", [(60, 5, False), (61, 5, True), (60, 15, False), (60, 0, True)])
def test_due(spark, now, minimum, want):
    assert S.due(S.fold(feed(spark)), F.lit(minute(now)), minimum * 60).first()["due"] is want


@pytest.mark.parametrize("cut", range(1, 5))
def test_fold_in_two_steps(spark, cut):
    rows = feed(spark)
    first = S.fold(rows.filter(F.col("seq") < cut))
    assert S.fold(rows.filter(F.col("seq") >= cut), first).collect() == S.fold(rows).collect()


def test_stream_equals_batch(spark):
    rows = feed(spark).unionByName(feed(spark, [(5, "a"), (15, None), (25, "b")], repo="https://s"))
    root = f"{shared_dir(spark)}/stream-test"
    for lo, hi in ((0, 12), (12, 28), (28, 99)):
        rows.filter((F.col("ts") >= F.lit(minute(lo))) & (F.col("ts") < F.lit(minute(hi)))).coalesce(1).write.mode("append").parquet(f"{root}/in")
    got = status_stream.run_status_stream(spark, f"{root}/in", Snapshots(spark, f"{root}/table"), f"{root}/checkpoint")
    assert got.orderBy("repository").collect() == S.fold(rows).orderBy("repository").collect()


def test_heads(spark):
    def best(*lines):
        df = spark.createDataFrame([("r", k, x) for k, x in enumerate(lines)], "repository string, line_no long, line string")
        r = S.best_heads(df).first()
        return r["ref"], r["digest"]

    assert best("d1\tHEAD", "d2\trefs/heads/dev", "d3\trefs/heads/master") == ("refs/heads/master", "d3")
    assert best("d1\tHEAD", "d2\trefs/tags/v1", "d3\trefs/heads/dev") == ("refs/tags/v1", "d2")
    assert best("d1\tHEAD", "d4\trefs/pull/1/head") == ("HEAD", "d1")
    assert best("d1\tHEAD", "d5\tHEAD") == ("HEAD", "d5")
    assert best("d4\trefs/pull/1/head", "odd") == (None, None)


def test_prune_and_sample(spark):
    s = spark.createDataFrame([("a", 9), ("b", 10)], "repository string, error_count int")
    kept, gone = S.prune(s)
    assert [r[0] for r in kept.collect()] == ["a"] and [r[0] for r in gone.collect()] == ["b"]
    assert S.prune(s, 0)[0].count() == 2
    many = spark.range(2000).select(F.col("id").cast("string").alias("repository"))
    assert 400 < S.sample(many, "repository", 0.25).count() < 600
    with pytest.raises(ValueError):
        S.sample(many, "repository", 2)
    with pytest.raises(ValueError):
        S.repository_status(s, "")


def sequential(rows):
    """The fold by hand, one observation after the other."""
    ref_seen = digest = last = None
    errors, updates, needs = 0, [], []
    for ref, d, ts in rows:
        short = ref.rpartition("/")[2] if ref else None
        if short and ref_seen and short != ref_seen:
            digest = None
        ref_seen = short or ref_seen
        if d is None:
            errors += 1
            continue
        needs.append(d != digest)
        if digest is not None and d != digest:
            updates.append((last, digest))
        digest, last, errors = d, ts, 0
    return digest, errors, last, updates[-20:], needs


@pytest.mark.parametrize("seed", range(3))
def test_fold_over_days_equals_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    feeds = {}
    for k in range(12):
        t, rows = 0, []
        for _ in range(rnd.randint(1, 60)):
            t += rnd.choice([1, 30, 700, 3000])
            rows.append((rnd.choice([None, "refs/heads/master", "master"] * 8 + ["refs/heads/dev"]), rnd.choice([None, "a", "b", "c"]), minute(t)))
        feeds[f"https://r{k}"] = rows
    data = [(repo, "", ref, d, d is None, ts, n) for repo, rows in feeds.items() for n, (ref, d, ts) in enumerate(rows)]
    df = spark.createDataFrame(data, OBS).repartition(3)
    folded = {r["repository"]: r for r in S.fold(df).collect()}
    checks = {}
    for r in S.needs_update(df).orderBy("repository", "ts", "seq").collect():
        checks.setdefault(r["repository"], []).append(r["needs_update"])
    for repo, rows in feeds.items():
        digest, errors, last, updates, needs = sequential(rows)
        got = folded[repo]
        assert (got["digest"], got["error_count"], got["last_check"]) == (digest, errors, last)
        assert [(u["when"], u["digest"]) for u in got["updates"]] == updates
        assert checks.get(repo, []) == needs


def messy_feed(spark, seed):
    """Tied times, failures and changed refs of several repositories."""
    rnd, data = random.Random(seed), []
    for k in range(6):
        t = 0
        for n in range(rnd.randint(3, 30)):
            t += rnd.choice([0, 0, 1, 900])
            data.append((f"https://r{k}", "", rnd.choice(["refs/heads/master"] * 9 + ["refs/heads/dev"]), d := rnd.choice([None, "a", "b"]), d is None, minute(t), n))
    return spark.createDataFrame(sorted(data, key=lambda r: (r[5], r[6])), OBS), sorted(data, key=lambda r: (r[5], r[6]))


@pytest.mark.parametrize("seed", range(3))
def test_any_split_with_tied_times_equals_the_batch(spark, seed):
    rows, data = messy_feed(spark, seed)
    cut = random.Random(seed).randint(1, len(data) - 1)
    store = Snapshots(spark, f"{shared_dir(spark)}/split-{seed}")
    for number, part in enumerate((data[:cut], data[cut:])):
        batch = spark.createDataFrame(part, OBS)
        status_stream.fold_batch(store, batch, number, "feed")
        once = sorted(map(str, store.current().collect()))
        status_stream.fold_batch(store, batch, number, "feed")  # delivered again
        assert sorted(map(str, store.current().collect())) == once
    columns = ["repository", "tag", "digest", "error_count", "last_check", "last_seq", "updates"]
    want, got = S.fold(rows).select(*columns), store.current().select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_repeated_check_needs_no_update(spark):
    first = S.fold(feed(spark, FEED[:1]))
    again = feed(spark, [(5, "d1")]).withColumn("seq", F.lit(7).cast("long"))
    assert status_stream.changed_repositories(first, again).count() == 0
    assert status_stream.changed_repositories(first, again.withColumn("digest", F.lit("d9"))).count() == 1


def test_snapshots_keep_two_versions(spark):
    store = Snapshots(spark, f"{shared_dir(spark)}/versions")
    assert not store.exists()
    with pytest.raises(FileNotFoundError):
        store.current()
    for k in range(4):
        store.publish(spark.range(k + 1), note={"k": k})
    assert store.current().count() == 4 and store.note() == {"k": 3}
    import os

    assert sum(name.startswith("v-") for name in os.listdir(store.root.removeprefix("file:").replace("//", "/"))) == 2


def test_summary_counts_what_changed(spark):
    status = S.fold(feed(spark).unionByName(feed(spark, repo="https://s")))
    checks = spark.createDataFrame([("https://r", True), ("https://s", False)], "repository string, needs_update boolean")
    packages = spark.createDataFrame([("https://r",), ("https://r",), ("https://s",)], "repository string")
    row = S.scan_summary(status, F.lit(minute(500)), 60, 1, 0, checks, packages).first().asDict()
    assert row == {"scanned": 2, "duplicates": 0, "due": 2, "samples": 2, "updates": 1, "packages": 2}
    plain = S.scan_summary(status, F.lit(minute(500)), 60, 0).first()
    assert (plain["updates"], plain["packages"]) == (0, 0)


def test_summary_and_plan_go_by_repository_and_tag(spark):
    """Two tags are two keys, each judged and sampled by itself; repeated rows are dropped before they are judged."""
    tagged = feed(spark).withColumn("tag", F.lit("v1"))
    status = S.fold(feed(spark).unionByName(tagged).unionByName(feed(spark, repo="https://s")))
    late = F.lit(minute(500))
    twice = status.unionByName(status.filter("repository = 'https://s'"))
    checks = spark.createDataFrame([("https://r", "", True), ("https://r", "v1", True), ("https://s", "", False)], "repository string, tag string, needs_update boolean")
    packages = spark.createDataFrame([("https://r",), ("https://s",)], "repository string")
    row = S.scan_summary(twice, late, 60, 1, 0, checks, packages).first().asDict()
    assert row == {"scanned": 4, "duplicates": 1, "due": 3, "samples": 3, "updates": 2, "packages": 2}
    plan = sorted((r["repository"], r["tag"]) for r in S.scan_plan(twice, late, 60, 1).collect())
    assert plan == [("https://r", ""), ("https://r", "v1"), ("https://s", "")]
    for seed in range(5):  # the plan's rows are the summary's samples
        chosen = S.scan_plan(twice, late, 60, 0.5, seed).collect()
        assert S.scan_summary(twice, late, 60, 0.5, seed, checks).first()["samples"] == len(chosen)
    apart = [len({r["tag"] for r in S.scan_plan(status, late, 60, 0.5, k).filter("repository = 'https://r'").collect()}) for k in range(12)]
    assert 1 in apart
    for wrong in (5.0, -0.1):
        with pytest.raises(ValueError):
            S.scan_summary(status, late, 60, wrong)


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from depweave.sources import scratch

    class Conf:
        def get(self, key, default=None):
            return "spark://host:7077" if key == "spark.master" else default

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        scratch.shared_dir(Session())
