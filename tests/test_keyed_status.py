"""Keyed streaming state and its timers against the batch fold and scans of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from depweave.operators import status as S
from depweave.sources.scratch import new_folder
from depweave.streaming import keyed_status as K
from depweave.streaming.status_stream import OBSERVATION

T0 = dt.datetime(2024, 1, 1)


def minute(m):
    return T0 + dt.timedelta(minutes=m)


def feed(spark, seed, n=150, keys=6):
    rnd, rows = random.Random(seed), []
    for k in range(n):
        failed = rnd.random() < 0.25
        ref = rnd.choice(["refs/heads/master"] * 9 + ["refs/heads/dev", None])
        rows.append((f"https://r{rnd.randrange(keys)}", rnd.choice(["", "", "v1"]), ref, None if failed else f"d{rnd.randrange(4)}", failed, minute(k // 3), k))
    return rows


def plain(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def by_hand(rows):
    """The rule of one observation after the other, exactly."""
    out = {}
    for repo, tag, ref, digest, failed, ts, seq in sorted(rows, key=lambda r: (r[5], r[6])):
        s = out.setdefault((repo, tag), {"seen": None, "ref": None, "digest": None, "errors": 0, "last": None, "seq": None, "updates": []})
        short = ref.rpartition("/")[2] if ref else None
        if short:
            if s["seen"] and short != s["seen"]:
                s["digest"] = None
            s["seen"] = short
        if failed:
            s["errors"] += 1
            continue
        if s["digest"] is not None and digest != s["digest"]:
            s["updates"] = [*s["updates"], (s["last"], s["digest"])][-20:]
        s |= {"digest": digest, "last": ts, "seq": seq, "errors": 0, "ref": ref or s["ref"]}
    return sorted(str((k, s["ref"], s["digest"], s["errors"], s["last"], s["seq"], s["updates"])) for k, s in out.items())


def of_state(df):
    return sorted(str(((r["repository"], r["tag"]), r["ref_name"], r["digest"], r["error_count"], r["last_check"], r["last_seq"], [(u["when"], u["digest"]) for u in r["updates"]])) for r in df.collect())


@pytest.mark.parametrize("cuts", [(), (1, 2, 75, 76, 120)])
def test_state_equals_the_fold_over_any_split(spark, cuts):
    rows, root = feed(spark, len(cuts)), new_folder(spark, "keyed")
    for lo, hi in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        spark.createDataFrame(rows[lo:hi], OBSERVATION).coalesce(1).write.mode("append").parquet(f"{root}/in")
        K.run_keyed_status(spark, f"{root}/in", root)
    assert of_state(K.keyed_status(spark, root)) == by_hand(rows)
    steady = [r for r in rows if r[2] == "refs/heads/master"]
    if not cuts:  # where refs stay the same the batch fold says the same
        other = new_folder(spark, "keyed")
        spark.createDataFrame(steady, OBSERVATION).coalesce(1).write.parquet(f"{other}/in")
        K.run_keyed_status(spark, f"{other}/in", other)
        assert plain(K.keyed_status(spark, other)) == plain(S.fold(spark.createDataFrame(steady, OBSERVATION)))


def test_a_batch_writes_the_keys_it_touches(spark):
    root = new_folder(spark, "keyed")
    many = [(f"https://m{k}", "", "refs/heads/master", "d", False, minute(0), k) for k in range(400)]
    spark.createDataFrame(many, OBSERVATION).coalesce(1).write.parquet(f"{root}/in")
    K.run_keyed_status(spark, f"{root}/in", root)
    for b in range(2):
        spark.createDataFrame([("https://m7", "", "refs/heads/master", f"e{b}", False, minute(b + 1), 1000 + b)], OBSERVATION).coalesce(1).write.mode("append").parquet(f"{root}/in")
        K.run_keyed_status(spark, f"{root}/in", root)
    sizes = {r["batch"]: r["count"] for r in K.changes(spark, root).groupBy("batch").count().collect()}
    assert sizes == {0: 400, 1: 1, 2: 1}
    assert K.keyed_status(spark, root).count() == 400
    K.run_keyed_status(spark, f"{root}/in", root)  # nothing new
    assert {r["batch"] for r in K.changes(spark, root).select("batch").distinct().collect()} == {0, 1, 2}


def test_timers_equal_a_scan_at_every_tick(spark):
    """At each tick the emitted repositories are those that ``scan_plan`` finds over the fold of all rows so far."""
    rows, root = feed(spark, 5, n=90), new_folder(spark, "timers")
    rows = [r for r in rows if r[2] == "refs/heads/master"]
    rule = K.ScanRule(minimum_seconds=180, rate=0.7, seed=4, lateness_seconds=60)
    some = 0
    for lo, hi, now in ((0, 10, 10), (10, 20, 21), (20, 20, 23), (20, 30, 40), (30, 30, 300)):
        new = [r for r in rows if minute(lo) <= r[5] < minute(hi)]
        if new:
            spark.createDataFrame(new, OBSERVATION).coalesce(1).write.mode("append").parquet(f"{root}/in")
        K.tick(spark, f"{root}/in", minute(now))
        K.run_keyed_status(spark, f"{root}/in", root, rule, files_per_batch=100)
        state = S.fold(spark.createDataFrame([r for r in rows if r[5] < minute(hi)], OBSERVATION))
        want = sorted((r["repository"], r["tag"]) for r in S.scan_plan(state, F.lit(minute(now)), 180, 0.7, 4).collect())
        got = sorted((r["repository"], r["tag"]) for r in K.due_changes(spark, root).filter(F.col("at") == F.lit(minute(now))).collect())
        assert got == want
        some += len(want)
    assert some > 5
