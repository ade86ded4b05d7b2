"""Repository status: a fold over ordered observations, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import fix_repo_url
from ..sources.scratch import Rounds

HISTORY = 20
ERROR_LIMIT = 10
KEY = ("repository", "tag")


def _short(ref: Column) -> Column:
    return F.element_at(F.split(ref, "/"), -1)


def checked(observations: DataFrame) -> DataFrame:
    """Observations with what the fold knew before each: previous success, and whether it is a change.

    Order is (ts, seq) within (repository, tag).  A changed explicit ref, counted over all checks, clears
    the digest: what follows is compared with nothing, and no history entry comes from it.

    A repository may hold a large part of all rows, so windows run within its days only; what a day
    begins with comes from one summary row per day before it.
    """
    part = [*KEY, "_day"]
    order = Window.partitionBy(*part).orderBy("ts", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    earlier_days = Window.partitionBy(*KEY).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    ok, point = ~F.col("failed"), F.struct("ts", "seq")

    rows = observations.withColumn("_day", F.date_trunc("day", "ts")).withColumn("_ref", _short(F.col("ref")))
    refs = rows.groupBy(*part).agg(F.max_by("_ref", F.when(F.col("_ref").isNotNull(), point)).alias("_end"))
    refs = refs.select(*part, F.last("_end", ignorenulls=True).over(earlier_days).alias("_begin"))
    rows = rows.join(refs, part)
    last_ref = F.coalesce(F.last("_ref", ignorenulls=True).over(before), F.col("_begin"))
    rows = rows.withColumn("_moved", F.coalesce((F.col("_ref") != last_ref).cast("int"), F.lit(0)))
    rows = rows.withColumn("_era", F.sum("_moved").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_begin", "_ref")

    success = F.when(ok, F.struct("ts", "seq", "digest", "_era"))
    days = rows.groupBy(*part).agg(F.sum("_moved").alias("_moves"), F.max(success).alias("_good"))
    days = days.withColumn("_eras", F.coalesce(F.sum("_moves").over(earlier_days), F.lit(0)))
    good = F.when(F.col("_good").isNotNull(), F.struct("_good.digest", "_good.ts", (F.col("_good._era") + F.col("_eras")).alias("era")))
    days = days.withColumn("_good", good)
    days = days.select(*part, "_eras", F.last("_good", ignorenulls=True).over(earlier_days).alias("_first"))
    rows = rows.join(days, part).withColumn("era", F.col("_era") + F.col("_eras"))
    own = F.last(F.when(ok, F.struct("digest", "ts", "era")), ignorenulls=True).over(before)
    rows = rows.withColumn("_last", F.coalesce(own, F.col("_first")))
    same_era = F.col("_last.era") == F.col("era")
    return (
        rows.withColumn("prev_digest", F.when(same_era, F.col("_last.digest")))
        .withColumn("prev_check", F.col("_last.ts"))
        .withColumn("needs_update", F.when(ok, ~F.col("digest").eqNullSafe(F.col("prev_digest"))))
        .drop("_last", "_first", "_moved", "_era", "_eras")
    )


def needs_update(observations: DataFrame) -> DataFrame:
    """(repository, tag, ts, seq, needs_update) of the successful checks: the digest is not the one known before."""
    return checked(observations).filter(~F.col("failed")).select(*KEY, "ts", "seq", "needs_update")


def _newest_changes(seen: DataFrame, keep: int) -> DataFrame:
    """Superseded digests, the newest ``keep`` of each key: first within each day, then over days."""
    changes = seen.filter(F.col("needs_update") & F.col("prev_digest").isNotNull())
    latest = (F.desc("ts"), F.desc("seq"))
    per_day = F.row_number().over(Window.partitionBy(*KEY, "_day").orderBy(*latest))
    overall = F.row_number().over(Window.partitionBy(*KEY).orderBy(*latest))
    few = changes.withColumn("n", per_day).filter(F.col("n") <= keep)
    return few.withColumn("n", overall.cast("long")).filter(F.col("n") <= keep)


def history(observations: DataFrame, keep: int = HISTORY) -> DataFrame:
    """(repository, tag, when, digest, changed_at, n): superseded digests with their last check time, newest ``keep`` (n = 1 is newest)."""
    rows = _newest_changes(checked(observations), keep)
    return rows.select(*KEY, F.col("prev_check").alias("when"), F.col("prev_digest").alias("digest"), F.col("ts").alias("changed_at"), "n")


def consecutive_errors(observations: DataFrame) -> DataFrame:
    """(repository, tag, error_count): failed checks since the last success."""
    point = F.struct("ts", "seq")
    last = observations.groupBy(*KEY).agg(F.max(F.when(~F.col("failed"), point)).alias("_ok"))
    joined = observations.join(last, list(KEY))
    late = F.col("failed") & (F.col("_ok").isNull() | (point > F.col("_ok")))
    return joined.groupBy(*KEY).agg(F.count_if(late).cast("int").alias("error_count"))


def fold(observations: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The status table after all observations, beginning from ``state`` where there is one.

    Observations not after a repository's stored (last_check, last_seq) are dropped, so that a feed with tied
    times may be split anywhere.  ``observations`` may have a column prefix; the last non-empty one is recorded.
    With a state, the batch and what is derived of it are written once; the state is read three times.
    """
    prefix = F.col("prefix") if "prefix" in observations.columns else F.lit("")
    rows = observations.select(*KEY, "ref", "digest", "failed", "ts", "seq", prefix.alias("prefix"), F.lit(False).alias("seed"))
    if state is not None:
        stored_seq = F.coalesce("last_seq", F.lit(-1)) if "last_seq" in state.columns else F.lit(-1)
        old = state.select(*KEY, "last_check", stored_seq.cast("long").alias("last_seq"), "error_count", "updates", F.col("ref_name").alias("_ref"), F.col("digest").alias("_digest"), F.col("prefix").alias("_prefix"))
        rows = rows.join(old.select(*KEY, F.col("last_check").alias("_seen"), F.col("last_seq").alias("_seen_seq")), list(KEY), "left")
        rows = rows.filter(F.col("_seen").isNull() | (F.struct("ts", "seq") > F.struct("_seen", "_seen_seq"))).drop("_seen", "_seen_seq")
        known = old.filter(F.col("last_check").isNotNull())
        seeds = known.select(*KEY, F.col("_ref").alias("ref"), F.col("_digest").alias("digest"), F.lit(False).alias("failed"), F.col("last_check").alias("ts"), F.col("last_seq").alias("seq"), F.col("_prefix").alias("prefix"), F.lit(True).alias("seed"))
        # what follows reads them many times, in one plan: tables keep it from joining the batch with the state as often
        rounds = Rounds(observations.sparkSession, "fold")
        rows = rounds.write(rows.unionByName(seeds), keep=True)
        seen = rounds.write(checked(rows), keep=True)
    else:
        seen = checked(rows)
    point, ok = F.struct("ts", "seq"), ~F.col("failed")
    ends = seen.groupBy(*KEY).agg(
        F.max(F.when(ok, F.struct("ts", "seq", "digest", "ref", "era", "seed"))).alias("ok"), F.max("era").alias("era"), F.max_by("prefix", F.when(F.col("prefix") != "", point)).alias("prefix")
    )
    if state is not None:
        ends = rounds.write(ends, keep=True)
    fails = seen.filter("failed").select(*KEY, "ts", "seq").join(ends.select(*KEY, F.struct("ok.ts", "ok.seq").alias("_ok"), F.col("ok").isNull().alias("_never")), list(KEY))
    fails = fails.filter(F.col("_never") | (point > F.col("_ok"))).groupBy(*KEY).agg(F.count("*").cast("int").alias("errors"))
    entry = F.struct("ts", "seq", F.struct(F.col("prev_check").alias("when"), F.col("prev_digest").alias("digest")).alias("entry"))
    fresh = _newest_changes(seen.filter("not seed"), HISTORY).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias("fresh"))
    out = ends.join(fails, list(KEY), "left").join(fresh, list(KEY), "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    if state is not None:
        out = out.join(old, list(KEY), "full")
        stored, carried = F.coalesce("updates", F.array().cast("array<struct<when: timestamp, digest: string>>")), F.coalesce("error_count", F.lit(0))
        errors = F.coalesce("errors", F.lit(0)) + F.when(F.col("ok").isNull() | F.col("ok.seed"), carried).otherwise(0)
    else:
        out = out.withColumns({"_ref": F.lit(None).cast("string"), "_digest": F.lit(None).cast("string"), "last_check": F.lit(None).cast("timestamp"), "last_seq": F.lit(None).cast("long"), "_prefix": F.lit("")})
        stored, errors = F.array().cast("array<struct<when: timestamp, digest: string>>"), F.col("errors")
    updates = F.concat(stored, F.coalesce("fresh", F.array().cast("array<struct<when: timestamp, digest: string>>")))
    digest = F.when(F.col("ok.era") == F.col("era"), F.col("ok.digest")).otherwise(F.when(F.col("era").isNull(), F.col("_digest")))
    return out.select(
        *KEY, F.coalesce("ok.ref", "_ref").alias("ref_name"), digest.alias("digest"), errors.cast("int").alias("error_count"), F.coalesce("prefix", "_prefix", F.lit("")).alias("prefix"),
        F.coalesce("ok.ts", "last_check").alias("last_check"), F.coalesce("ok.seq", "last_seq").alias("last_seq"), F.slice(updates, F.greatest(F.size(updates) - (HISTORY - 1), F.lit(1)), HISTORY).alias("updates"),
    )


def due(status: DataFrame, now: Column, minimum_seconds: int) -> DataFrame:
    """(repository, tag, due): whether a check is worth while at ``now``.

    Never before the minimum has passed; without history always; else after the mean time between updates,
    which divides the span from the first to the last update by the number of updates.
    """
    micros = F.unix_micros
    last, at = micros("last_check"), micros(now)
    n = F.size("updates")
    span = micros(F.get("updates", n - 1)["when"]) - micros(F.get("updates", F.lit(0))["when"])
    out = (
        F.when(F.lit(minimum_seconds == 0) | F.col("last_check").isNull(), True)
        .when(last + minimum_seconds * 1_000_000 > at, False)
        .when(n == 0, True)
        .otherwise(last + F.floor(span / F.greatest(n, F.lit(1))) < at)
    )
    return status.select(*KEY, out.alias("due"))


def _share(key: Column, seed: int) -> Column:
    """A number from 0 to below 1 by a digest of the key, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _rate(rate: float) -> float:
    """A sampling rate; 0 stands for 1."""
    if not 0 <= rate <= 1:
        raise ValueError(f"rate {rate} is not within 0..1")
    return rate or 1.0


def sample(rows: DataFrame, key: str | Column, rate: float, seed: int = 0) -> DataFrame:
    """Rows kept with probability ``rate`` by a digest of the key, the same whenever it is run; 0 stands for 1."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.filter(_share(key, seed) < _rate(rate))


def status_key() -> Column:
    """What a scan goes by: the repository, or repository@tag."""
    return F.when(F.coalesce("tag", F.lit("")) == "", F.col("repository")).otherwise(F.concat("repository", F.lit("@"), "tag"))


def scan_plan(status: DataFrame, now: Column, minimum_seconds: int, rate: float, seed: int = 0) -> DataFrame:
    """The work list: due (repository, tag) pairs, each once, sampled, with their ref; every tag is a key of its own."""
    once = status.dropDuplicates(list(KEY))
    keys = due(once, now, minimum_seconds).filter("due").select(*KEY)
    return sample(once.select(*KEY, "ref_name").join(keys, list(KEY), "left_semi"), status_key(), rate, seed)


def scan_summary(
    status: DataFrame, now: Column, minimum_seconds: int, rate: float, seed: int = 0, checks: DataFrame | None = None, packages: DataFrame | None = None
) -> DataFrame:
    """One row: status rows, rows beyond the first of a (repository, tag), due ones, sampled ones, and what the scan changed.

    A repeated row is dropped before it is judged; due and sampled ones are those of ``scan_plan``.
    ``checks`` (repository, needs_update, and tag where there are several) are the sampled ones' new checks; those that
    ask for an update count as updates, and their repositories' rows in ``packages`` (repository) as packages, once for
    each update. Without them both are 0.
    """
    rate = _rate(rate)
    sizes = status.groupBy(*KEY).agg(F.count("*").alias("n"))
    judged = due(status.dropDuplicates(list(KEY)), now, minimum_seconds).join(sizes, list(KEY))
    chosen = (_share(status_key(), seed) < rate).cast("int")
    keys = judged.select(*KEY, "n", F.col("due").cast("int").alias("d"), chosen.alias("s"))
    if checks is None:
        keys = keys.withColumns({"u": F.lit(0), "p": F.lit(0).cast("long")})
    else:
        tag = F.col("tag") if "tag" in checks.columns else F.lit("")
        changed = checks.select("repository", tag.alias("tag"), "needs_update").groupBy(*KEY).agg(F.max(F.col("needs_update").cast("int")).alias("u"))
        keys = keys.join(changed, list(KEY), "left").withColumn("u", F.col("d") * F.col("s") * F.coalesce("u", F.lit(0)))
        owned = F.lit(0).cast("long")
        if packages is not None:
            keys = keys.join(packages.groupBy("repository").agg(F.count("*").alias("own")), "repository", "left")
            owned = F.col("u") * F.coalesce("own", F.lit(0))
        keys = keys.withColumn("p", owned)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return keys.agg(
        total(F.col("n")).alias("scanned"), total(F.col("n") - 1).alias("duplicates"), total(F.col("d")).alias("due"),
        total(F.col("d") * F.col("s")).alias("samples"), total(F.col("u")).alias("updates"), total(F.col("p")).alias("packages"),
    )


def repository_status(status: DataFrame, url: str) -> DataFrame:
    """All status rows of a repository, any tag; an empty URL is an error."""
    if not url:
        raise ValueError("no repository given")
    return status.filter(F.col("repository") == fix_repo_url(F.lit(url)))


def prune(status: DataFrame, limit: int = ERROR_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows whose errors in a row reached the limit go; 0 keeps all."""
    if limit <= 0:
        return status, status.filter(F.lit(False))
    return status.filter(F.col("error_count") < limit), status.filter(F.col("error_count") >= limit)


def best_heads(listings: DataFrame, want_tags: bool = True) -> DataFrame:
    """(repository, ref, digest): the head to follow from ref listings (repository, line_no, line).

    A master branch wins; else the first other branch (or tag) listed; else HEAD, the last such line.
    Lines without exactly two fields are skipped; a repository with none of these has nulls.
    """
    parts = F.split(F.trim("line"), r"\s+")
    refs = listings.select("repository", "line_no", F.get(parts, F.lit(0)).alias("digest"), F.get(parts, F.lit(1)).alias("ref"), F.size(parts).alias("fields"))
    branch = F.col("ref").startswith("refs/heads/") | (F.lit(want_tags) & F.col("ref").startswith("refs/tags/"))
    rank = F.when(F.col("ref") == "refs/heads/master", 0).when(branch, 1).when(F.col("ref") == "HEAD", 2)
    rank = F.when(F.col("fields") == 2, rank)
    place = F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.when(rank == 2, -F.col("line_no")).otherwise(F.col("line_no")).alias("at")))
    best = refs.groupBy("repository").agg(F.min_by(F.struct("ref", "digest"), place).alias("b"))
    return best.select("repository", "b.ref", "b.digest")
