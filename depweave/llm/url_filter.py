"""URL rules by cascades of Bloom filters.

A rule is a host and a path prefix and holds for the host's subdomains.  The keys that could be rules of a
URL are its host suffixes with its path's prefixes of the lengths that rules have.  For each verdict a
*cascade* encodes the listed keys exactly over the universe of all keys that occur in the corpus (Larisch
et al. 2017, for certificate revocation): level 0 holds the listed keys, level 1 the corpus keys that pass
level 0 by accident, level 2 the listed keys that pass level 1, and so on until no key is left.  A key is
listed when the first level it fails has an odd number.  Looking a key up needs neither the list nor a
join; every expression is a built-in function.

The filters grow with the list, and by log2(universe / list) bits per listed key, not with the corpus.
What goes into a plan is of bounded size: keys are dealt into *shards* by their hash, each with cascades of its own
that fit the bound, and the URLs are passed through one shard after the other, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

MAX_WORDS = 500_000  # 64-bit words of all levels of a shard's cascade together: 4 MB
FEW = 64  # a cascade of so few keys is small in any case
BROADCAST_ROWS = 10_000  # listed keys are broadcast up to this many while a cascade is built


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def key(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (host suffix, path prefix) that a rule could have: structs of size, host size and key."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    sized = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(suffixes, lambda h: F.transform(sized, lambda n: F.struct(
            (F.length(h) + n).alias("size"), F.length(h).alias("host_size"), F.concat(h, F.substring(path, F.lit(1), n)).alias("key")
        )))
    )


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words, number of bits and of hash functions."""

    words: tuple[int, ...]
    bits: int
    hashes: int

    def passes(self, key: Column, number: int) -> Column:
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to one literal
        out = F.lit(True)
        for spot in _spots(key, number, self.bits, self.hashes):
            word = F.get(table, F.shiftright(spot, 6).cast("int"))
            out = out & (F.getbit(word, (spot.bitwiseAND(F.lit(63))).cast("int")) == 1)
        return out


def _spots(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    """Bit places of a key in the level of that number, by double hashing."""
    size = F.lit(bits)
    a, b = F.pmod(F.xxhash64(F.lit(2 * number), key), size), F.pmod(F.xxhash64(F.lit(2 * number + 1), key), size) + 1
    return [F.pmod(a + F.lit(k) * b, size) for k in range(hashes)]


def _size(count: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a filter for so many keys with about that false-positive rate."""
    hashes = max(1, round(-math.log2(rate)))
    return max(64, 64 * math.ceil(count * hashes / math.log(2) / 64)), hashes


def _build(keys: DataFrame, bits: int, hashes: int, number: int) -> Level:
    """A filter over ``keys`` (column key); words are OR-ed in the cluster."""
    spots = keys.select(F.explode(F.array(*_spots(F.col("key"), number, bits, hashes))).alias("spot"))
    one = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    words = spots.select(F.shiftright("spot", 6).cast("int").alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()  # at most MAX_WORDS rows of 12 bytes
    table = [0] * (bits // 64)
    for word, value in zip(found.column("word").to_pylist(), found.column("bits").to_pylist(), strict=True):
        table[word] = value
    return Level(tuple(table), bits, hashes)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels) - 1, -1, -1):
            # failing level n settles it: listed if n is odd, else not
            out = F.when(~self.levels[number].passes(key, number), F.lit(number % 2 == 1)).otherwise(out)
        return out

    @property
    def words(self) -> int:
        return sum(len(level.words) for level in self.levels)


def build_cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch, universe_size: int) -> Cascade | None:
    """A cascade that tells ``listed`` from the rest of ``universe`` exactly (both: distinct column key).

    None where it has more than FEW keys and its levels would have more than MAX_WORDS words: it needs more shards then.
    """
    inside = scratch.write(listed.select("key").distinct(), "listed")
    n = inside.count()
    if not n:
        return Cascade(())
    rest = universe.join(F.broadcast(inside) if n <= BROADCAST_ROWS else inside, "key", "left_anti")
    levels: list[Level] = []
    members, others, count, words = inside, rest, n, 0
    rate = min(0.5, n * math.sqrt(0.5) / max(1, universe_size - n))
    while count:
        bits, hashes = _size(count, max(rate, 2**-40))
        words += bits // 64
        if words > MAX_WORDS and n > FEW:
            return None
        level = _build(members, bits, hashes, len(levels))
        passed = scratch.write(others.filter(level.passes(F.col("key"), len(levels))), f"level-{len(levels)}")
        levels.append(level)
        members, others, count, rate = passed, members, passed.count(), 0.5
    return Cascade(tuple(levels))


def _listed(spark, rules: list[Rule] | DataFrame, scratch: Scratch) -> DataFrame:
    """(key, length, allow): distinct keys of the rules; two rules of one key that disagree are an error."""
    if isinstance(rules, DataFrame):
        keys = rules.select(F.concat("host", "path").alias("key"), F.length("path").alias("length"), F.col("allow").cast("boolean").alias("allow"))
    else:
        # literals, since rows made in Python would need Python on the executors
        text = lambda values: F.split(F.lit("\0".join(values)), "\0")
        columns = text([r.key for r in rules]), text([str(len(r.path)) for r in rules]), text([str(r.allow) for r in rules])
        zipped = F.arrays_zip(*(c.alias(n) for c, n in zip(columns, ("key", "length", "allow"), strict=True)))
        keys = spark.range(1 if rules else 0).select(F.explode(zipped).alias("r"))
        keys = keys.select("r.key", F.col("r.length").cast("int").alias("length"), F.col("r.allow").cast("boolean").alias("allow"))
    keys = scratch.write(keys.groupBy("key", "length").agg(F.min("allow").alias("allow"), F.max("allow").alias("_most")), "rules")
    torn = keys.groupBy("key").agg(F.min("allow").alias("a"), F.max("_most").alias("b")).filter("a <> b").select("key").head(1)
    if torn:
        raise ValueError(f"two rules of {torn[0]['key']!r} disagree")
    return keys.select("key", "length", "allow")


def expected_words(count: int, universe_size: int) -> int:
    """About how many words a cascade of so many keys will have: its first level, and the geometric rest."""
    rate = min(0.5, count * math.sqrt(0.5) / max(1, universe_size - count))
    passing = rate * max(0, universe_size - count)
    return _size(count, max(rate, 2**-40))[0] // 64 + int(2 * (count + passing) / 64) + 1 if count else 0


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards)).cast("int")


def _sharded_cascades(listed: DataFrame, keys: DataFrame, scratch: Scratch) -> list[list[Cascade]]:
    """For each shard of the keys, the cascades of allowed and of blocked keys; as many shards as their bound asks for."""
    universe = scratch.write(keys.distinct(), "universe")
    size, counts = universe.count(), {r["allow"]: r["count"] for r in listed.groupBy("allow").count().collect()}
    shards = max(1, *(-(-expected_words(n, size) // max(MAX_WORDS, 1)) if n > FEW else 1 for n in (counts.get(True, 0), counts.get(False, 0))))
    while True:
        if shards > 1:
            path = scratch.path("sharded-universe")
            universe.withColumn("shard", _shard(F.col("key"), shards)).write.partitionBy("shard").parquet(path)
            dealt = scratch.spark.read.schema("key string, shard int").parquet(path)
        out: list[list[Cascade]] = []
        for k in range(shards):
            mine = dealt.filter(F.col("shard") == k).select("key") if shards > 1 else universe
            own = listed.filter(_shard(F.col("key"), shards) == k) if shards > 1 else listed
            out.append([build_cascade(own.filter(F.col("allow") == v), mine, scratch, size // shards) for v in (True, False)])
            if None in out[-1]:
                break
        else:
            return out
        shards *= 2  # an uneven shard went over the bound


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, default_allow: bool = True) -> DataFrame:
    """Judge every URL: page_id, host, path, rule, verdict ('allow' or 'block').

    pages: page_id, url and any other columns (ignored); rules: a list, or a table of host, path and allow.  Of the
    rules whose host is the URL's or one above it, and whose path its path starts with, the longest decides (of
    equal length the one with the longer host); ``rule`` is its host and path.  A URL that neither cascade holds
    has no rule: null, and the verdict is ``default_allow``'s.  A null url, or one without ``://``, has an empty
    host and path.  Two rules of one key must agree.  Repeated rows are judged each; an empty table gives an
    empty table.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    listed = _listed(spark, rules, scratch)
    lengths = sorted(r["length"] for r in listed.select("length").distinct().collect()) or [0]  # at most a path's length
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    keys = rows.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("c")).select("c.key")
    cascades = _sharded_cascades(listed, keys, scratch)

    def hits(k: int) -> Column:
        """Of a URL's keys those that the shard's cascades hold; the largest is the longest."""
        allow, block = cascades[k]
        candidates = candidate_keys(F.col("host"), F.col("path"), lengths)
        if len(cascades) > 1:
            candidates = F.filter(candidates, lambda c: _shard(c["key"], len(cascades)) == k)
        judged = F.transform(
            candidates,
            lambda c: F.struct(c["size"].alias("size"), c["host_size"].alias("host_size"), c["key"].alias("key"),
                               F.when(allow.holds(c["key"]), F.lit("allow")).when(block.holds(c["key"]), F.lit("block")).alias("verdict")),
        )
        return F.filter(judged, lambda c: c["verdict"].isNotNull())

    found = rows.withColumn("best", F.array_max(hits(0)))
    for k in range(1, len(cascades)):  # each shard's literals are in a plan of their own
        done = scratch.write(found, "judged")
        found = done.withColumn("best", F.array_max(F.concat(F.when(F.col("best").isNull(), F.array()).otherwise(F.array("best")), hits(k))))
    return found.select(
        "page_id", "host", "path", F.col("best.key").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit("allow" if default_allow else "block")).alias("verdict"),
    )
