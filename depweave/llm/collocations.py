"""Phrase collocation mining by best-first branch and bound.

A phrase of 2 to 4 words that occurs at least 30 times is a candidate; its score is that of its worst cut into two
parts, 2,000,000 a / (l + r).  Counts of prefixes bound what can grow from them: a phrase that begins with the two
words p, whose first word occurs f times, scores 2,000,000 f(p) / (f + f(p)) at most, since its first cut has l = f and
r >= a, and a <= f(p); for phrases that end with p the same holds with p's last word.

1. Words are counted, then pairs of words that both occur often enough.  Every pair gets its bound (the higher of the
   two) and its count, the two keys by which phrases are ranked: no phrase that begins or ends with it ranks higher.
2. The *frontier* are the pairs by falling bound.  Each step takes its best pairs, as many as a pass over the texts can
   carry, and counts the triples that begin or end with one of them; then, by the triples' own bounds, the quadruples.
3. All phrases that rank above the first pair left in the frontier are then known exactly, and so are all longer
   candidates around them.  A language is settled once it has 2,000 survivors above that point, ties included, or when its
   frontier is empty; the next step goes on with the others.

Texts are cut into words by NumPy in the tasks; a group of texts is counted by exact word numbers of its own (Arrow
dictionaries), and Spark adds up the groups' counts by the phrases' words, combined before the shuffle.  What goes with
the tasks is of bounded size: a bitmap of frequent words, and the hashes of one step's frontier.  Both only choose what
to count: a hash that meets another one costs a count that nobody asks for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_groups, lower_bytes, map_arrow, mix64, span_hashes, word_spans

LONGEST, LEAST, TOP, SHARE = 4, 30, 2000, 80
GROUP_BYTES = 2 << 20  # texts counted together in a task
BITMAP = 1 << 24  # bits of the frequent-word bitmap: 2 MB, however many words there are
FRONTIER = 1 << 18  # phrases that a pass over the texts looks for: 2 MB of hashes
SALTS = 32  # ranks within a language are taken in so many parts first
BROADCAST_ROWS = 100_000  # words and pairs (some 40 bytes each) are broadcast up to this many, shuffled beyond

_GAP, _PIECE = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[9, 32]] = True
_PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
_SEPARATOR = _GAP | _PIECE
_ODD = np.random.default_rng(13).integers(0, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _string_hashes(strings) -> np.ndarray:
    """Hashes of whole strings of an Arrow array."""
    import pyarrow as pa

    strings = strings.cast(pa.large_string())
    if not len(strings):
        return np.zeros(0, np.uint64)
    out = []
    for _, data, off in byte_groups(strings, GROUP_BYTES):
        out.append(span_hashes(data, off[:-1], off[1:]))
    return np.concatenate(out)


def _combined(word_hashes: list[np.ndarray]) -> np.ndarray:
    return mix64(sum(h * _ODD[k] for k, h in enumerate(word_hashes)), len(word_hashes))


class _Group:
    """Words of some texts: ``word`` numbers each occurrence's (language, word), ``broken`` tells whether a piece begins."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs):
        import pyarrow as pa

        data = lower_bytes(data)
        s, e, first = word_spans(data, off, _SEPARATOR)
        cuts = np.concatenate(([0], np.cumsum(_PIECE[data], dtype=np.int32)))
        self.broken = np.ones(len(s), bool)
        self.broken[1:] = cuts[s[1:]] != cuts[e[:-1]]
        self.broken[first[:-1][np.diff(first) > 0]] = True
        ends = np.concatenate(([0], np.cumsum(e - s)))
        letters = pa.py_buffer(data[~_SEPARATOR[data]].tobytes())
        coded = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(ends.astype(np.int64).tobytes()), letters).dictionary_encode()
        self.langs, self.words = langs.dictionary, coded.dictionary
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(first))
        size = max(len(self.words), 1)
        self.of, self.word, self.count = np.unique(lang * size + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
        self.lang_of, self.word_of = np.divmod(self.of, size)
        self._hashes = None

    def hashes(self) -> np.ndarray:
        """A hash for each (language, word)."""
        if self._hashes is None:
            self._hashes = mix64(_string_hashes(self.words)[self.word_of] + mix64(_string_hashes(self.langs))[self.lang_of])
        return self._hashes

    def chained(self, at: np.ndarray) -> np.ndarray:
        """Those places of ``at`` from which the next word is in the same piece."""
        at = at[at + 1 < len(self.word)]
        return at[~self.broken[at + 1]]

    def counts(self, grams: list[np.ndarray], n: np.ndarray):
        """A record batch (lang, gram, n); ``grams`` has the number of each phrase's k-th word."""
        import pyarrow as pa
        import pyarrow.compute as pc

        text = [self.words.take(pa.array(self.word_of[g])) for g in grams]
        text = text[0] if len(text) == 1 else pc.binary_join_element_wise(*text, pa.scalar(" ", pa.large_string()))
        lang = self.langs.take(pa.array(self.lang_of[grams[0]])) if len(grams[0]) else pa.array([], pa.string())
        return pa.RecordBatch.from_arrays([lang.cast(pa.string()), text.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def _phrases(group: _Group, at: np.ndarray, size: int):
    """(word numbers by place in the phrase, counts) of the distinct phrases of ``size`` words that begin at ``at``."""
    words, ids = max(len(group.of), 1), group.word[at]
    for k in range(1, size - 1):  # numbers of shorter phrases, so that keys stay small
        ids = np.unique(ids * words + group.word[at + k], return_inverse=True)[1]
    _, first, n = np.unique(ids * words + group.word[at + size - 1], return_index=True, return_counts=True)
    return [group.word[at[first] + k] for k in range(size)], n


def _member(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted ``known`` ones."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _count(docs: DataFrame, size: int, known: np.ndarray | None, least: int) -> DataFrame:
    """(lang, gram, n) over all texts, those of at least ``least`` occurrences.

    For words, a row with a null gram has the language's number of words.  For pairs, ``known`` is the bitmap of
    frequent words; for longer phrases, the sorted hashes of phrases one word shorter of which a phrase has one at its
    beginning or end.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at, data, off in byte_groups(batch.column("text"), GROUP_BYTES):
                langs = batch.column("lang").slice(at, len(off) - 1).dictionary_encode()
                g = _Group(data, off, langs)
                if not len(g.word):
                    continue
                if size == 1:
                    yield g.counts([np.arange(len(g.of))], g.count)
                    total = np.bincount(g.lang_of, weights=g.count).astype(np.int64)
                    seen = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays(
                        [g.langs.take(pa.array(seen)).cast(pa.string()), pa.nulls(len(seen), pa.string()), pa.array(total[seen])], names=["lang", "gram", "n"]
                    )
                    continue
                place = g.chained(np.arange(len(g.word)))
                if size == 2:
                    bit = g.hashes() % np.uint64(BITMAP)
                    often = (known[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                    place = place[often[g.word[place]] & often[g.word[place + 1]]]
                else:
                    for _ in range(size - 3):  # places where size - 1 words are in one piece
                        ahead = np.zeros(len(g.word) + 1, bool)
                        ahead[place] = True
                        place = place[ahead[place + 1]]
                    words, _n = _phrases(g, place, size - 1)
                    hit = _member(_combined([g.hashes()[w] for w in words]), known)
                    ids = g.word[place]
                    for k in range(1, size - 1):
                        ids = np.unique(ids * max(len(g.of), 1) + g.word[place + k], return_inverse=True)[1]
                    wanted = np.zeros(len(g.word) + 1, np.int8)  # 1: a shorter phrase begins here, 2: a wanted one
                    wanted[place] = 1 + hit[ids]
                    here, there = wanted[place], wanted[place + 1]
                    place = place[(there > 0) & ((here == 2) | (there == 2))]
                if len(place):
                    yield g.counts(*_phrases(g, place, size))

    found = map_arrow(docs, run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return found.filter(F.col("gram").isNull() | (F.col("n") >= least))


def _hashed(rows: DataFrame) -> DataFrame:
    """(h): the hash of each row's phrase, of 1 to LONGEST words, in its language."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            lang = mix64(_string_hashes(batch.column("lang")))
            for at, data, off in byte_groups(batch.column("gram"), GROUP_BYTES):
                s, e, first = word_spans(data, off, _GAP)
                size = np.diff(first)
                h = mix64(span_hashes(data, s, e) + np.repeat(lang[at : at + len(size)], size))
                out = np.zeros(len(size), np.uint64)
                for k in range(1, LONGEST + 1):
                    mine = np.flatnonzero(size == k)
                    words = [h[first[mine] + j] for j in range(k)]
                    out[mine] = words[0] if k == 1 else _combined(words)
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])

    return map_arrow(rows.select("lang", "gram"), run, "h long")


def _bitmap(words: DataFrame) -> np.ndarray:
    """The bitmap of the words' hashes; BITMAP / 64 rows at most come to the driver."""
    cells = _hashed(words).select(F.col("h").bitwiseAND(F.lit(BITMAP - 1)).alias("bit")).select(
        F.shiftright("bit", 6).alias("cell"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bits")
    )
    found = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, np.uint64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _known(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of at most FRONTIER phrases."""
    return np.unique(_hashed(rows).toArrow().column("h").to_numpy().view(np.uint64))


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def score(a: str, left: str, right: str) -> Column:
    """floor(2000000 * a / (left + right)) in decimals."""
    return F.expr(f"cast(cast({a} as decimal(20,0)) * 2000000 div (cast({left} as decimal(20,0)) + cast({right} as decimal(20,0))) as bigint)")


def _words(first: int, last: int) -> Column:
    """The words ``first`` to ``last`` of a phrase of 4 at most, from 0."""
    return F.array_join(F.slice(F.split("gram", " "), first + 1, last - first + 1), " ")


def _worst_cut(rows: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Adds score, l and r of the lowest-scoring cut; ties go to the smallest first part."""
    options = [F.struct(score("a", x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate(cuts)]
    return rows.withColumn("cut", F.array_min(F.array(*options)))


def _bounded(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Adds bound: no phrase that begins or ends with a row's phrase scores more; it occurs ``a`` times at most."""
    return rows.withColumn("least", F.least(first, last)).withColumn("bound", score("a", "least", "a")).drop("least")


def _top(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each language by ``order``, numbered in column rank; no language is gathered whole."""
    part = F.pmod(F.xxhash64("gram"), F.lit(SALTS))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    some = some.filter(F.col("rank") <= limit).drop("part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= limit)


class Miner:
    """The tables of a search: pairs, triples and quadruples counted so far, and each language's frontier."""

    def __init__(self, docs: DataFrame, top: int, frontier: int, least: int):
        self.spark, self.top, self.frontier, self.least = docs.sparkSession, top, frontier, least
        self.scratch = Scratch(self.spark, "collocations")
        self.docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
        counted = self.scratch.write(_count(self.docs, 1, None, least), "words")
        self.words, self.totals = counted.filter("gram is not null"), counted.filter("gram is null").select("lang", "n")
        pairs = self.scratch.write(_count(self.docs, 2, _bitmap(self.words), least), "pairs")
        pairs = pairs.select("lang", "gram", F.col("n").alias("a"), F.element_at(F.split("gram", " "), 1).alias("w1"), F.element_at(F.split("gram", " "), 2).alias("w2"))
        words = _few(self.words)
        for k in ("1", "2"):
            pairs = pairs.join(words.select("lang", F.col("gram").alias(f"w{k}"), F.col("n").alias(f"f{k}")), ["lang", f"w{k}"])
        pairs = _bounded(_worst_cut(pairs, [("f1", "f2")]), "f1", "f2").select("lang", "gram", "a", "f1", "f2", "cut", "bound")
        self.pairs = self.scratch.write(pairs, "pair-scores")
        self.triples = self.quads = self.expanded = None

    def _more(self, before: DataFrame | None, found: DataFrame, name: str) -> DataFrame:
        """Counts of another pass; a phrase that had been counted before has the same count."""
        both = found if before is None else before.unionByName(found).dropDuplicates(["lang", "gram"])
        return self.scratch.write(both, name)

    def _triple_scores(self) -> DataFrame:
        rows = self.triples.select("lang", "gram", F.col("n").alias("a"), _words(0, 1).alias("head"), _words(1, 2).alias("tail"))
        pairs = _few(self.pairs)
        rows = rows.join(pairs.select("lang", F.col("gram").alias("head"), F.col("a").alias("f12"), "f1"), ["lang", "head"])
        rows = rows.join(pairs.select("lang", F.col("gram").alias("tail"), F.col("a").alias("f23"), F.col("f2").alias("f3")), ["lang", "tail"])
        return _bounded(_worst_cut(rows, [("f1", "f23"), ("f12", "f3")]), "f1", "f3").select("lang", "gram", "a", "f1", "f12", "f23", "f3", "cut", "bound")

    def _quad_scores(self, triples: DataFrame) -> DataFrame:
        rows = self.quads.select("lang", "gram", F.col("n").alias("a"), _words(0, 2).alias("head"), _words(1, 3).alias("tail"))
        rows = rows.join(triples.select("lang", F.col("gram").alias("head"), F.col("a").alias("f123"), "f1", "f12"), ["lang", "head"])
        rows = rows.join(triples.select("lang", F.col("gram").alias("tail"), F.col("a").alias("f234"), F.col("f23").alias("f34"), F.col("f3").alias("f4")), ["lang", "tail"])
        return _worst_cut(rows, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")]).select("lang", "gram", "a", "cut")

    def _passes(self, size: int, wanted: DataFrame, docs: DataFrame) -> DataFrame:
        """Counts of the phrases of ``size`` words with a wanted one at either end, in as many passes as their number asks for."""
        parts, found = -(-wanted.count() // self.frontier) or 1, None
        for k in range(parts):
            some = wanted if parts == 1 else wanted.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k)
            counts = _count(docs, size, _known(some), self.least)
            if parts > 1:
                counts = self.scratch.write(counts, "pass")
            found = counts if found is None else found.unionByName(counts)
        return found if parts == 1 else found.dropDuplicates(["lang", "gram"])

    def step(self, frontier: DataFrame, langs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Expand the frontier's best pairs: (pairs taken, per language the first pair left as (lang, kb, ka))."""
        many = langs.count()
        size = max(1, self.frontier // max(many, 1))
        best = self.scratch.write(_top(frontier, [F.desc("bound"), F.desc("a"), F.asc("gram")], size + 1), "frontier")
        return best.filter(F.col("rank") <= size), best.filter(F.col("rank") > size).select("lang", F.col("bound").alias("kb"), F.col("a").alias("ka"), F.col("gram").alias("kg"))

    def _above(self, rows: DataFrame, limit: DataFrame, by: str) -> DataFrame:
        """Rows that rank above their language's first pair left; all where none is left."""
        value = F.col("cut.score") if by == "score" else F.col("bound")
        rows = rows.join(limit.select("lang", "kb", "ka"), "lang", "left")
        return rows.filter(F.col("kb").isNull() | (value > F.col("kb")) | ((value == F.col("kb")) & (F.col("a") > F.col("ka")))).drop("kb", "ka")

    def _survivors(self, limit: DataFrame, triples: DataFrame) -> DataFrame:
        """(lang, gram, a, cut) of the candidates above the limit that lie in no longer candidate of SHARE % of their count."""
        quads = self._quad_scores(triples)
        out = self._above(quads, limit, "score").select("lang", "gram", "a", "cut")
        for rows, longer, size in ((triples, self.quads, 3), (self.pairs, self.triples, 2)):
            ends = F.explode(F.array_distinct(F.array(_words(0, size - 1), _words(1, size))))
            around = longer.select("lang", ends.alias("gram"), "n").groupBy("lang", "gram").agg(F.max("n").alias("around"))
            mine = self._above(rows, limit, "score").select("lang", "gram", "a", "cut").join(around, ["lang", "gram"], "left")
            kept = F.col("around").isNull() | (_exact("around") * 100 < _exact("a") * SHARE)
            out = out.unionByName(mine.filter(kept).drop("around"))
        return out

    def run(self) -> DataFrame:
        settled, frontier = None, self.pairs
        langs = self.scratch.write(self.pairs.select("lang").distinct(), "languages")
        while True:
            names = _few(langs)
            taken, limit = self.step(frontier, langs)
            limit = _few(limit)
            docs = self.docs.join(names, "lang", "left_semi")
            self.triples = self._more(self.triples, self._passes(3, taken, docs), "triples")
            triples = self.scratch.write(self._triple_scores(), "triple-scores")
            grown = self._above(triples.join(names, "lang", "left_semi"), limit, "bound").select("lang", "gram")
            if self.expanded is not None:
                grown = grown.join(self.expanded, ["lang", "gram"], "left_anti")
            grown = self.scratch.write(grown, "grown")
            self.expanded = grown if self.expanded is None else self.expanded.unionByName(grown)
            self.quads = self._more(self.quads, self._passes(4, grown, docs), "quads")
            found = self.scratch.write(self._survivors(limit, triples).join(names, "lang", "left_semi"), "survivors")
            best = self.scratch.write(_top(found, [F.desc("cut.score"), F.desc("a"), F.asc("gram")], self.top), "best")
            enough = best.groupBy("lang").count().filter(F.col("count") >= self.top).select("lang")
            open_ = self.scratch.write(langs.join(limit.select("lang"), "lang", "left_semi").join(enough, "lang", "left_anti"), "open")
            done = best.join(_few(open_), "lang", "left_anti")
            settled = done if settled is None else settled.unionByName(done)
            if open_.isEmpty():
                return settled
            after = limit.join(F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_, "lang", "left_semi")
            left = self.pairs.join(_few(after), "lang")
            behind = (F.col("bound") < F.col("kb")) | ((F.col("bound") == F.col("kb")) & ((F.col("a") < F.col("ka")) | ((F.col("a") == F.col("ka")) & (F.col("gram") >= F.col("kg")))))
            frontier, langs = left.filter(behind).drop("kb", "ka", "kg"), open_


def mine_phrases(docs: DataFrame, top: int = TOP, frontier: int = FRONTIER, least: int = LEAST) -> DataFrame:
    """Each language's best phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    docs: text, lang and any other columns (ignored).  A-Z is lower-cased; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words
    at spaces and tabs.  Null text counts as empty, a null language as ``und``; every row counts, repeated ones too.
    Candidates occur ``least`` times; those inside a longer candidate of SHARE % of their count are dropped.  Ties in
    score and count go by the phrase's bytes.  A language without candidates has no rows; an empty table gives an
    empty table.  ``frontier`` bounds what one pass looks for, and changes nothing else.
    """
    miner = Miner(docs, top, frontier, least)
    found = miner.run().join(_few(miner.totals), "lang")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
