"""Packing by cutting-stock column generation.

Every document is cut into pieces of ``capacity`` tokens and a remainder.  Piece lengths, rounded up to a
grid, form a histogram of fixed size.  A linear program over *patterns* (multisets of lengths that fit in
a sequence) covers the histogram with the fewest sequences; a knapsack dynamic program over its dual
prices finds the next pattern worth adding (Gilmore and Gomory 1961).  The solution is rounded down, the
few pieces left are packed greedily, and pattern slots are dealt to pieces by their rank within a length.

Only the histogram (at most capacity / grid counts) is on the driver.  Ranks come from salted windows:
rows of one length are spread over as many salts as its own count asks for, and the salts' counts, a table
of bounded size, give each salt its first rank.
"""

from __future__ import annotations

import re
import warnings
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_groups, map_arrow, remember
from .unit_memo import UnitMemo

CAPACITY = 4096
GRID = 8
GAP = 5e-4  # column generation stops at this relative distance from the lower bound
SALT_ROWS, SALTS = 128, 8192  # a salt of a size has about 1 in SALTS of all pieces, SALT_ROWS at least

_MEMO: dict[str, UnitMemo | WholeTexts] = {}
_LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
#: One of each kind for the probes: every letter and mark that units are cut at, digits, and others.
_PROBE_LETTERS = [*map(chr, [*range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])]
_PROBE_MARKS = [c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'"]


def _cuts(tokenizer) -> tuple[bool, bool]:
    """Whether words, and units within words, are encoded apart: all small cases are tried on the tokenizer itself."""
    ids = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    some = ["a", "th", "\xe9", "1", ".", "'s", "'", "\u6f22", "#$"]
    alone = dict(zip(some, ids(some), strict=True))
    pairs = [(x, w, y) for x in some for y in some for w in (" ", "\t", "\n", "\x0b", "\x0c", "\r", " \n ")]
    words = all(got == alone[x] + alone[y] for (x, _, y), got in zip(pairs, ids([x + w + y for x, w, y in pairs]), strict=True))
    parts = [(x, m) for x in _PROBE_LETTERS for m in [*_PROBE_MARKS, *"0123456789"]] + [(m, x) for m in _PROBE_MARKS for x in _PROBE_LETTERS]
    parts += [("letters", "!!"), ("!?", "letters"), ("letters", "12")]
    every = dict.fromkeys(c for p in parts for c in p)
    alone = dict(zip(every, ids(list(every)), strict=True))
    units = all(got == alone[x] + alone[y] for (x, y), got in zip(parts, ids([x + y for x, y in parts]), strict=True))
    return words, words and units


def _encoder(path: str) -> UnitMemo | WholeTexts:
    """Ids by the tokenizers library: units of words through a memo, or a function of whole texts.

    Where the vocabulary's normalizer and pre-tokenizer never look across ASCII white space, and drop it, a
    text's ids are its words' ids in a row; where they keep letters and punctuation apart too, a word's ids are
    its units' ids.  Both are tried on the tokenizer when it is loaded; another one gets whole words or texts.
    """
    if path not in _MEMO:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        vocabulary = tokenizer.get_vocab()
        words, cut = _cuts(tokenizer)
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        ended = cut and all(ends[x.ids].tolist() == [False] * (len(x.ids) - 1) + [True] for x in tokenizer.encode_batch_fast(_PROBE_LETTERS, add_special_tokens=False))

        def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            texts = [u.decode() for u in units]
            out: list = [None] * len(units)
            plain = [i for i, x in enumerate(texts) if _LETTERS.fullmatch(x)] if ended else []
            for lo in range(0, len(plain), 2000):  # many units of letters in one call: the last token of each is a word end
                some = plain[lo : lo + 2000]
                ids = np.asarray(tokenizer.encode_batch_fast([" ".join([texts[i] for i in some])], add_special_tokens=False)[0].ids, np.uint32)
                stop = np.flatnonzero(ends[ids]) + 1
                if len(stop) == len(some):
                    for i, a, b in zip(some, [0, *stop[:-1].tolist()], stop.tolist(), strict=True):
                        out[i] = ids[a:b]
            rest = [i for i, x in enumerate(out) if x is None]
            for i, x in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.asarray(x.ids, np.uint32)
            return np.concatenate([np.zeros(0, np.uint32), *out]), np.array([len(x) for x in out], np.int64)

        if words:
            _MEMO[path] = UnitMemo(encode, np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32, cut)
        else:
            _MEMO[path] = WholeTexts(encode)
        remember("packing", _MEMO.clear)
    return _MEMO[path]


class WholeTexts:
    """Ids of whole texts, for tokenizers that look across white space."""

    def __init__(self, encode):
        self.encode = encode

    def ids(self, data: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        flat, n = self.encode([data[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        bounds = np.concatenate(([0], np.cumsum(n)))
        if end_id is not None:
            flat, bounds = np.insert(flat, bounds[1:], end_id), bounds + np.arange(len(bounds))
        return flat.astype("<u4", copy=False), bounds


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens (and ids, little-endian uint32).

    A document is its ids and then ``end_id``; null text counts as empty, so that every row has a piece.
    """
    import pyarrow as pa

    def run(batches):
        memo = _encoder(tokenizer_path)
        for batch in batches:
            ids_of = batch.column("doc_id")
            for at, data, off in byte_groups(batch.column("text"), 1 << 19):
                flat, bounds = memo.ids(data, off, end_id)
                rows = {k: [] for k in ("doc", "start", "length", "crc", "total", "ids")}
                for i in range(len(off) - 1):
                    one = flat[bounds[i] : bounds[i + 1]]
                    for start in range(0, len(one), capacity):
                        raw = one[start : start + capacity].tobytes()
                        for k, v in zip(rows, (at + i, start, len(raw) // 4, zlib.crc32(raw), len(one), raw if with_ids else None), strict=True):
                            rows[k].append(v)
                arrays = [ids_of.take(pa.array(rows["doc"], pa.int64()))] + [pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc", "total")]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(rows["ids"], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, schema, memo="packing")


# ---------------------------------------------------------------------------------------------------
# The cutting-stock program; sizes are 1..slots in units of the grid


def _best_pattern(value: np.ndarray, sizes: np.ndarray, slots: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of sizes within ``slots`` of the greatest total value."""
    gain = np.zeros(slots + 1)
    np.maximum.at(gain, sizes, value)
    item = np.full(slots + 1, -1)
    for i, s in enumerate(sizes):
        if value[i] > 0 and gain[s] == value[i]:
            item[s] = i
    best, pick = np.zeros(slots + 1), np.full(slots + 1, -1)
    for c in range(1, slots + 1):
        total = gain[1 : c + 1] + best[c - 1 :: -1] if c else None
        k = int(np.argmax(total))
        if total[k] > best[c - 1] and item[k + 1] >= 0:
            best[c], pick[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes)), slots
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[item[pick[c]]] += 1
            c -= pick[c]
    return float(best[slots]), counts


def solve_patterns(demand: dict[int, int], slots: int, gap: float = GAP) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: count}) patterns of at most ``slots`` that hold at least ``demand`` of every size.

    Column generation on the covering program, then rounding down and a greedy fill of the rest.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if s > 0 and n > 0), int)
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes], float)
    m = len(sizes)
    fit = (slots // sizes).astype(float)
    columns, cost = [np.eye(m)[i] * fit[i] for i in range(m)], np.ones(m)
    inverse, x = np.diag(1 / fit), need / fit
    for _ in range(40 * m + 1000):
        price = cost @ inverse
        spare = int(np.argmin(price))
        if price[spare] < -1e-9:  # covering more than asked is allowed
            column, c = -np.eye(m)[spare], 0.0
        else:
            worth, column = _best_pattern(price, sizes, slots)
            if worth <= 1 + 1e-9 or (cost @ x) * (1 - 1 / worth) <= max(gap * (cost @ x), 0.5):
                break
            c = 1.0
        step = inverse @ column
        ratio = np.where(step > 1e-10, x / np.maximum(step, 1e-10), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out], cost[out] = column, c
    else:
        warnings.warn("column generation was ended before it came within its gap; all pieces are packed, with more padding", stacklevel=2)
    found: dict[tuple, int] = {}
    left = need.astype(int)
    for times, column, c in zip(np.floor(x + 1e-7).astype(int), columns, cost, strict=True):
        if c and times > 0:
            key = tuple((int(sizes[i]), int(column[i])) for i in np.flatnonzero(column)[::-1])
            found[key] = found.get(key, 0) + int(times)
            left = left - int(times) * column.astype(int)
    left = np.maximum(left, 0)
    while left.any():
        room, pattern = slots, []
        for i in range(m - 1, -1, -1):
            k = min(int(left[i]), room // int(sizes[i]))
            if k:
                pattern.append((int(sizes[i]), k))
                room -= k * int(sizes[i])
        times = max(1, min(int(left[np.searchsorted(sizes, s)]) // k for s, k in pattern))
        for s, k in pattern:
            left[np.searchsorted(sizes, s)] -= k * times
        left = np.maximum(left, 0)
        found[tuple(pattern)] = found.get(tuple(pattern), 0) + times
    return [(n, dict(p)) for p, n in found.items()]


def _slot_table(patterns: list[tuple[int, dict[int, int]]], slots: int) -> dict[str, np.ndarray]:
    """For every size, which ranks go to which pattern: sorted by size and first rank."""
    rows, seq, given = [], 0, {}
    for times, pattern in patterns:
        slot = 0
        for s, k in sorted(pattern.items(), reverse=True):
            low = given.get(s, 0)
            rows.append((s, low, k, seq, slot))
            given[s] = low + times * k
            slot += k
        seq += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("size", "low", "per", "seq", "slot"))}


def pack(pieces: DataFrame, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """The pieces with sequence_id and offset; sequences hold at most ``capacity`` tokens.

    Pieces of one sequence lie one after the other from offset 0, the longest first, so all padding is at
    its end.  Every piece is placed exactly once, equal rows too; sequence ids are 0..n-1 unless the
    covering solution leaves a spare pattern empty.  Other columns are carried through, whatever their names;
    columns named sequence_id or offset are replaced.  An empty table gives an empty table.
    """
    import pyarrow as pa

    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    carried = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    sized = scratch.write(pieces.select(*carried, F.ceil(F.col("length") / grid).cast("int").alias("_pk_size")), "pieces")
    slots = capacity // grid
    demand = {r["_pk_size"]: r["n"] for r in sized.groupBy("_pk_size").agg(F.count("*").alias("n")).collect()}  # <= slots rows
    table = _slot_table(solve_patterns(demand, slots), slots)
    key = (table["size"] << 44) + table["low"]

    per_salt = max(SALT_ROWS, -(-sum(demand.values()) // SALTS))
    salts = spark.createDataFrame([(s, -(-n // per_salt)) for s, n in demand.items()], "_pk_size int, _pk_salts long")
    order = [c for c in ("doc_id", "start", "ids_crc32", "doc_tokens") if c in carried]
    salted = sized.join(F.broadcast(salts), "_pk_size").withColumn("_pk_salt", F.pmod(F.xxhash64(*order), F.col("_pk_salts")))
    counts = salted.groupBy("_pk_size", "_pk_salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_pk_size").orderBy("_pk_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_pk_size", "_pk_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_pk_first"))
    first = scratch.write(first, "first-ranks")  # at most SALTS + slots rows

    within = Window.partitionBy("_pk_size", "_pk_salt").orderBy(*order)
    ranked = salted.withColumn("_pk_rank", F.row_number().over(within) - 1).join(F.broadcast(first), ["_pk_size", "_pk_salt"])
    ranked = ranked.select(*carried, "_pk_size", (F.col("_pk_rank") + F.col("_pk_first")).alias("_pk_rank"))

    def deal(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("_pk_size", "_pk_rank"))
            i = np.searchsorted(key, (size << 44) + rank, "right") - 1
            nth = rank - table["low"][i]
            seq, slot = table["seq"][i] + nth // table["per"][i], table["slot"][i] + nth % table["per"][i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(seq), pa.array(slot)], names=[*carried, "sequence_id", "_pk_slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema if f.name in carried)
    dealt = map_arrow(ranked, deal, f"{fields}, sequence_id long, _pk_slot long")
    along = Window.partitionBy("sequence_id").orderBy("_pk_slot").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long")).select(*carried, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, grid: int = GRID, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack whole documents: one row per piece.

    docs: doc_id, text and any other columns (ignored).  Null text counts as empty and becomes the end id
    alone; a null doc_id is carried through; repeated rows are packed as often as they occur.
    """
    return pack(tokenize(docs, tokenizer_path, end_id, capacity, with_ids), capacity, grid)
