"""Line deduplication by range-partitioned hashes.

Line keys are hashed to 128 bits and range-partitioned by (hash, document, position), each partition
sorted: the first row of a hash is its first occurrence, and every row of the hash with another document
is dropped as the partition streams by.  The range includes the document, so a line that very many
documents share is spread over as many partitions as it needs; a hash that runs on from the partition
before is settled afterwards from one summary row per partition.

The result is not text but, per document, a compressed bitmap of the lines to keep.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, map_arrow

MIN_KEY = 10  # code points of a key below which lines always stay
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 8 << 20  # bitmaps are broadcast up to this many and this large, shuffled beyond
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def _stream_first(rows: DataFrame) -> DataFrame:
    """Rows that are not of their hash's first document, in one pass over sorted partitions.

    Rows of a partition's first hash come out as ``head``: whether they stay depends on partitions
    before.  One row per partition with ``pos`` null tells its first and last hash and their documents.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["part", "doc_id", "th", "pos", "head", "h1", "h2", "ord", "last1", "last2", "last_ord"]

    def run(batches):
        part, start, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not len(batch):
                continue
            h1, h2, at = (batch.column(c).to_numpy() for c in ("h1", "h2", "ord"))
            if start is None:
                start = last = (h1[0], h2[0], at[0])
            new = np.concatenate(([(h1[0], h2[0]) != last[:2]], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            where = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first = np.where(where >= 0, at[where], last[2])
            head = (h1 == start[0]) & (h2 == start[1])
            last = (h1[-1], h2[-1], first[-1])
            keep = np.flatnonzero(head | (at != first))
            if len(keep):
                some = batch.take(pa.array(keep))
                blank = pa.nulls(len(keep), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keep), part)), some.column("doc_id"), some.column("th"), some.column("pos").cast(pa.int64()), pa.array(head[keep]),
                     blank, blank, some.column("ord"), blank, blank, blank], names=names,
                )
        if start is not None:
            none = pa.nulls(1, pa.int64())
            tell = [pa.array([int(x)], pa.int64()) for x in (*start, *last)]
            yield pa.RecordBatch.from_arrays([pa.array([part]), none, none, none, pa.array([False]), *tell], names=names)

    schema = "part long, doc_id long, th long, pos long, head boolean, h1 long, h2 long, ord long, last1 long, last2 long, last_ord long"
    return map_arrow(rows, run, schema)


def dropped_lines(docs: DataFrame, scratch: Scratch, min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, th, pos) of every line that another document holds first; docs has doc_id, th, text."""
    spark = docs.sparkSession
    lines = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    rows = lines.select(
        "doc_id", "th", "pos", key.alias("key"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("ord")
    ).filter(F.length("key") >= min_key)
    rows = rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "ord", "doc_id", "th", "pos")
    rows = scratch.write(rows, "hashed-lines")  # read for the ranges' bounds and for the ranges
    order = ("h1", "h2", "ord", "th", "pos")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = scratch.write(_stream_first(sorted_rows), "later-lines")
    scratch.drop(rows)
    # one summary row per partition; a hash that runs over partitions keeps the document it began with
    carry, open_ = [], None
    for s in found.filter("pos is null").orderBy("part").collect():
        first = (s["h1"], s["h2"])
        if open_ and open_[0] == first:
            carry.append((s["part"], open_[1]))
        else:
            open_ = (first, s["ord"])
        if (s["last1"], s["last2"]) != first:
            open_ = ((s["last1"], s["last2"]), s["last_ord"])
    heads = {r["part"]: r["ord"] for r in found.filter("pos is null").select("part", "ord").collect()} | dict(carry)
    started = spark.createDataFrame(sorted(heads.items()), "part long, began long")
    rest = found.filter("pos is not null")
    late = rest.filter("head").join(F.broadcast(started), "part").filter("ord <> began")
    return rest.filter("not head").select("doc_id", "th", "pos").union(late.select("doc_id", "th", "pos"))


def keep_bitmaps(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, th, n_dropped, keep_bitmap) of the documents that lose lines.

    docs: doc_id, text and any other columns (ignored).  Texts are split at \\n; null and empty texts are
    one empty line.  A key of at least ``min_key`` code points that two or more documents hold keeps its
    lines only in the smallest doc_id; a null doc_id counts as one document after all others.  Rows with
    one doc_id are one document: none loses a line to another, and repeated rows share their bitmap.
    ``th`` is xxhash64 of the text.  ``keep_bitmap``: zlib-compressed bits, low bit first, 1 for keep, up to
    the last dropped line; later lines stay.  Documents without a row keep all lines.
    """
    import pyarrow as pa

    scratch = Scratch(docs.sparkSession, "line-dedup")
    rows = _hashed(docs)
    per_doc = dropped_lines(rows, scratch, min_key).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("pos"))

    def squeeze(batches):
        for batch in batches:
            maps = []
            for pos in batch.column("pos").to_pylist():
                bits = np.ones((pos[-1] // 8 + 1) * 8, np.uint8)
                bits[pos] = 0
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            size = [len(p) for p in batch.column("pos").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(size, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "th", "n_dropped", "keep_bitmap"]
            )

    return scratch.write(map_arrow(per_doc, squeeze, "doc_id long, th long, n_dropped long, keep_bitmap binary"), "bitmaps")


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))


def read_bitmap(packed: bytes, n_lines: int) -> np.ndarray:
    """Which of ``n_lines`` lines stay."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little")[:n_lines].astype(bool)
    return np.concatenate((bits, np.ones(n_lines - len(bits), bool)))


def deduplicate_lines(docs: DataFrame, min_key: int = MIN_KEY, with_text: bool = False) -> DataFrame:
    """Apply the bitmaps: doc_id, n_lines, n_dropped, kept_sha256 (and kept_text) for every row."""
    import pyarrow as pa

    maps = keep_bitmaps(docs, min_key).withColumnsRenamed({"doc_id": "d", "th": "t"})
    size = maps.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("keep_bitmap")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES:
        maps = F.broadcast(maps)
    rows = _hashed(docs)
    rows = rows.join(maps, rows.doc_id.eqNullSafe(F.col("d")) & (rows.th == F.col("t")), "left").select("doc_id", "text", "n_dropped", "keep_bitmap")

    def run(batches):
        for batch in batches:
            n, digest, kept = [], [], []
            for text, packed in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist(), strict=True):
                if packed is None:
                    n.append(text.count("\n") + 1)
                else:
                    lines = text.split("\n")
                    n.append(len(lines))
                    text = "\n".join([line for line, keep in zip(lines, read_bitmap(packed, len(lines)), strict=True) if keep])
                digest.append(hashlib.sha256(text.encode()).hexdigest())
                kept.append(text if with_text else None)
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("n_dropped").fill_null(0), pa.array(digest, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_arrow(rows, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text)
