"""Compression of vectors to short codes: one codebook for each of a vector's parts, by member-resident Lloyd rounds.

A vector's components become integers and are cut into consecutive parts.  The parts are rows of their own that live
in files dealt by (position, entry, salt): the parts of one codebook entry lie together.  In a round

1. each task adds up the parts that reside in its files, entry by entry; Spark sums these few rows, and the
   entries' new values (a table of bounded size: positions x entries) go to the driver and on with the tasks;
2. every resident part looks for its nearest entry.  Parts that keep their entry are written where they are, without
   a shuffle; those that change it are written apart;
3. only the latter are shuffled, to the owners of their new entries.

The number of salts of an entry follows its share of all parts, so that an entry with a third of them is owned by as
many tasks as any other third.  Sums, means and distances are exact integers.  The codes themselves are one more pass
over the vectors with the final codebooks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

POSITIONS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components beyond are drawn to it, so that squared distances of up to 1,024 components fit 63 bits.
BOUND = 1 << 25
SPREAD = 4  # owners for each shuffle partition, were all parts of equal weight
BROADCAST_ROWS = 100_000  # labels with their sums (some 20 bytes each) are broadcast up to this many, shuffled beyond

PARTS = "position int, entry int, rid long, part array<long>"


def scaled(vector: Column) -> Column:
    """floor(SCALE * x) of each component, as a long within BOUND."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(BOUND)), F.lit(-BOUND)).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null, NaN or infinite components."""
    fine = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


@dataclass(frozen=True)
class Codebooks:
    """Entries by (position, index, component); ``size`` entries of each position are in use."""

    values: np.ndarray

    @property
    def width(self) -> int:
        return self.values.shape[2]

    def nearest(self, position: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part's nearest entry; ties go to the lower index."""
        book = self.values[position]
        index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        most = max(int(np.abs(book).max(initial=0)), int(np.abs(parts).max(initial=0)), 1)
        exact = 4 * most * most * max(self.width, 1) < 1 << 52  # then floating products of integers are exact
        for lo in range(0, len(parts), 2048 if exact else 64):
            x = parts[lo : lo + (2048 if exact else 64)]
            if exact:
                f, b = x.astype(np.float64), book.astype(np.float64)
                d = (f * f).sum(axis=1)[:, None] - 2 * (f @ b.T) + (b * b).sum(axis=1)
            else:
                d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            best = d.argmin(axis=1)
            index[lo : lo + len(x)] = best
            error[lo : lo + len(x)] = d[np.arange(len(x)), best].astype(np.int64)
        return index, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _assigned(parts: DataFrame, books: Codebooks) -> DataFrame:
    """The parts with their nearest entry, and whether it is another one than before."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            position, before = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            x, entry = _matrix(batch.column("part"), books.width), np.zeros(len(batch), np.int32)
            for p in np.unique(position).tolist():
                rows = np.flatnonzero(position == p)
                entry[rows] = books.nearest(p, x[rows])[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("position"), pa.array(entry), batch.column("rid"), batch.column("part"), pa.array(entry != before)],
                names=["position", "entry", "rid", "part", "moved"],
            )

    return map_arrow(parts, run, f"{PARTS}, moved boolean")


def _means(resident: DataFrame, books: Codebooks) -> tuple[Codebooks, np.ndarray]:
    """The codebooks after one update, floor(sum / count) of each entry's parts, and the entries' sizes; unused ones stay."""
    import pyarrow as pa

    positions, entries, width = books.values.shape

    def run(batches):
        sums, sizes = np.zeros((positions * entries, width), np.int64), np.zeros(positions * entries, np.int64)
        for batch in batches:
            owner = batch.column("position").to_numpy().astype(np.int64) * entries + batch.column("entry").to_numpy()
            x = _matrix(batch.column("part"), width)
            order = np.argsort(owner, kind="stable")
            first = np.flatnonzero(np.diff(owner[order], prepend=-1))
            if len(first):
                sums[owner[order][first]] += np.add.reduceat(x[order], first, axis=0)
            sizes += np.bincount(owner, minlength=len(sizes))
        for k in np.flatnonzero(sizes).tolist():
            cell = np.arange(width + 1, dtype=np.int32)
            values = pa.array(np.append(sums[k], sizes[k]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, k, np.int32)), pa.array(cell), values], names=["owner", "cell", "value"])

    found = map_arrow(resident, run, "owner int, cell int, value long").groupBy("owner", "cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total = np.zeros((positions * entries, width + 1), object)
    for owner, cell, value in found.collect():  # positions * entries * (width + 1) rows at most
        total[owner, cell] = int(value)
    values, sizes = books.values.copy().reshape(-1, width), total[:, width]
    used = np.flatnonzero(sizes > 0)
    values[used] = (total[used, :width] // sizes[used, None]).astype(np.int64)
    return Codebooks(values.reshape(books.values.shape)), sizes.astype(np.int64)


class Residents:
    """The parts in files of their owners: those that stayed in the last round, and those that migrated."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.spark, self.rows, self.old = scratch, scratch.spark, None, []

    def settle(self, parts: DataFrame, books: Codebooks) -> None:
        """Assign all parts; the movers, and they alone, are shuffled to the files of their new owners."""
        assigned = self.scratch.path("assigned")
        _assigned(parts, books).write.partitionBy("moved").parquet(assigned)
        both = self.spark.read.schema(f"{PARTS}, moved boolean").parquet(assigned)
        moving, staying = both.filter("moved").drop("moved"), both.filter("not moved").drop("moved")
        sizes = moving.groupBy("position", "entry").count().collect()  # positions * entries rows at most
        total = sum(r["count"] for r in sizes)
        rows, gone = staying, [assigned]
        if total:
            owners = SPREAD * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            salts = [(r["position"], r["entry"], -(-owners * r["count"] // total)) for r in sizes]
            salts = F.broadcast(self.spark.createDataFrame(salts, "position int, entry int, salts long"))
            dealt = moving.join(salts, ["position", "entry"]).withColumn("salt", F.pmod(F.xxhash64("rid"), "salts"))
            migrated = self.scratch.path("migrated")
            dealt.repartition("position", "entry", "salt").drop("salt", "salts").select("position", "entry", "rid", "part").write.parquet(migrated)
            rows = staying.unionByName(self.spark.read.schema(PARTS).parquet(migrated))
            gone.append(migrated)
        for path in self.old:
            self.scratch.remove(path)
        self.rows, self.old = rows, gone


def train(vectors: DataFrame, books: Codebooks, scratch: Scratch, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after ``rounds`` of assignment and update over all of ``vectors`` (rid, v)."""
    width = books.width
    cut = F.array(*[F.struct(F.lit(p).alias("position"), F.slice("v", p * width + 1, width).alias("part")) for p in range(books.values.shape[0])])
    fresh = vectors.select("rid", F.explode(cut).alias("c")).select("c.position", F.lit(-1).alias("entry"), "rid", "c.part")
    residents = Residents(scratch)
    for k in range(rounds):
        residents.settle(residents.rows if k else fresh, books)
        books, _ = _means(residents.rows, books)
    for path in residents.old:
        scratch.remove(path)
    return books


def initial_codebooks(vectors: DataFrame, positions: int = POSITIONS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the smallest distinct vec_ids, ascending; None without any."""
    ids = vectors.select("vec_id").filter("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()
    if not ids:
        return None
    first = vectors.filter(F.col("vec_id") <= ids[-1]["vec_id"]).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    v = np.array([r["v"] for r in sorted(first, key=lambda r: r["vec_id"])], np.int64)
    return Codebooks(np.ascontiguousarray(v.reshape(len(v), positions, -1).swapaxes(0, 1)))


def compress(embeddings: DataFrame, rounds: int = ROUNDS, positions: int = POSITIONS, entries: int = ENTRIES) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row.

    embeddings: vec_id, embedding (an array of floats), label and any other columns (ignored).  Rows whose vector is
    null or holds null, NaN or infinite components are dropped, and so are those whose length is not that of the
    longest usable vector or not a positive multiple of ``positions``.  Components beyond BOUND / SCALE are drawn to
    it.  Codebooks begin as the parts of the ``entries`` smallest vec_ids (of rows that repeat a vec_id, the smallest
    vector's; fewer vectors, fewer entries); rows with a null vec_id are coded but never begin an entry, and without
    any other row the result is empty.  Repeated rows count each and get the same code.  Null labels are one label.
    An empty table gives an empty table.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "vector-codes")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").alias("e")).filter(usable(F.col("e")))
    rows = rows.select("vec_id", "label", scaled(F.col("e")).alias("v")).filter((F.size("v") > 0) & (F.size("v") % positions == 0))
    rows = scratch.write(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    out = "vec_id long, label string, code string, error long"
    books = initial_codebooks(rows.filter(F.size("v") == width), positions, entries) if width else None
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = rows.filter(F.size("v") == width)
    books = train(rows.select("rid", "v"), books, scratch, rounds)
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), width).reshape(len(batch), positions, -1)
            codes, error = [], np.zeros(len(batch), np.int64)
            for p in range(positions):
                entry, d = books.nearest(p, np.ascontiguousarray(x[:, p]))
                codes.append(entry)
                error += d
            code = ["".join(f"{i:02x}" for i in row) for row in np.stack(codes, axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error)], names=["vec_id", "label", "code", "error"])

    coded = scratch.write(map_arrow(rows.select("vec_id", F.col("label").cast("string").alias("label"), "v"), run, out), "codes")
    sums = scratch.write(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same")), "left").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
