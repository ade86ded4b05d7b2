"""Shared helpers: tables in the cluster's shared folder, text batches as NumPy arrays, word memo."""

from __future__ import annotations

import gc
import re
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder, remove_folder, shared_dir  # noqa: F401

#: ASCII white space of every contract: space and \t \n \v \f \r.
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


#: Bytes of one Arrow batch; a task holds a few of them, in the JVM and in Python.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def release_memory() -> None:
    """Give freed memory back to the system: idle Python workers stay for later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What a worker remembers between tasks, by operator: how to forget it.
_MEMOS: dict = {}


def remember(owner: str, forget) -> None:
    """Register a worker's memo; a task of another operator forgets it before it begins."""
    _MEMOS[owner] = forget


def _trimmed(batches):
    """The batches; after every few MB of them, freed memory goes back at once."""
    done = 0
    for batch in batches:
        yield batch
        done += batch.nbytes
        if done >= BATCH_BYTES:
            done = 0
            release_memory()


def forget_others(owner: str) -> None:
    for k in [k for k in _MEMOS if k != owner]:
        _MEMOS.pop(k)()


def map_arrow(df: DataFrame, fn, schema, memo: str = "") -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors and batches of at most BATCH_BYTES.

    Workers live on between stages: ``memo`` names the memo that this operator's tasks go on with.

    The session's larger batch size is lowered, since batches are what a task's memory is made of.
    """
    spark = df.sparkSession
    ship(spark)
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", spark.conf.get(_BATCH_SETTING).lower()).groups()
    size = int(number) << 10 * " kmgtp".index(unit or " ")
    if size > BATCH_BYTES or size <= 0:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")

    def run(batches):
        forget_others(memo)
        gc.disable()  # batches make no reference cycles, and the collector would walk the word memos again and again
        try:
            yield from fn(_trimmed(batches))
        finally:
            gc.enable()
            release_memory()

    return df.mapInArrow(run, schema)


class Scratch:
    """Named intermediate tables of one operator call, written as Parquet in the shared folder.

    Writing a table cuts the lineage and survives the loss of any executor.  ``drop`` removes a table
    that nothing reads any more; results of operators read the others, which ``owned_folders`` removes
    for the caller that made them.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = new_folder(spark, label)
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def remove(self, path: str) -> None:
        remove_folder(self.spark, path)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.remove(df._scratch_path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, lengthened where ``df`` has a column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, UPPER, LOWER)


def crc32_mod(c: Column, n: int) -> Column:
    """crc32 of the value's decimal text, modulo n (null: null)."""
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


# ---------------------------------------------------------------------------------------------------
# Arrow string columns as NumPy arrays


def byte_groups(column, limit: int = 1 << 20):
    """Yield (first row, byte array, row offsets) over an Arrow string column, null as empty.

    Rows are grouped up to ``limit`` bytes, a longer row alone, so that arrays derived from a group
    stay small whatever the Arrow batch holds.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if len(column) == 0:
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Polynomials modulo this prime, in lanes with a random base and random byte values each; a family has two lanes.
PRIME, FAMILIES = (1 << 31) - 1, 2
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, PRIME, (2 * FAMILIES, 256), dtype=np.uint64)
_BASE = [int(x) for x in _RANDOM.integers(1 << 20, PRIME - 1, 2 * FAMILIES)]
_STEP = 1 << 15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same remainder modulo PRIME."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the lane's base and of its inverse, modulo PRIME."""
    if lane not in _POWERS or len(_POWERS[lane][0]) < n:
        size, tables = 1 << int(n - 1).bit_length(), []
        for base in (_BASE[lane], pow(_BASE[lane], -1, PRIME)):
            table = np.ones(size, np.uint32)
            k = 1
            while k < size:
                table[k : 2 * k] = table[:k].astype(np.uint64) * np.uint64(pow(base, k, PRIME)) % np.uint64(PRIME)
                k *= 2
            tables.append(table)
        _POWERS[lane] = tuple(tables)
    return _POWERS[lane]


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); another function for each salt."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, off: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, runs without ``blank`` bytes, and each row's first word (with the total last)."""
    solid = ~blank[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    starts = solid & np.concatenate(([True], ~solid[:-1])) if len(data) else solid
    starts |= solid & first[:-1]
    ends = solid & (np.concatenate((~solid[1:], [True])) | first[1:]) if len(data) else solid
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


class SpanHasher:
    """64-bit hashes of byte spans: two polynomials modulo a prime, from differences of running sums.

    Two different spans of at most n bytes meet with probability (n / 2**31)**2 at most over the random bases, whatever
    their bytes.  Families are independent of each other.
    """

    def __init__(self, data: np.ndarray, family: int = 0):
        prime, bits, n = np.uint64(PRIME), np.uint64(31), len(data)
        self.family, self.lanes = family, []
        term, high = np.empty(_STEP, np.uint64), np.empty(_STEP, np.uint64)
        for lane in (2 * family, 2 * family + 1):
            power, inverse = _powers(n + 1, lane)
            run = np.zeros(n + 1, np.uint64)
            for a in range(0, n, _STEP):  # small blocks stay in the processor's cache
                b = min(a + _STEP, n)
                t, h = term[: b - a], high[: b - a]
                np.take(_BYTE[lane], data[a:b], out=t)
                np.multiply(t, power[a:b], out=t)
                np.right_shift(t, bits, out=h)
                np.bitwise_and(t, prime, out=t)
                t += h
                t[0] += run[a]
                np.cumsum(t, out=run[a + 1 : b + 1])
            self.lanes.append((run, inverse))

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        high, low = (_fold(_fold(run[e] - run[s])) * inverse[s] % np.uint64(PRIME) for run, inverse in self.lanes)
        return mix64(high << np.uint64(32) | low, self.family)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, family: int = 0) -> np.ndarray:
    return SpanHasher(data, family)(s, e)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
