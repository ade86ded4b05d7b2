"""Near-duplicate detection: MinHash bands propose, odd sketches screen, full shingle sets decide.

An odd sketch (Mitzenmacher, Pagh, Pham 2014) folds a document's MinHash samples into a bitmap in which
every sample toggles one bit.  The population count of two sketches' XOR estimates how many samples
differ, precisely so for similar sets, so that few pairs from the bands need their texts.

Steps, each a Spark job over tables in the shared folder:

1. one pass over the texts makes, per row, the size and a 128-bit digest of its shingle set, band keys and
   the odd sketch; rows with equal sets become one node, so exact copies cost nothing afterwards;
2. *hub round*: in each band bucket every node is paired with the bucket's smallest node only;
3. pairs that survive the size bound and the sketch are confirmed on the full sets of the two texts, and
   confirmed links are contracted to components;
4. *rest round*: buckets that still hold more than one component are compared by sketch, in blocks of
   bounded size, across components only.  A block gives a spanning forest of its candidates, whose
   connected components are *families*: every link still unknown lies within one.  The shingles that a family's
   members share are numbered, and each member becomes a bitmap of these numbers (or a list of them, if shorter):
   a shingle that one member alone holds is in no intersection.  Members are compared on these full sets, again
   in blocks and across components only; no text is moved more than once.

Nothing is dropped: a bucket or family of any size is covered, the large ones in many tasks, and no step
emits more than a few rows per document and block, however many pairs are similar.

Sets are made of 64-bit hashes.  What is proposed by one family of hash functions is confirmed by another, and
the digest that makes rows one node has a half of each, so that no collision goes through both.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_groups, free_names, lower_bytes, map_arrow, mix64, span_hashes, word_spans
from .components import connected_components

WIDTH = 5  # words in a shingle
BANDS, ROWS = 32, 4  # at similarity 0.75 a pair misses all bands with probability 5e-6
SAMPLES = 256  # MinHash samples in the odd sketch; the first BANDS * ROWS also make the bands
BITS = 1024  # bits of the odd sketch
#: A pair at the threshold differs in 64 +- 7 of 256 samples and XORs to 113 +- 11 bits; five deviations above.
MAX_XOR = 176
BLOCK = 1024  # nodes of a bucket compared in one block
FAMILY_BLOCK = 1024  # members of a family compared in one block, fewer where they are long:
FAMILY_SHINGLES = 400_000  # shingles of one block on average
BROADCAST_ROWS = 100_000  # join keys (24 bytes each) are broadcast up to this many, shuffled beyond

_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_W = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row and the rows' offsets into them; hash families are independent."""
    data = lower_bytes(data)
    s, e, first = word_spans(data, off)
    h = span_hashes(data, s, e, family)
    n = np.diff(first)
    whole = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        whole += h[k : k + len(whole)] * _W[k]
    parts, sizes = [], np.zeros(len(n), np.int64)
    for i, m in enumerate(n.tolist()):
        if m >= width:
            x = np.sort(whole[first[i] : first[i + 1] - width + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif m:
            x = (h[first[i] : first[i + 1]] * _W[: m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m * 0x5851F42D4C957F2D % 2**64)
        else:
            continue
        parts.append(x)
        sizes[i] = len(x)
    flat = mix64(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def _sketches(data: np.ndarray, off: np.ndarray, width: int):
    """Size, digest, band keys and odd sketch of each row; rows without words get size 0."""
    flat, at = shingle_sets(data, off, width)
    n = np.diff(at)
    full = np.flatnonzero(n)
    digest = np.zeros((len(n), 2), np.uint64)
    keys = np.zeros((len(n), BANDS), np.uint64)
    bits = np.zeros((len(n), BITS // 64), np.uint64)
    if len(full):
        starts = at[full]
        digest[full, 0] = np.add.reduceat(mix64(flat, 11), starts)
        other, there = shingle_sets(data, off, width, 1)
        digest[full, 1] = np.add.reduceat(mix64(other, 12), there[full])
        x = (flat >> np.uint64(32)).astype(np.uint32)
        low = np.empty((len(full), SAMPLES), np.uint32)
        y = np.empty_like(x)
        for k in range(SAMPLES):
            np.multiply(x, _A[k], out=y)
            y += _B[k]
            low[:, k] = np.minimum.reduceat(y, starts)
        wide = mix64(low.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
        banded = wide[:, : BANDS * ROWS].reshape(len(full), BANDS, ROWS)
        keys[full] = mix64((banded * _W[:ROWS]).sum(axis=2, dtype=np.uint64), 5)
        spot = (wide >> np.uint64(40)).astype(np.int64) % BITS + np.arange(len(full))[:, None] * BITS
        odd = np.bincount(spot.ravel(), minlength=len(full) * BITS) & 1
        bits[full] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64).reshape(len(full), -1)
    return n, digest, keys, bits


def sketch_rows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rid, doc_id, th, n, digest, keys, sketch) of every row; rid numbers rows, th is a hash of the text."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at, data, off in byte_groups(batch.column("text")):
                n, digest, keys, bits = _sketches(data, off, width)
                m, rows = len(n), batch.slice(at, len(n))
                as_list = lambda x: pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.view(np.int64).ravel())
                )
                raw = digest.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [rows.column("rid"), rows.column("doc_id"), rows.column("th"), pa.array(n.astype(np.int64)),
                     pa.array([raw[16 * i : 16 * i + 16] for i in range(m)], pa.binary()), as_list(keys), as_list(bits)],
                    names=["rid", "doc_id", "th", "n", "digest", "keys", "sketch"],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"),
    )
    return map_arrow(rows, run, "rid long, doc_id long, th long, n long, digest binary, keys array<long>, sketch array<long>")


def _xor_bits(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def estimate(xor_bits: int, samples: int = SAMPLES, bits: int = BITS) -> float:
    """Similarity that an XOR population count of two odd sketches stands for."""
    return max(0.0, 1 + bits / (4 * samples) * math.log(max(1e-9, 1 - 2 * xor_bits / bits)))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    out = pairs
    for side in ("a", "b"):
        out = out.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return out


def _confirm(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked): whether 100 * intersection >= percent * union on the full shingle sets."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            linked = []
            for lo in range(0, len(batch), 64):
                some = batch.slice(lo, 64)
                sides = pa.concat_arrays([some.column(c).cast(pa.large_string()) for c in ("text_a", "text_b")])
                order = np.arange(2 * len(some)).reshape(2, -1).T.ravel()  # a0 b0 a1 b1 ...
                sets = []
                for _, data, off in byte_groups(sides.take(pa.array(order))):
                    flat, at = shingle_sets(data, off, width, 1)
                    sets += [flat[at[i] : at[i + 1]] for i in range(len(off) - 1)]
                for x, y in zip(sets[::2], sets[1::2], strict=True):
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(len(x) > 0 and 100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return map_arrow(pairs.select("a", "b", "text_a", "text_b"), run, "a long, b long, linked boolean")


def _union(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Join the label classes of the node pairs (u, v); returns which pairs joined two classes."""
    joined = np.zeros(len(u), bool)
    while True:
        x, y = labels[u], labels[v]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = np.flatnonzero(low != high)
        if not len(open_):
            return joined
        # each class is drawn once into another, so these pairs form a forest
        _, pick = np.unique(high[open_], return_index=True)
        pick = open_[pick]
        target = np.arange(int(labels.max()) + 1)
        target[high[pick]] = low[pick]
        while True:
            jump = target[target]
            if (jump == target).all():
                break
            target = jump
        labels[:] = target[labels]
        joined[pick] = True


def _groups(batches, keys: tuple[str, ...]):
    """Slices of sorted record batches that hold one group of ``keys`` each."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        ids = np.stack([rest.column(c).to_numpy() for c in keys])
        cut = np.concatenate(([0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield rest.slice(lo, hi - lo)
        rest = rest.slice(int(cut[-1]))
    if rest is not None and len(rest):
        yield rest


def _sides(rows) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the two sides of a block pair; within one block both are all rows."""
    within = rows.column("bi")[0].as_py() == rows.column("bj")[0].as_py()
    side = rows.column("side").to_numpy()
    if within:
        return np.arange(len(rows)), np.arange(len(rows)), True
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False


def _candidate_edges(blocks: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what sketches and sizes allow to be similar across components.

    ``blocks`` has (key, bi, bj, side, node, component, n, sketch), grouped by (key, bi, bj), about two
    blocks of nodes at most in a group.  A group gives fewer edges than nodes: a spanning forest of its
    candidate graph.  Components only filter the pairs: the forest begins at single nodes, so that the two
    ends of every candidate are connected by edges alone.
    """
    import pyarrow as pa

    def run(batches):
        for rows in _groups(batches, ("key", "bi", "bj")):
            left, right, _ = _sides(rows)
            if not len(left) or not len(right):
                continue
            node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
            _, comp = np.unique(rows.column("component").to_numpy(), return_inverse=True)
            sketch = rows.column("sketch").flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
            labels, found = np.arange(len(rows)), []
            for lo in range(0, len(left), 32):
                i = left[lo : lo + 32]
                x = np.bitwise_count(sketch[i][:, None, :] ^ sketch[right][None, :, :]).sum(axis=2, dtype=np.int32)
                small, large = np.minimum(n[i][:, None], n[right]), np.maximum(n[i][:, None], n[right])
                ok = (x <= MAX_XOR) & (comp[i][:, None] != comp[right]) & (100 * small >= percent * large)
                if not ok.any():
                    continue
                u, v = np.nonzero(ok)
                u, v = i[u], right[v]
                keep = _union(labels, u, v)
                found.append((node[u[keep]], node[v[keep]]))
            if found:
                a, b = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return map_arrow(blocks, run, "a long, b long").distinct()


def _member_shingles(family: DataFrame, width: int) -> DataFrame:
    """(family, node, h) for each distinct shingle of each text of (family, node, text)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for lo, data, off in byte_groups(batch.column("text")):
                flat, at = shingle_sets(data, off, width, 1)
                rows = batch.slice(lo, len(at) - 1).select(["family", "node"]).take(pa.array(np.repeat(np.arange(len(at) - 1), np.diff(at))))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(flat.view(np.int64))], names=["family", "node", "h"])

    return map_arrow(family.select("family", "node", "text"), run, "family long, node long, h long")


def _numbered(shared: DataFrame, scratch: Scratch) -> DataFrame:
    """(family, h, id): numbers without gaps from 0 in each family, by range partitions and one count per partition."""
    placed = shared.repartitionByRange("family", "h").sortWithinPartitions("family", "h").withColumn("m", F.monotonically_increasing_id())
    placed = scratch.write(placed, "shared").withColumns({"part": F.shiftright("m", 33), "at": F.col("m").bitwiseAND((1 << 33) - 1)})
    before, starts = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        starts.append((r["part"], before))
        before += r["count"]
    starts = F.broadcast(scratch.spark.createDataFrame(starts, "part long, before long"))
    dense = scratch.write(placed.join(starts, "part").select("family", "h", (F.col("before") + F.col("at")).alias("place")), "places")
    first = scratch.write(dense.groupBy("family").agg(F.min("place").alias("first")), "first-places")
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    return dense.join(first, "family").select("family", "h", (F.col("place") - F.col("first")).cast("int").alias("id"))


def pack_ids(ids: np.ndarray) -> bytes:
    """Distinct numbers as a bitmap from the smallest on, or as plain numbers where that is shorter."""
    if not len(ids):
        return b""
    ids = np.sort(ids)
    base = ids[0] // 8 * 8
    bits = np.zeros(int(ids[-1] - base) // 8 + 1, np.uint8)
    if len(bits) > 4 * len(ids):
        return b"\x00" + ids.astype("<u4").tobytes()
    np.bitwise_or.at(bits, (ids - base) // 8, (1 << (ids - base) % 8).astype(np.uint8))
    return b"\x01" + int(base).to_bytes(4, "little") + bits.tobytes()


def unpack_ids(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    if packed[0] == 0:
        return np.frombuffer(packed, "<u4", offset=1).astype(np.int64)
    base = int.from_bytes(packed[1:5], "little")
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=5), bitorder="little")) + base


def _packed_members(family: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(node, ids): the numbers of those of a member's shingles that another member of its family has too."""
    import pyarrow as pa

    rows = scratch.write(_member_shingles(family, width), "member-shingles")
    shared = rows.groupBy("family", "h").count().filter("count > 1").select("family", "h")
    held = rows.join(scratch.write(_numbered(shared, scratch), "numbered"), ["family", "h"]).groupBy("node").agg(F.collect_list("id").alias("ids"))

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy().astype(np.int64)
            at = at - at[0]
            packed = [pack_ids(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "ids"])

    out = scratch.write(map_arrow(held, run, "node long, ids binary"), "members")
    scratch.drop(rows)
    return out


def _family_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect components within blocks of one family's members.

    ``blocks`` has (family, bi, bj, side, node, component, n, ids).  Every pair across components is decided
    on full shingle sets unless the two are connected by then; a group gives a forest of links.
    """
    import pyarrow as pa

    def run(batches):
        for rows in _groups(batches, ("family", "bi", "bj")):
            left, right, within = _sides(rows)
            if not len(left) or not len(right):
                continue
            node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
            _, labels = np.unique(rows.column("component").to_numpy(), return_inverse=True)
            sets = [unpack_ids(x) for x in rows.column("ids").to_pylist()]
            at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            names, ids = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(names), np.int64)
            found = []
            for i in left.tolist():
                mine = (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i])) & (labels[right] != labels[i])
                others = right[mine]
                if within:
                    others = others[others > i]
                if not len(others):
                    continue
                mark[ids[at[i] : at[i + 1]]] = 1
                if len(others) * 4 < len(node):
                    same = np.array([mark[ids[at[j] : at[j + 1]]].sum() for j in others])
                else:
                    run_sum = np.concatenate(([0], np.cumsum(mark[ids])))
                    same = run_sum[at[others + 1]] - run_sum[at[others]]
                mark[ids[at[i] : at[i + 1]]] = 0
                hits = others[100 * same >= percent * (n[i] + n[others] - same)]
                if len(hits):
                    u = np.full(len(hits), i)
                    joined = _union(labels, u, hits)
                    found.append((node[u[joined]], node[hits[joined]]))
            if found:
                a, b = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return map_arrow(blocks, run, "a long, b long").distinct()


def _in_blocks(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Rows of a group dealt to pairs of blocks: group, bi, bj and side; each row goes to every pair of its block."""
    count = F.ceil(F.col(size) / block).cast("int")
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("node"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    dealt = dealt.select(
        "*", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), (F.col("mine") > F.col("other")).cast("int").alias("side")
    ).drop("mine", "other", size)
    return dealt.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """Components of documents linked by 100 * |A & B| >= percent * |A | B| over word-shingle sets.

    docs: doc_id, text and any other columns (ignored).  Returns doc_id, n_shingles, component_id,
    kept (doc_id = component_id) and th (xxhash64 of the text), one row per input row.

    A-Z is lower-cased, words are runs without ASCII white space; fewer words than ``width`` make one
    shingle of the whole sequence.  Null, empty and blank texts have no shingles, link with nothing and
    are their own component.  A row whose doc_id is null takes part in linking but never names a
    component; a component of such rows alone has a null component_id, and kept is then null.  Repeated
    rows share one component; rows that repeat the component's smallest doc_id are all kept.  An empty
    table gives an empty table.

    The bands miss a pair of similarity 0.75 with probability 5e-6, and the sketch screen rejects one
    with about 1e-6, less the more similar; ``percent`` below 75 needs more bands and a larger MAX_XOR.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    rows = scratch.write(sketch_rows(docs, width), "sketches")
    # a table of its own, so that joins may split the rows of a large group of copies
    node_of = scratch.write(rows.filter("n > 0").groupBy("digest").agg(F.min("rid").alias("node")), "digests")
    nodes = scratch.write(
        rows.join(node_of.select(F.col("node").alias("rid")), "rid", "left_semi")
        .select(F.col("rid").alias("node"), "doc_id", "th", "n", "keys", "sketch"), "nodes"
    )
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key")).select(
        "node", F.xxhash64("band", "key").alias("key")
    )
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    hubs = scratch.write(hubs, "hubs")  # a table of its own, so that the join below may split a large bucket
    few = F.broadcast(hubs) if hubs.count() <= BROADCAST_ROWS else hubs
    buckets = scratch.write(keyed.join(few, "key"), "buckets")  # only those of two nodes or more
    slim = nodes.select("node", "n", "sketch")

    def screened(pairs: DataFrame) -> DataFrame:
        """Pairs that the size bound and the sketches allow."""
        for side in ("a", "b"):
            pairs = pairs.join(slim.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
        return pairs.filter(
            (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (_xor_bits("s_a", "s_b") <= MAX_XOR)
        ).select("a", "b")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(node, text) of the wanted nodes."""
        wanted = nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("d"), F.col("th").alias("t"))
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        source = source.withColumn("th", F.xxhash64("text"))
        found = source.join(wanted, source.doc_id.eqNullSafe(F.col("d")) & (source.th == F.col("t")))
        return scratch.write(found.select("node", "text").dropDuplicates(["node"]), "texts")

    hub_pairs = scratch.write(screened(buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()), "hub-pairs")
    texts = texts_of(hub_pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = scratch.write(_confirm(_with_texts(hub_pairs, texts), width, percent).filter("linked").select("a", "b"), "hub-links")
    component = scratch.write(connected_components(scratch, links), "components")

    placed = buckets.join(component, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    mixed = placed.join(mixed, "key", "left_semi").join(slim, "node")
    edges = scratch.write(_candidate_edges(_in_blocks(mixed, "key", "size", BLOCK), percent), "candidates")
    scratch.drop(buckets, texts, hub_pairs)
    if not edges.isEmpty():
        family = scratch.write(connected_components(scratch, edges).withColumnRenamed("component", "family"), "families")
        size = F.greatest(F.count("*") / FAMILY_BLOCK, F.sum("n") / FAMILY_SHINGLES)
        members = family.join(slim.select("node", "n"), "node").groupBy("family").agg(size.alias("members"))
        texts = texts_of(family.select("node"))
        packed = _packed_members(family.join(texts, "node").select("family", "node", "text"), width, scratch)
        scratch.drop(texts)
        family = (
            family.join(members, "family").join(component, "node", "left").join(slim.select("node", "n"), "node").join(packed, "node")
            .select("family", "members", "node", F.coalesce("component", "node").alias("component"), "n", "ids")
        )
        more = scratch.write(_family_links(_in_blocks(family, "family", "members", 1), percent), "family-links")
        component = scratch.write(connected_components(scratch, links.union(more)), "components")

    placed = (
        rows.select("doc_id", "th", "rid", "n", "digest")
        .join(node_of, "digest", "left")
        .select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("rid")).alias("node"))
        .join(component, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    placed = scratch.write(placed.select("doc_id", "th", "n_shingles", "component"), "placed")
    scratch.drop(rows, nodes, hubs, links)
    # components of several rows; written, so that the join may split a large one
    names = placed.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").select("component", "least", F.lit(True).alias("several"))
    names = scratch.write(names, "names")
    named = placed.join(F.broadcast(names) if names.count() <= BROADCAST_ROWS else names, "component", "left")
    named = named.withColumn("component_id", F.when(F.col("several"), F.col("least")).otherwise(F.col("doc_id")))
    return named.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "th")


def keep_representatives(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """The rows of docs, with all their columns, that ``near_duplicates`` keeps: one of each component.

    Rows that are dropped are looked up by doc_id and a hash of the text, broadcast where they are few,
    else by a shuffle.  Rows whose component has no named row stay.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    found = scratch.write(near_duplicates(docs, percent, width).select("doc_id", "th", "component_id", "kept"), "verdicts")
    gone = found.filter(F.col("component_id").isNotNull() & ~F.coalesce("kept", F.lit(False)))
    own_id, own_th = free_names(docs, "gone_id", "gone_th")
    gone = gone.select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th)).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own_th))
    return docs.join(gone, same, "left_anti")
