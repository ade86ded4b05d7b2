"""Near duplicates against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from depweave.llm import components, exact_dedup
from depweave.llm import minhash_dedup as M
from depweave.llm.common import Scratch

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, percent=75):
    """Component label of each row number, over all pairs."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        same = len(sets[a] & sets[b])
        if sets[a] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            up[root(b)] = root(a)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    out = [None] * len(rows)
    for members in groups.values():
        low = min((rows[k][0] for k in members if rows[k][0] is not None), default=None)
        for k in members:
            out[k] = (rows[k][0], len(sets[k]), low)
    return sorted(map(str, out))


def found(df):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in df.collect())


def test_messy_rows(spark, messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert found(M.near_duplicates(messy)) == brute(rows)
    assert M.near_duplicates(nothing).count() == 0
    left = M.keep_representatives(messy)
    assert left.columns == messy.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, 11, 12, 14, 15, 16, 17, None, None]))


def test_a_large_group_of_near_copies_and_a_shared_passage(spark):
    rnd = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(400):  # each copy has a few words changed; two copies may be too far apart
        words = list(base)
        for _ in range(rnd.randint(1, 5)):
            words[rnd.randrange(len(words))] = f"r{rnd.random()}"
        rows.append((k, " ".join(words)))
    for k in range(300):  # a third of each text is shared: no link
        rows.append((1000 + k, " ".join(base[:50] + [f"u{k}_{i}" for i in range(100)])))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    old = M.BLOCK, M.FAMILY_BLOCK
    try:
        M.BLOCK, M.FAMILY_BLOCK = 64, 32  # many blocks to a group
        assert found(M.near_duplicates(df)) == brute(rows)
    finally:
        M.BLOCK, M.FAMILY_BLOCK = old


def test_candidates_of_components_that_are_joined_already_stay_in_one_family(spark):
    bits = lambda n: [int(x) for x in np.packbits(np.arange(M.BITS) < n, bitorder="little").view(np.int64)]
    # y0, x0, u and v of the components Y, X, X and Y; candidates are (y0, u), (u, v) and (v, x0)
    rows = [(1, 0, 0, 0, node, comp, 100, bits(n)) for node, comp, n in ((10, 10, 0), (11, 11, 450), (12, 11, 150), (13, 10, 300))]
    schema = "key long, bi int, bj int, side int, node long, component long, n long, sketch array<long>"
    edges = M._candidate_edges(spark.createDataFrame(rows, schema).coalesce(1), 75)
    family = {r["node"]: r["component"] for r in components.connected_components(Scratch(spark, "t"), edges).collect()}
    assert family == {10: 10, 11: 10, 12: 10, 13: 10}


def test_chain_of_links(spark):
    words = [f"c{i}" for i in range(400)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 100])) for k in range(30)]  # neighbours overlap, ends do not
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(M.near_duplicates(df)) == brute(rows)
    assert {r["component_id"] for r in M.near_duplicates(df).collect()} == {0}


def test_odd_sketch_estimates_similarity():
    rnd = random.Random(5)
    for target in (0.75, 0.85, 0.95):
        n = 2000
        shared = int(2 * n * target / (1 + target))
        a = [f"s{i}" for i in range(shared)] + [f"a{rnd.random()}" for _ in range(n - shared)]
        b = [f"s{i}" for i in range(shared)] + [f"b{rnd.random()}" for _ in range(n - shared)]
        raw = [" ".join(x).encode() for x in (a, b)]
        data = np.frombuffer(b"".join(raw), np.uint8)
        _, _, keys, bits = M._sketches(data, np.array([0, len(raw[0]), len(data)]), 1)
        xor = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert abs(M.estimate(xor) - target) < 0.08
        assert xor <= M.MAX_XOR
        assert (keys[0] == keys[1]).any()


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (None, 3)], [(k, k + 1) for k in range(20)], [(0, k) for k in range(1, 50)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    up = {}
    for a, b in edges:
        if a is not None and a != b:
            up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(len(edges)):
        for a, b in edges:
            if a in up and b in up:
                up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["component"] for r in components.connected_components(Scratch(spark, "t"), df.filter("a is not null")).collect()}
    assert got == up


def opposite(n):
    """Two different words of 2**n letters on which every polynomial modulo a power of two agrees."""
    x = "a"
    for _ in range(n):
        x += x.translate({97: 98, 98: 97})
    return x, x.translate({97: 98, 98: 97})


def test_words_that_polynomials_confuse(spark):
    rows = []
    for k, n in enumerate((10, 11, 13)):
        x, y = opposite(n)
        rows += [(10 * k + 1, x), (10 * k + 2, y), (10 * k + 3, " ".join([x, "b", "c", "d", "e", "f"])), (10 * k + 4, " ".join([y, "b", "c", "d", "e", "g"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(M.near_duplicates(docs)) == brute(rows)
    assert M.near_duplicates(docs).select("component_id").distinct().count() == len(rows)


def test_packed_ids():
    rnd = np.random.default_rng(1)
    for ids in ([], [0], [7], [2**31], [5, 1, 2**31 - 1], rnd.permutation(5000)[:900], rnd.permutation(10**6)[:50] + 12345):
        packed = M.pack_ids(np.array(ids, np.int64))
        assert M.unpack_ids(packed).tolist() == sorted(int(i) for i in ids)
        assert len(packed) <= 5 + 4 * len(ids)


def test_a_family_moves_no_texts(spark, monkeypatch):
    """Members of a large family that the hub round leaves apart are compared as bitmaps, far shorter than their texts."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(120):  # each differs from the base and from most others too much, and has one neighbour
        w = [x if rnd.random() > 0.06 else f"e{rnd.randrange(10**6)}" for x in base]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w, "tail", str(k)]))]
    seen, links = [], M._family_links

    def watched(blocks, percent):
        seen.append(blocks.agg({"ids": "count"}).first()[0])
        seen.append(sum(len(r["ids"]) for r in blocks.select("node", "ids").dropDuplicates(["node"]).collect()))
        return links(blocks, percent)

    monkeypatch.setattr(M, "_family_links", watched)
    monkeypatch.setattr(M, "FAMILY_BLOCK", 50)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert found(got) == brute(rows)
    assert seen and seen[0] > 0 and seen[1] < 0.2 * sum(len(t) for _, t in rows)


def test_columns_of_any_name_pass(spark):
    names = ["unnamed", "own_id", "own_sha", "gone_id", "gone_th", "GONE_ID", "th", "node", "kept", "digest", "component", "__id", "__sha", "__gone_id"]
    rows = [(1, "one two three", *names), (2, "one two three", *names), (3, "other words", *names), (None, "other words", *names)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n if n != 'GONE_ID' else 'gone_id_'}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for keep in (exact_dedup.keep_first, M.keep_representatives):
        left = keep(docs)
        assert left.columns == docs.columns and sorted(r[0] for r in left.collect()) == [1, 3]
