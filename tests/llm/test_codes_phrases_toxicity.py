"""Vector codes, phrases and toxicity: brute force, held-out accuracy, odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.llm import collocations, toxicity, vector_codes
from depweave.llm.common import crc32_mod

# --- vector codes -----------------------------------------------------------------------------------


def lloyd(rows, entries, rounds):
    """From the contract: integers, parts, seeds, rounds, codes; rows of (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // 4
    seeds = {}
    for i, v, _ in kept:
        if i is not None:
            seeds[i] = min(seeds.get(i, v), v)
    first = [seeds[i] for i in sorted(seeds)[:entries]]
    books = [[v[p * w : p * w + w] for v in first] for p in range(4)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            members = collections.defaultdict(list)
            for _i, v, _l in kept:
                members[near(p, v[p * w : p * w + w])[1]].append(v[p * w : p * w + w])
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        best = [near(p, v[p * w : p * w + w]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
    sums = collections.Counter()
    for _, _, e, lab in out:
        sums[lab] += e
    return sorted(((i, c, e, sums[lab], sha) for i, c, e, lab in out), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, entry int, position int, rid long, salt int, moved string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, 3, 4, "x") for i, v, lab in rows], VECTORS).repartition(3)


def test_vector_codes_against_brute_force(spark):
    rng = random.Random(5)
    vec = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec(), rng.choice([0, 1, None])) for i in range(120)]
    rows += [(7, vec(), 2), (7, vec(), 2), (None, vec(), 2), (200, None, 0), (201, [float("nan"), *vec()[1:]], 0), (202, [float("inf"), *vec()[1:]], 1), (203, [None, *vec()[1:]], 1)]
    for entries in (16, 256):
        got = vector_codes.compress(vectors(spark, rows), entries=entries).collect()
        assert sorted((tuple(r) for r in got), key=str) == lloyd(rows, entries, 4)


def test_vector_codes_only_movers_migrate(spark, monkeypatch):
    """After a round, the files of migrated parts hold those that changed their entry, all others stayed where they were."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(400)]
    seen = []
    settle = vector_codes.Residents.settle

    def watched(self, parts, books):
        before = {(r["rid"], r["position"]): r["entry"] for r in parts.collect()}
        settle(self, parts, books)
        after = {(r["rid"], r["position"]): (r["entry"], r["f"]) for r in self.rows.withColumn("f", F.input_file_name()).collect()}
        assert before.keys() == after.keys()
        moved = {k for k, (e, _) in after.items() if e != before[k]}
        assert {k for k, (_, f) in after.items() if "-migrated/" in f} == moved
        seen.append(len(moved))

    monkeypatch.setattr(vector_codes.Residents, "settle", watched)
    vector_codes.compress(vectors(spark, rows), entries=16).count()
    assert len(seen) == 4 and seen[0] == 1600 and all(n < 1600 for n in seen[1:])


def test_vector_codes_of_large_components_and_odd_rows(spark):
    big = vector_codes.BOUND / vector_codes.SCALE
    rows = [(1, [big, -big, 1e30, -1e30], 0), (2, [0.5, 0.25, 1.0, 2.0], 0), (3, [1.0] * 8, 0), (4, [], 0), (5, [1.0, 2.0, 3.0], 0)]
    got = vector_codes.compress(vectors(spark, rows)).collect()
    assert [r["vec_id"] for r in got] == [3]  # the longest vectors count; lengths must be multiples of the positions
    got = {r["vec_id"]: r for r in vector_codes.compress(vectors(spark, rows[:2])).collect()}
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == {1: ("00000000", 0), 2: ("01010101", 0)}
    assert vector_codes.compress(vectors(spark, rows[:0])).count() == 0
    assert vector_codes.compress(vectors(spark, [(None, [1.0] * 4, 0)])).count() == 0


# --- phrases ----------------------------------------------------------------------------------------


def phrases(rows, top, least):
    """From the contract, with plain integers; rows of (text, lang)."""
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if " " not in g)
        candidates = {g: c for g, c in f.items() if c >= least and " " in g}
        around = collections.Counter()
        for g, c in candidates.items():
            w = g.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    sub = " ".join(w[i : i + k])
                    around[sub] = max(around[sub], c)
        best = []
        for g, a in candidates.items():
            if 100 * around[g] >= 80 * a:
                continue
            w = g.split(" ")
            cuts = []
            for k in range(1, len(w)):
                left, right = f[" ".join(w[:k])], f[" ".join(w[k:])]
                cuts.append((2000000 * a // (left + right), k, left, right))
            s, _, left, right = min(cuts)
            best.append((-s, -a, g.encode(), left, right))
        out += [(lang, i + 1, g.decode(), -a, left, right, n, -s) for i, (s, a, g, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


ORDER = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("top", "frontier", "least"), [(2000, collocations.FRONTIER, 8), (30, 25, 6)])
def test_phrases_against_brute_force(spark, documents, messy, top, frontier, least):
    """Also where the frontier takes many steps, with tied scores, copies, and odd texts."""
    own = [(r["text"], r["lang"]) for r in documents.filter("doc_id % 2 = 0").collect()]
    odd = [(r["text"], r["lang"]) for r in messy.collect()]
    tied = [("alpha beta gamma delta epsilon. Alpha beta;zeta\teta  theta iota", None)] * 40 + [("alpha  BETA gamma", "xx"), ("solo", "yy"), ("é è é è é è é è é è é è é è é è é è é è", "zz")]
    rows = own + odd + tied
    docs = spark.createDataFrame([(t, la, 1, "g", 2) for t, la in rows], "text string, lang string, n int, gram string, rank int").repartition(5)
    got = sorted(tuple(r[c] for c in ORDER) for r in collocations.mine_phrases(docs, top, frontier, least).collect())
    want = phrases(rows, top, least)
    assert len({x[0] for x in want}) >= 5 and got == want


def test_phrases_of_no_texts(spark, nothing):
    assert collocations.mine_phrases(nothing).count() == 0
    assert collocations.mine_phrases(spark.createDataFrame([(None, None), ("", "en"), ("one two", "en")], "text string, lang string")).count() == 0


def test_scores_pass_64_bits(spark):
    big = (1 << 62) - 1
    rows = spark.createDataFrame([(big, big, big // 3)], "a long, l long, r long")
    assert rows.select(collocations.score("a", "l", "r")).first()[0] == 2000000 * big // (big + big // 3)


# --- toxicity ---------------------------------------------------------------------------------------


def T():
    return crc32_mod(F.col("doc_id"), 4) == 2


SYLLABLES = ["ta", "ro", "mi", "len", "sor", "ka", "du", "vi", "pe", "an", "gor", "ish"]
STEMS = ["zaggro", "blurk"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 150))]
        bad = rng.random() < 0.15
        if bad:  # inflected forms, so that no whole word tells
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(STEMS) + word())
        rows.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    family = " ".join(word() for _ in range(60))  # clean copies
    rows += [(n + k, f"{family} {word()}") for k in range(120)]
    labels += [(n + k, 0) for k in range(60)]
    truth = {i: int(any(s in t for s in STEMS)) for i, t in rows}
    return rows, labels, truth


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 0.5) for i, t in rows], "doc_id long, text string, label int, terms int, q string, score double").repartition(4)
    return docs, spark.createDataFrame([(i, x, None) for i, x in labels], "doc_id long, toxic int, text string")


def test_toxicity_held_out(spark):
    rows, labels, truth = corpus()
    got = {r["doc_id"]: r for r in toxicity.classify_toxicity(*frames(spark, rows, labels), T()).collect()}
    assert all(0 <= r["score"] <= 1 and r["held_out"] == ((zlib.crc32(str(i).encode()) % 4) == 2) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    hit = [got[i]["predicted"] for i in held if truth[i]]
    false = [got[i]["predicted"] for i in held if not truth[i]]
    assert len(hit) > 20 and np.mean(hit) >= 0.95 and np.mean(false) <= 0.01
    unlabelled = [i for i in got if i not in dict(labels)]
    assert np.mean([got[i]["predicted"] == truth[i] for i in unlabelled]) >= 0.98


def test_toxicity_never_reads_held_out_labels(spark):
    rows, labels, _ = corpus(300)
    score = lambda x: {r["doc_id"]: round(r["score"], 9) for r in toxicity.classify_toxicity(*frames(spark, rows, x), T()).collect()}
    assert score(labels) == score([(i, 1 - x if (zlib.crc32(str(i).encode()) % 4) == 2 else x) for i, x in labels])


def test_label_model_recovers_accuracies_and_correlations(spark):
    """Votes drawn from a known tree: a copied voter is told from independent ones, so that it does not count twice."""
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.2
    draw = lambda p1, p0: np.where(y, rng.random(len(y)) < p1, rng.random(len(y)) < p0)
    votes = [draw(0.7, 0.05), draw(0.6, 0.1), draw(0.5, 0.02)]
    votes.append(np.where(rng.random(len(y)) < 0.95, votes[0], draw(0.5, 0.5)))  # nearly a copy of voter 0
    mask = sum(v.astype(int) << k for k, v in enumerate(votes))
    label = np.where(rng.random(len(y)) < 0.05, y.astype(int), -1)
    rows = collections.Counter(zip(mask.tolist(), label.tolist(), strict=True))
    table = spark.createDataFrame([(*k, n) for k, n in rows.items()], "votes long, label int, n long")
    model = toxicity.fit_label_model(table, 4, rounds=30)
    assert abs(model.prior - 0.2) < 0.02
    assert model.parent[3] == 0 and model.table[1, 3, 1] > 0.9 and model.table[0, 3, 1] > 0.9
    both, one = model.posterior(np.array([0b1001, 0b0001]), np.array([-1, -1]))
    apart = model.posterior(np.array([0b0011]), np.array([-1]))[0]
    exact = lambda a, b: 0.2 * a / (0.2 * a + 0.8 * b)
    assert apart == pytest.approx(exact(0.7 * 0.6 * 0.5 * 0.025, 0.05 * 0.1 * 0.98 * 0.025), abs=0.1)
    assert both - one < 0.2  # the copy adds little


def test_classifier_minimises_its_loss(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, 6)) < 0.4
    q = 1 / (1 + np.exp(-(x @ rng.normal(size=6) - 0.5)))
    rows = spark.createDataFrame([(float(a), [int(k) for k in np.flatnonzero(b)], 1) for a, b in zip(q, x, strict=True)], "q double, terms array<int>, n long")
    w = toxicity.fit_classifier(rows, 6, steps=60)
    p = 1 / (1 + np.exp(-(x @ w[:6] + w[6])))
    slope = np.append(x.T @ (p - q) + toxicity.RIDGE * w[:6], (p - q).sum())
    assert np.abs(slope).max() < 0.3  # a zero gradient at the minimum; the sums are over 300 rows


def test_toxicity_of_odd_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(6, 1), (7, 0), (4, None), (5, 7), (6, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.classify_toxicity(messy, labels, T()).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["score"])
    assert len(by[13]) == 1 and by[1] == by[2]
    none = toxicity.classify_toxicity(messy, labels.filter("false"), T()).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert toxicity.classify_toxicity(nothing, labels, T()).count() == 0
