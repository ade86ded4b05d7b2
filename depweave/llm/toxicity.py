"""Toxicity scores by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. *Terms.*  Whole words, and beginnings and ends of words, are counted in labelled documents of both classes; those
   that toxic documents hold much more often become terms.  Four patterns of style (shouting, repeated marks, stretched
   letters, masked words) join them.  Copies count once, by a sketch of their word triples, so that the words
   of a large group of copies are no terms.
2. *Voters.*  Terms are chosen as voters by greedy cover, until the toxic examples hold several each.
3. *Label model.*  A document's votes depend on its unknown class and, along a tree, on one other vote each: the tree joins
   the most correlated voters (Chow and Liu 1968, given the class).  Expectation maximisation over all documents, labelled
   or not, estimates the voters' accuracies and correlations; a label, where known, is one more vote.
4. *Classifier.*  A logistic regression over all terms is trained on the posterior labels of all these documents.

One pass over the texts finds each document's terms; everything else reads that slim table.  In each round of either
model tasks reduce their rows to a table of fixed size, and Spark sums these.  What is fitted on a bounded
sample are the terms and the choice of voters: POSITIVES and NEGATIVES labelled rows, by a digest of doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, SpanHasher, byte_groups, lower_bytes, map_arrow, mix64, word_spans

POSITIVES, NEGATIVES = 4_000, 8_000  # labelled rows that terms are taken from
TERMS = 4_096
AFFIXES = (3, 4, 5, 6)  # characters of the beginnings and ends of words
VOTERS, COVER = 60, 4  # voters at most; votes that each toxic example should have
LEAST, LIFT = 2.0, 5.0  # toxic examples that hold a term, and how many times more often than clean ones
TRUST = 0.98  # accuracy of a label as a vote
ROUNDS, STEPS = 4, 20  # of the label model and of the classifier
RIDGE = 1.0
STYLES = 4

_LETTER, _UPPER = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER[65:91] = True
_MARK, _MASK = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[*b"!?"]] = True
_MASK[[*b"*@$#"]] = True


def _affix_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray):
    """(kind, which word, start, end) of whole words and of their beginnings and ends, cut between characters."""
    yield 1, np.arange(len(s)), s, e
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(begins, s), np.searchsorted(begins, e)
    begins = np.append(begins, len(data))
    for k in AFFIXES:
        longer = np.flatnonzero(last - first > k)
        yield 2, longer, s[longer], begins[first[longer] + k]
        yield 3, longer, begins[last[longer] - k], e[longer]


def term_hashes(data: np.ndarray, off: np.ndarray):
    """(row, hash) arrays of all terms of the texts, with repetitions, kind after kind."""
    data = lower_bytes(data)
    s, e, first = word_spans(data, off, ~_LETTER)
    row, hasher = np.repeat(np.arange(len(off) - 1), np.diff(first)), SpanHasher(data)
    for kind, which, lo, hi in _affix_spans(data, s, e):
        yield row[which], mix64(hasher(lo, hi), kind)


def style_patterns(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has three words in capitals, a repeated mark, a letter thrice in a row, a masked word."""
    m = len(off) - 1
    out = np.zeros((m, STYLES), bool)
    row = np.repeat(np.arange(m), np.diff(off))
    s, e, first = word_spans(data, off, ~_LETTER)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    loud = (upper[e] - upper[s] == e - s) & (e - s >= 3)
    out[:, 0] = np.bincount(np.repeat(np.arange(m), np.diff(first))[loud], minlength=m) >= 3
    if len(data) > 2:
        same = (data[1:] == data[:-1]) & (row[1:] == row[:-1])
        out[row[1:][same & _MARK[data[1:]]], 1] = True
        thrice = same[1:] & same[:-1] & _LETTER[data[2:]] & (data[2:] < 128)
        out[row[2:][thrice], 2] = True
        inside = _MASK[data[1:-1]] & _LETTER[data[:-2]] & _LETTER[data[2:]] & (row[:-2] == row[2:])
        out[row[1:-1][inside], 3] = True
    return out


def _family(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The smallest hash of each text's word triples (of its words, where there are fewer): copies mostly share it."""
    data = lower_bytes(data)
    s, e, first = word_spans(data, off)
    h = SpanHasher(data)(s, e)
    whole = mix64(h[:-2] + mix64(h[1:-1], 1) + mix64(h[2:], 2)) if len(h) > 2 else np.zeros(0, np.uint64)
    out = np.zeros(len(off) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        out[i] = whole[a : b - 2].min() if b - a > 2 else h[a:b].min() if b > a else 0
    return out


def _example_rows(docs: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, text, weight) of the sampled labelled documents; copies share one weight of about 1."""
    import pyarrow as pa

    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    some = None
    for label, limit in ((1, POSITIVES), (0, NEGATIVES)):
        rows = known.filter(F.col("label") == label).orderBy(digest, "doc_id").limit(limit)
        some = rows if some is None else some.union(rows)
    some = F.broadcast(some.select(F.col("doc_id").alias("id"), "label"))  # POSITIVES + NEGATIVES rows at most
    rows = docs.join(some, F.col("doc_id") == F.col("id")).select("label", "text")

    def run(batches):
        for batch in batches:
            for at, data, off in byte_groups(batch.column("text")):
                key = _family(data, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(at, len(key)), batch.column("text").slice(at, len(key)), pa.array(key.view(np.int64))], names=["label", "text", "key"]
                )

    rows = scratch.write(map_arrow(rows, run, "label int, text string, key long"), "examples")
    copies = scratch.write(rows.groupBy("label", "key").agg((1 / F.count("*")).alias("weight")), "copies")
    return rows.join(copies, ["label", "key"]).select("label", "text", "weight")


def _terms(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms, sorted, and their weights of evidence: toxic share over clean share, in logarithms."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            label, weight = batch.column("label").to_numpy(), batch.column("weight").to_numpy()
            for at, data, off in byte_groups(batch.column("text")):
                m = len(off) - 1
                mine, w = label[at : at + m], weight[at : at + m]
                for row, h in term_hashes(data, off):
                    order = np.lexsort((h, row))
                    r, x = row[order], h[order]
                    new = np.ones(len(r), bool)
                    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
                    names, ids = np.unique(x[new], return_inverse=True)
                    n = [np.bincount(ids, weights=np.where(mine == c, w, 0)[r[new]], minlength=len(names)).astype(float) for c in (1, 0)]
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["h", "n1", "n0"])

    totals = {r["label"]: r["w"] for r in examples.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    t1, t0 = totals.get(1, 0.0), totals.get(0, 0.0)
    found = map_arrow(examples, run, "h long, n1 double, n0 double").groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    lift = F.log((F.col("n1") + 0.5) / (t1 + 1.0)) - F.log((F.col("n0") + 0.5) / (t0 + 1.0))
    found = found.filter(F.col("n1") > LEAST - 0.5).withColumn("lift", lift).filter(F.col("lift") >= float(np.log(LIFT)))
    best = found.orderBy(F.desc(F.round(F.col("n1") * F.col("lift"), 6)), "h").limit(TERMS).toArrow()
    h, lift = best.column("h").to_numpy().view(np.uint64), best.column("lift").to_numpy()
    order = np.argsort(h)
    return h[order], lift[order]


def _found_terms(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, held_out, terms): the sorted numbers of each document's distinct terms, styles after all others."""
    import pyarrow as pa

    shift = np.uint64(44)

    def run(batches):
        maybe = np.zeros(1 << 20, bool)
        maybe[terms >> shift] = True
        for batch in batches:
            for at, data, off in byte_groups(batch.column("text")):
                m, keys = len(off) - 1, []
                for row, h in term_hashes(data, off):
                    some = np.flatnonzero(maybe[h >> shift])
                    place = np.minimum(np.searchsorted(terms, h[some]), max(len(terms) - 1, 0))
                    hit = terms[place] == h[some] if len(terms) else np.zeros(0, bool)
                    keys.append(np.unique(row[some][hit] * (TERMS + STYLES) + place[hit]))
                r, c = np.nonzero(style_patterns(data, off))
                keys.append(r * (TERMS + STYLES) + TERMS + c)
                row, term = np.divmod(np.unique(np.concatenate(keys)), TERMS + STYLES)
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=m)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32)))
                some = batch.slice(at, m)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held_out"), lists], names=["doc_id", "held_out", "terms"])

    return map_arrow(docs.select("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, terms array<int>")


def _voters(positives: list, lift: np.ndarray) -> list[int]:
    """Terms that cover the toxic examples COVER times each, the best first; the styles vote in any case."""
    holds = np.zeros((len(positives), TERMS), bool)
    for i, terms in enumerate(positives):
        holds[i, [t for t in terms if t < TERMS]] = True
    holds = holds[:, : len(lift)]
    need, left, out = np.full(len(holds), COVER), np.ones(len(lift), bool), []
    while len(out) < VOTERS and left.any():
        gain = np.where(left, (holds & (need > 0)[:, None]).sum(axis=0) * lift, 0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        out.append(best)
        left[best] = False
        need[holds[:, best]] -= 1
    return out + [TERMS + k for k in range(STYLES)]


@dataclass(frozen=True)
class LabelModel:
    """P(class) and, for each voter, P(vote | class, the parent's vote); roots are their own parents."""

    prior: float
    parent: np.ndarray
    table: np.ndarray  # class, voter, parent's vote: the probability of a vote

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic | votes, label); label is 0, 1 or -1 where unknown."""
        bits = (votes[:, None] >> np.arange(len(self.parent)) & 1).astype(np.int64)
        seen = bits[:, self.parent]
        log = []
        for c, p in ((0, 1 - self.prior), (1, self.prior)):
            fire = np.where(seen == 1, self.table[c, :, 1], self.table[c, :, 0])
            log.append(np.log(p) + np.log(np.where(bits == 1, fire, 1 - fire)).sum(axis=1))
        odds = log[1] - log[0] + np.where(label < 0, 0, np.where(label == 1, 1, -1) * np.log(TRUST / (1 - TRUST)))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _from_counts(counts: np.ndarray) -> LabelModel:
    """The model of expected counts: counts[c, j, k] of both votes j and k in class c, and of the class in the last cell."""
    k = counts.shape[1] - 1
    n = counts[:, k, k]
    single = np.stack([np.diag(counts[c])[:k] for c in (0, 1)])
    rate = (single + 0.5) / (n[:, None] + 1)
    info = np.zeros((k, k))
    for c in (0, 1):
        both, a, b = counts[c][:k, :k], single[c][:, None], single[c][None, :]
        total = max(n[c], 1e-9)
        for cell, left, right in ((both, a, b), (a - both, a, total - b), (b - both, total - a, b), (total - a - b + both, total - a, total - b)):
            cell = np.maximum(cell, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                info += np.where((cell > 0) & (left * right > 0), cell * np.log(cell * total / (left * right)), 0)
    np.fill_diagonal(info, -1)
    parent, best, joined = np.zeros(k, np.int64), np.full(k, -np.inf), np.zeros(k, bool)
    for _ in range(k):  # the tree of the largest conditional information, grown from voter 0
        j = int(np.where(joined, -np.inf, np.where(np.isinf(best), -1e300, best)).argmax()) if joined.any() else 0
        joined[j] = True
        closer = ~joined & (info[j] > best)
        best[closer], parent[closer] = info[j][closer], j
    table = np.empty((2, k, 2))
    for c in (0, 1):
        both, mine, theirs = counts[c][np.arange(k), parent], single[c], single[c][parent]
        table[c, :, 1] = (both + 2 * rate[c]) / (theirs + 2)
        table[c, :, 0] = (np.maximum(mine - both, 0) + 2 * rate[c]) / (np.maximum(n[c] - theirs, 0) + 2)
        table[c, 0, :] = rate[c, 0]
    return LabelModel(float((n[1] + 1) / (n.sum() + 2)), parent, np.clip(table, 1e-6, 1 - 1e-6))


def _expected(patterns: DataFrame, size: int, model: LabelModel | None) -> np.ndarray:
    """Sums of one round over (votes, label, n): expected counts of pairs of votes by class; from the labels alone without a model."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros((2, size + 1, size + 1))
        for batch in batches:
            votes, label, n = (batch.column(c).to_numpy() for c in ("votes", "label", "n"))
            for lo in range(0, len(votes), 1 << 14):
                v, y, w = votes[lo : lo + (1 << 14)], label[lo : lo + (1 << 14)], n[lo : lo + (1 << 14)]
                q = model.posterior(v, y) if model else (y == 1).astype(float)
                bits = np.ones((len(v), size + 1))
                bits[:, :size] = v[:, None] >> np.arange(size) & 1
                for c, share in ((0, 1 - q), (1, q)):
                    total[c] += bits.T @ (bits * (share * w)[:, None])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "value"])

    found = map_arrow(patterns, run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()  # 2 * 65 * 65 cells at most
    out = np.zeros(2 * (size + 1) ** 2)
    out[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return out.reshape(2, size + 1, size + 1)


def fit_label_model(patterns: DataFrame, size: int, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over (votes, label, n), begun with the labelled rows' counts."""
    model = _from_counts(_expected(patterns.filter("label >= 0"), size, None))
    for _ in range(rounds):
        model = _from_counts(_expected(patterns, size, model))
    return model


def _row_terms(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of an Arrow list column."""
    offsets = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(offsets)), column.flatten().to_numpy()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _gradient(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient of the logistic regression over (q, terms, n), summed by Spark; one cell for each weight."""
    import pyarrow as pa

    size = len(weights)

    def run(batches):
        total = np.zeros(size + 1)
        for batch in batches:
            q, n = batch.column("q").to_numpy(), batch.column("n").to_numpy()
            row, term = _row_terms(batch.column("terms"))
            z = weights[-1] + np.bincount(row, weights=weights[term], minlength=len(q))
            slope = n * (_sigmoid(z) - q)
            total[: size - 1] += np.bincount(term, weights=slope[row], minlength=size - 1)
            total[size - 1] += slope.sum()
            total[size] += (n * (np.logaddexp(0, z) - q * z)).sum()
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "value"])

    found = map_arrow(rows, run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size + 1)
    out[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    own = np.append(weights[:-1], 0) * RIDGE
    return float(out[size] + 0.5 * (own @ weights)), out[:size] + own


def fit_classifier(rows: DataFrame, size: int, steps: int = STEPS) -> np.ndarray:
    """Weights of ``size`` terms and a constant that minimise the ridge-penalised loss, by limited-memory BFGS."""
    w = np.zeros(size + 1)
    loss, g = _gradient(rows, w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = g.copy(), []
        for s, y in reversed(past):
            alphas.append((s @ d) / (s @ y))
            d -= alphas[-1] * y
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.abs(g).max(), 1e-9)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        step = 1.0
        for _ in range(8):
            new = w - step * d
            lower, h = _gradient(rows, new)
            if lower <= loss - 1e-4 * step * (g @ d):
                break
            step /= 3
        else:
            break
        if (new - w) @ (h - g) > 1e-12:
            past = [*past, (new - w, h - g)][-8:]
        gained, w, loss, g = loss - lower, new, lower, h
        if gained < 1e-5 * max(loss, 1.0):
            break
    return w


def classify_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """Score every document: doc_id, held_out, score (0 to 1, higher is more toxic), predicted (0 or 1).

    docs: doc_id, text; labels: doc_id, toxic (rows without a 0 or 1 are ignored; more columns are ignored).
    ``held_out`` is an expression over doc_id; such rows, and rows with a null doc_id, are never learnt from.  Texts
    alone make the score; null text counts as empty, and a text without terms gets the share that such texts have.
    Repeated documents are scored each; a document labelled more than once is toxic if one of its labels is.
    Without any label all scores are 0.  An empty table gives an empty table.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    known = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.filter(~F.coalesce(held_out, F.lit(True))).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = scratch.write(known, "labels")
    if known.isEmpty():
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    examples = scratch.write(_example_rows(rows, known, scratch), "weighted")
    terms, lift = _terms(examples)
    scratch.drop(examples)
    found = scratch.write(_found_terms(rows, terms), "terms")
    learnt = found.filter(~F.col("held_out")).join(known, "doc_id", "left").select("doc_id", F.coalesce("label", F.lit(-1)).alias("label"), "terms")
    learnt = scratch.write(learnt.groupBy("label", "terms").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")), "learnt")
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    positives = learnt.filter("label = 1").orderBy(order, "doc_id").limit(POSITIVES).select("terms").collect()  # POSITIVES rows at most
    voters = _voters([r["terms"] for r in positives], lift)
    bits = np.full(TERMS + STYLES, -1)
    bits[voters] = np.arange(len(voters))

    def vote(batches):
        for batch in batches:
            row, term = _row_terms(batch.column("terms"))
            mine = bits[term] >= 0
            votes = np.zeros(len(batch), np.int64)
            np.bitwise_or.at(votes, row[mine], np.int64(1) << bits[term[mine]])
            yield pa.RecordBatch.from_arrays([pa.array(votes), *(batch.column(c) for c in ("label", "terms", "n"))], names=["votes", "label", "terms", "n"])

    voted = scratch.write(map_arrow(learnt.select("label", "terms", "n"), vote, "votes long, label int, terms array<int>, n long"), "votes")
    patterns = scratch.write(voted.groupBy("votes", "label").agg(F.sum("n").alias("n")), "patterns")
    model = fit_label_model(patterns, len(voters))

    def judge(batches):
        for batch in batches:
            q = model.posterior(batch.column("votes").to_numpy(), batch.column("label").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(q), batch.column("terms"), batch.column("n")], names=["q", "terms", "n"])

    soft = scratch.write(map_arrow(voted, judge, "q double, terms array<int>, n long"), "posterior")
    weights = fit_classifier(soft, TERMS + STYLES)

    def apply(batches):
        for batch in batches:
            row, term = _row_terms(batch.column("terms"))
            z = weights[-1] + np.bincount(row, weights=weights[term], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(_sigmoid(z))], names=["doc_id", "held_out", "score"])

    scored = map_arrow(found, apply, "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
