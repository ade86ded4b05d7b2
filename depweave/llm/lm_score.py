"""Language-model scores by masked pseudo-likelihood.

A small network predicts every word of a document from the words on both sides of it, the word itself
masked; a document's score is the sum of these conditional log-probabilities (Salazar et al. 2020).

The distribution is over words.  The network's tokens are the most frequent words of the whole corpus and,
for all others, classes of words by a hash of their two last bytes, which tell much about a word's language and
part of speech; their number grows with the corpus' distinct words.  Within a class a word has the share of its
own corpus count.  Spark counts every word of every document; the counts of the LISTED most frequent words go with
the tasks, all others are joined.

Texts are turned into tokens once, as a table.  The network is trained in NumPy on all partitions at once: in
each round every task starts from the same weights, runs stochastic gradient descent over its documents of
that round, and Spark adds the weights up, weighted by windows, to the next round's start.  The rounds'
shares are disjoint and together hold every window of every document.  The more tasks share the work, the more
rounds there are; a task has TASK_TOKENS tokens or so.  The driver holds one set of weights.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_groups, lower_bytes, map_arrow, mix64, span_hashes, word_spans
from .unit_memo import Slots

SIDES = (8, 96)  # least and greatest number of classes; a token is a class and one of as many members
LISTED = 1 << 18  # words whose own counts go to the tasks: 12 bytes each and a table of 8 MB; the others' are joined
SIDE = 3  # words of context on each side
HIDDEN = 20
TASK_TOKENS = 2_000_000  # of the corpus, for each task of a round
RATE, BATCH = 0.1, 2048

_SHIFTS = [k for k in range(-SIDE, SIDE + 1) if k]


def classes_for(distinct: int) -> int:
    """Classes, and members of each, for a corpus of so many distinct words: the fourth root, in steps of 8."""
    return min(max(8 * math.ceil(max(distinct, 1) ** 0.25 / 8), SIDES[0]), SIDES[1])


def rounds_for(tokens: int) -> int:
    """Rounds of averaging; each document is trained on in one of them, chosen by a checksum of its tokens."""
    return max(2, 1 + math.ceil(math.log2(max(tokens // TASK_TOKENS, 1)) / 2))


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of a group of rows, hash of its ending (30 bits), and each row's first word."""
    data = lower_bytes(data)
    s, e, first = word_spans(data, off)
    last = data[e - 1].astype(np.uint64)
    last |= np.where(e - s > 1, data[np.maximum(e - 2, 0)], 0).astype(np.uint64) << np.uint64(8)
    return span_hashes(data, s, e), (mix64(last, 3) >> np.uint64(34)).astype(np.int64), first


def count_words(docs: DataFrame) -> DataFrame:
    """(h, ending, n): hash, hash of the ending and count of every word of all documents, combined within tasks before the shuffle."""
    import pyarrow as pa

    def merge(h, b, n):
        names, first, at = np.unique(h, return_index=True, return_inverse=True)
        return names, b[first], np.bincount(at, weights=n, minlength=len(names)).astype(np.int64)

    def told(held):
        h, b, n = held
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(b.astype(np.int32)), pa.array(n)], names=["h", "ending", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, data, off in byte_groups(batch.column("text")):
                h, b, _ = _words(data, off)
                held.append(merge(h, b, np.ones(len(h))))
                size += len(held[-1][0])
                if size > 1_000_000:
                    held = [merge(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > 500_000:  # bounded memory: pass the counts on and begin anew
                        yield told(held[0])
                        held, size = [], 0
        if held:
            yield told(merge(*(np.concatenate(x) for x in zip(*held, strict=True))))

    parts = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "h long, ending int, n long")
    return parts.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Listed words with their tokens and log shares, token counts, and a table of all other words' counts (None without any)."""

    hashes: np.ndarray
    tokens: np.ndarray
    shares: np.ndarray
    counts: np.ndarray
    rest: DataFrame | None

    @property
    def size(self) -> int:
        return len(self.counts)

    @property
    def words(self) -> int:
        """Tokens that are words of their own; the others are classes of words by their endings."""
        return own_words(self.size)

    @property
    def rounds(self) -> int:
        return rounds_for(int(self.counts.sum()))

    def table(self) -> Slots:
        found = Slots(1 + max(10, int(4 * len(self.hashes) - 1).bit_length() - 1))
        found.add(self.hashes, np.arange(len(self.hashes), dtype=np.int32))
        return found

    def encode(self, table: Slots, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token of every word, the word's log share of its token, and whether it is listed; others lack the log of their count."""
        at = table.find(np.maximum(h, np.uint64(1)))
        known = at >= 0
        token = self.words + ending % (self.size - self.words)
        share = -np.log(np.maximum(self.counts, 1.0))[token]
        token[known], share[known] = self.tokens[at[known]], self.shares[at[known]]
        return token, share, known


def own_words(tokens: int) -> int:
    return tokens * 3 // 4


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words by (count, hash) as tokens, the most frequent ones up to LISTED with their counts.

    Which counts are listed is read from a histogram of counts (at most 16 * 64 rows), so that no more than
    LISTED rows reach the driver, and words of like counts are all listed or all not.  ``counts`` is read again for
    the words that are not listed.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    lowest, held, full, distinct = 1 << 30, 0, False, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        distinct += r["words"]
        full |= held + r["words"] > LISTED
        if not full:
            lowest, held = r["step"], held + r["words"]
    tokens = classes_for(distinct) ** 2
    words = own_words(tokens)
    listed = counts.filter(step >= lowest).toArrow()  # at most LISTED rows
    h, ending, n = (listed.column(c).to_numpy().astype(np.int64) for c in ("h", "ending", "n"))
    h, ending, n = (x[np.lexsort((h, -n))] for x in (h, ending, n))
    frequent = np.arange(len(h)) < words
    token = np.where(frequent, np.arange(len(h)), words + ending % (tokens - words))
    total = np.bincount(token, weights=n, minlength=tokens).astype(float)
    rest = None
    if held < distinct:
        rest = counts.filter(step < lowest).select("h", "n")
        for r in counts.filter(step < lowest).groupBy((F.col("ending") % (tokens - words)).alias("k")).agg(F.sum("n").alias("n")).collect():  # a row per class
            total[words + r["k"]] += r["n"]
    share = np.where(frequent, 0.0, np.log(n / np.maximum(total[token], 1)))
    h = np.maximum(h.view(np.uint64), np.uint64(1))
    return Vocabulary(h, token.astype(np.int64), share, total.astype(np.int64), rest)


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, scratch: Scratch) -> DataFrame:
    """(rid, doc_id, tokens, shares, rare, turn), written by turn: every row's tokens as little-endian 16-bit numbers, the sum of its
    words' log shares, the hashes of its unlisted words, whose counts are missing there, and its round of training."""
    import pyarrow as pa

    table_of = Vocabulary(vocabulary.hashes, vocabulary.tokens, vocabulary.shares, vocabulary.counts, None)  # what tasks need
    rounds = vocabulary.rounds

    def run(batches):
        table = table_of.table()
        for batch in batches:
            for at, data, off in byte_groups(batch.column("text")):
                h, ending, first = _words(data, off)
                token, share, known = table_of.encode(table, h, ending)
                raw, run_sum = token.astype("<u2"), np.concatenate(([0.0], np.cumsum(share)))
                packed = [raw[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                ends = np.concatenate(([0], np.cumsum(~known)))[first].astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[~known].view(np.int64)))
                some = batch.slice(at, len(off) - 1)
                yield pa.RecordBatch.from_arrays(
                    [some.column("rid"), some.column("doc_id"), pa.array(packed, pa.large_binary()).cast(pa.binary()), pa.array(run_sum[first[1:]] - run_sum[first[:-1]]),
                     rare, pa.array([round_of(x, rounds) for x in packed], pa.int32())],
                    names=["rid", "doc_id", "tokens", "shares", "rare", "turn"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "rid long, doc_id long, tokens binary, shares double, rare array<long>, turn int"
    path = scratch.path("tokens")
    map_arrow(rows, run, schema).write.partitionBy("turn").parquet(path)
    return scratch.spark.read.schema(schema).parquet(path)


def rare_shares(encoded: DataFrame, vocabulary: Vocabulary, scratch: Scratch) -> DataFrame | None:
    """(rid, more): the sum of the log counts of each row's unlisted words, by a join; a word that the corpus lacks counts half."""
    if vocabulary.rest is None and encoded.filter(F.size("rare") > 0).isEmpty():
        return None
    rare = encoded.select("rid", F.explode("rare").alias("h"))
    count = F.lit(0.5)
    if vocabulary.rest is not None:
        rare, count = rare.join(vocabulary.rest, "h", "left"), F.coalesce("n", F.lit(0.5))
    return scratch.write(rare.groupBy("rid").agg(F.sum(F.log(count)).alias("more")), "rare-shares")


class Network:
    """Per-position embeddings of the context, one hidden layer, and a softmax over classes and over members."""

    def __init__(self, weights: np.ndarray):
        self.classes = next(k for k in range(SIDES[0], SIDES[1] + 1, 8) if self.size(k * k) == len(weights))
        self.tokens, at = self.classes**2, 0
        self.pad = self.tokens
        self.flat = weights.astype(np.float32)
        self.w = {}
        for name, shape in self.shapes(self.classes).items():
            size = int(np.prod(shape))
            self.w[name] = self.flat[at : at + size].reshape(shape)
            at += size

    @staticmethod
    def shapes(k: int) -> dict[str, tuple[int, ...]]:
        """Of ``k`` classes of ``k`` members."""
        return {
            "embed": (2 * SIDE, k * k + 1, HIDDEN), "bias": (HIDDEN,), "to_class": (HIDDEN, k), "class_bias": (k,),
            "gate": (k, HIDDEN), "to_member": (HIDDEN, k), "member_bias": (k, k),
        }

    @classmethod
    def size(cls, tokens: int) -> int:
        return sum(int(np.prod(s)) for s in cls.shapes(math.isqrt(tokens)).values())

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small random weights; the biases give the corpus frequencies."""
        out = cls(np.random.default_rng(5).normal(0, 0.1, cls.size(len(counts))))
        share = (counts.reshape(out.classes, out.classes) + 0.5) / (counts.sum() + 0.5 * len(counts))
        out.w["bias"][:] = 0
        out.w["gate"][:] = 1
        out.w["class_bias"][:] = np.log(share.sum(axis=1))
        out.w["member_bias"][:] = np.log(share / share.sum(axis=1, keepdims=True))
        return out

    def forward(self, context: np.ndarray, cls: np.ndarray):
        w = self.w
        z = w["embed"][0].take(context[0], axis=0)
        for k in range(1, 2 * SIDE):
            z += w["embed"][k].take(context[k], axis=0)
        z += w["bias"]
        h = np.tanh(z)
        a = h @ w["to_class"] + w["class_bias"]
        g = h * w["gate"].take(cls, axis=0)
        b = g @ w["to_member"] + w["member_bias"].take(cls, axis=0)
        for x in (a, b):
            x -= x.max(axis=1, keepdims=True)
        return h, g, a, b

    def log_prob(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log-probability of each token in its context (2 * SIDE rows of tokens)."""
        cls, member = np.divmod(token, self.classes)
        _, _, a, b = self.forward(context, cls)
        at = np.arange(len(token))
        return a[at, cls] - np.log(np.exp(a).sum(axis=1)) + b[at, member] - np.log(np.exp(b).sum(axis=1))

    def train(self, context: np.ndarray, token: np.ndarray, seen: dict) -> None:
        """One step of AdaGrad on a batch."""
        w, n = self.w, len(token)
        cls, member = np.divmod(token, self.classes)
        h, g, a, b = self.forward(context, cls)
        at = np.arange(n)
        for x, y in ((a, cls), (b, member)):
            np.exp(x, out=x)
            x /= x.sum(axis=1, keepdims=True)
            x[at, y] -= 1
            x /= n
        dg = b @ w["to_member"].T
        dz = (dg * w["gate"].take(cls, axis=0) + a @ w["to_class"].T) * (1 - h * h)
        chosen = (np.arange(self.classes)[:, None] == cls).astype(np.float32)  # sums by class as products
        d_gate, d_member = chosen @ (dg * h), chosen @ b
        grads = {
            "bias": dz.sum(axis=0), "to_class": h.T @ a, "class_bias": a.sum(axis=0), "gate": d_gate,
            "to_member": g.T @ b, "member_bias": d_member,
        }
        for name, d in grads.items():
            seen[name] = seen.get(name, 1e-6) + d * d
            w[name] -= RATE * d / np.sqrt(seen[name])
        rows = seen.setdefault("rows", np.full(2 * SIDE * (self.tokens + 1), 1e-6, np.float32))
        embed = w["embed"].reshape(-1, HIDDEN)
        place = (context + np.arange(2 * SIDE)[:, None] * (self.tokens + 1)).astype(np.uint16).ravel()  # sorted by radix; SIDES keeps it in range
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        d, words = np.add.reduceat(dz.take(order % n, axis=0), first, axis=0), place[first]
        rows[words] += (d * d).mean(axis=1)
        embed[words] -= RATE * d / np.sqrt(rows[words])[:, None]


def _padded(column, pad: int):
    """Yield (first row, tokens, their places among padded tokens, padded tokens, row bounds) over a column of packed tokens."""
    at, size = 0, len(column)
    raw = column.to_pylist()
    while at < size:
        end, held = at, 0
        while end < size and (end == at or held + len(raw[end]) <= 1 << 18):
            held += len(raw[end])
            end += 1
        first = np.concatenate(([0], np.cumsum([len(x) // 2 for x in raw[at:end]])))
        token = np.frombuffer(b"".join(raw[at:end]), "<u2").astype(np.int16)
        place = np.arange(len(token)) + SIDE * (np.repeat(np.arange(end - at), np.diff(first)) + 1)
        padded = np.full(len(token) + SIDE * (end - at + 1), pad, np.int16)
        padded[place] = token
        yield at, token, place, padded, first
        at = end


def round_of(tokens: bytes, rounds: int) -> int:
    """The round that trains on a document."""
    return zlib.crc32(tokens) % rounds


def _train_round(encoded: DataFrame, start: np.ndarray) -> np.ndarray:
    import pyarrow as pa

    size = len(start)

    def run(batches):
        net, seen, trained, held = Network(start), {}, 0, []

        def step(final: bool):
            nonlocal trained, held
            have = sum(len(t) for _, t in held)
            if not have or (have < BATCH and not final):
                return
            context, token = np.concatenate([c for c, _ in held], axis=1), np.concatenate([t for _, t in held])
            stop = have if final else have - have % BATCH
            for lo in range(0, stop, BATCH):
                net.train(context[:, lo : min(lo + BATCH, stop)], token[lo : min(lo + BATCH, stop)], seen)
            trained += stop
            held = [(context[:, stop:], token[stop:])]

        for batch in batches:
            for _, token, place, padded, _ in _padded(batch.column("tokens"), net.pad):
                for lo in range(0, len(token), 1 << 18):  # a long document's contexts are never all in memory
                    some = place[lo : lo + (1 << 18)]
                    held.append((np.stack([padded[some + k] for k in _SHIFTS]), token[lo : lo + (1 << 18)]))
                    step(False)
        step(True)
        if trained:
            cell = np.arange(size + 1, dtype=np.int64)
            value = np.append(net.flat.astype(np.float64) * trained, trained)
            for lo in range(0, size + 1, 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(cell[lo : lo + 20_000]), pa.array(value[lo : lo + 20_000])], names=["cell", "value"])

    parts = map_arrow(encoded.select("tokens"), run, "cell long, value double")
    total = parts.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()  # one row per weight
    if not len(total):
        return start
    out = np.zeros(size + 1)
    out[total["cell"].to_numpy()] = total["value"].to_numpy()
    return (out[:size] / out[size]).astype(np.float32)


def train(encoded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights after all rounds of averaged local descent over all windows of a table of tokens."""
    weights = Network.start(vocabulary.counts).flat
    tasks = max(1, int(vocabulary.counts.sum()) // TASK_TOKENS)
    for turn in range(vocabulary.rounds):
        weights = _train_round(encoded.filter(F.col("turn") == turn).select("tokens").coalesce(tasks), weights)
    return weights


def fit(docs: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """Count the corpus, then train on all its windows."""
    scratch = Scratch(docs.sparkSession, "lm")
    vocabulary = build_vocabulary(scratch.write(count_words(docs), "word-counts"))
    return vocabulary, train(encode_documents(docs, vocabulary, scratch), vocabulary)


def score_encoded(encoded: DataFrame, weights: np.ndarray, rare: DataFrame | None = None) -> DataFrame:
    """doc_id, log_likelihood (sum over all words), mean_log_likelihood (null without words), n_tokens."""
    import pyarrow as pa

    def run(batches):
        net = Network(weights)
        for batch in batches:
            shares = batch.column("shares").to_numpy()
            for at, token, place, padded, first in _padded(batch.column("tokens"), net.pad):
                logs = np.empty(len(token))
                for lo in range(0, len(token), 8192):
                    some = place[lo : lo + 8192]
                    logs[lo : lo + 8192] = net.log_prob([padded[some + k] for k in _SHIFTS], token[lo : lo + 8192])
                run_sum = np.concatenate(([0.0], np.cumsum(logs)))
                n = np.diff(first)
                total = run_sum[first[1:]] - run_sum[first[:-1]] + shares[at : at + len(n)]
                some = batch.slice(at, len(n))
                yield pa.RecordBatch.from_arrays([some.column("rid"), some.column("doc_id"), pa.array(total), pa.array(n)], names=["rid", "doc_id", "log_likelihood", "n_tokens"])

    out = map_arrow(encoded.select("rid", "doc_id", "tokens", "shares"), run, "rid long, doc_id long, log_likelihood double, n_tokens long")
    if rare is not None:
        out = out.join(rare, "rid", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select("doc_id", "log_likelihood", mean.alias("mean_log_likelihood"), "n_tokens")


def score(docs: DataFrame, vocabulary: Vocabulary, weights: np.ndarray) -> DataFrame:
    """The scores of documents under a fitted model, as ``score_encoded`` gives them."""
    scratch = Scratch(docs.sparkSession, "lm")
    encoded = encode_documents(docs, vocabulary, scratch)
    return score_encoded(encoded, weights, rare_shares(encoded, vocabulary, scratch))


def score_documents(docs: DataFrame) -> DataFrame:
    """Fit on the corpus and score each of its documents by masked pseudo-likelihood: doc_id, score,
    log_likelihood, mean_log_likelihood, n_tokens; ``score`` is the mean, 0 where there are no words.

    docs: doc_id, text and any other columns (ignored).  Words are runs without ASCII white space, A-Z
    lower-cased.  Null, empty and blank texts have no words: log_likelihood 0, mean null.  Null ids and
    repeated rows are scored like any other; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    counts = scratch.write(count_words(docs), "word-counts")
    vocabulary = build_vocabulary(counts)
    encoded = encode_documents(docs, vocabulary, scratch)
    rare = rare_shares(encoded, vocabulary, scratch)
    scratch.drop(counts)
    out = score_encoded(encoded, train(encoded, vocabulary), rare)
    return out.select("doc_id", F.coalesce("mean_log_likelihood", F.lit(0.0)).alias("score"), "log_likelihood", "mean_log_likelihood", "n_tokens")
