"""Quality classification by regularised quadratic discriminant analysis on document statistics.

Every text becomes a short vector of statistics, transformed towards normality.  The two classes are
Gaussians whose covariances are shrunk towards the pooled one and towards a scaled identity (Friedman
1989).  A score is the logistic of the difference of the two Mahalanobis log-densities plus the log prior
ratio, over a fixed temperature; the Cholesky factors are computed once and go with the tasks.

Fitting is one distributed pass: tasks reduce labelled rows to counts, sums and outer products, which
Spark adds up; only the totals (about a thousand numbers) reach the driver, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_groups, lower_bytes, map_arrow, span_hashes, word_spans

FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "symbol", "pipe", "sentence", "non_ascii", "space", "word_mean",
    "word_spread", "long_words", "short_words", "distinct", "repeat_next", "line_mean", "distinct_lines", "entropy",
)
SHRINK_POOLED, SHRINK_IDENTITY = 0.2, 0.05
TEMPERATURE = 8.0  # softens the over-confident product of many statistics; does not move the 0.5 threshold

#: Shares of short texts are drawn to plain prose, as if so many more words of it were there.
PRIOR_WORDS = 15
PRIOR = {"upper": 0.015, "sentence": 0.13, "mean": 6.0, "square": 45.0, "long": 0.06, "short": 0.3, "distinct": 0.9, "entropy": 4.1, "space": 0.15, "bytes": 7.0}

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[list(b"!#$%&*+<=>@^_~{}[]\\/")] = 3
_KIND[list(b"|")] = 4
_KIND[list(b".,;:?")] = 5
_KIND[128:] = 6
_KIND[[9, 10, 11, 12, 13, 32]] = 7


def _per_row(values: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=m)


def _distinct(row: np.ndarray, h: np.ndarray, m: int) -> np.ndarray:
    """Distinct hashes in each row."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1]))) if len(r) else np.zeros(0, bool)
    return np.bincount(r[new], minlength=m)


def document_statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text gets the values of all counts being zero."""
    m, size = len(off) - 1, np.diff(off).astype(float)
    row = np.repeat(np.arange(m), np.diff(off))
    kinds = np.bincount(row * 8 + _KIND[data], minlength=8 * m).reshape(m, 8)
    hist = np.bincount(row * 256 + data, minlength=256 * m).reshape(m, 256)
    one = np.maximum(size, 1)
    p = hist / one[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    s, e, first = word_spans(data, off)
    n = np.diff(first)
    words = np.maximum(n, 1).astype(float)
    wrow = np.repeat(np.arange(m), n)
    length = (e - s).astype(float)
    near = words + PRIOR_WORDS
    near_bytes = one + PRIOR_WORDS * PRIOR["bytes"]
    drawn = lambda total, name, base=near, unit=1.0: (total + PRIOR_WORDS * unit * PRIOR[name]) / base
    mean = drawn(_per_row(length, wrow, m), "mean")
    spread = np.sqrt(np.maximum(drawn(_per_row(length**2, wrow, m), "square") - mean**2, 0))
    h = span_hashes(lower_bytes(data), s, e)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
    ends = np.flatnonzero(data == 10)
    lines = np.bincount(row[ends], minlength=m) + 1.0
    bounds = np.unique(np.concatenate((off[:-1], ends, ends + 1)))
    bounds = bounds[bounds < len(data)]
    stop = np.append(bounds[1:], len(data))
    real = data[bounds] != 10 if len(bounds) else np.zeros(0, bool)
    line_hash = span_hashes(data, bounds[real], stop[real]) if len(bounds) else np.zeros(0, np.uint64)
    line_row = row[bounds[real]] if len(bounds) else np.zeros(0, np.int64)
    full_lines = np.maximum(np.bincount(line_row, minlength=m), 1)
    out = np.stack(
        [
            np.log1p(size), np.log1p(n), drawn(kinds[:, 1], "upper", near_bytes, PRIOR["bytes"]), kinds[:, 2] / one,
            kinds[:, 3] / one, kinds[:, 4] / one, drawn(kinds[:, 5], "sentence"), kinds[:, 6] / one,
            drawn(kinds[:, 7], "space", near_bytes, PRIOR["bytes"]), mean, spread,
            drawn(_per_row(length > 12, wrow, m), "long"), drawn(_per_row(length <= 3, wrow, m), "short"),
            drawn(_distinct(wrow, h, m), "distinct"), _per_row(same, wrow, m) / near, np.log1p(size / lines),
            _distinct(line_row, line_hash, m) / full_lines, drawn(entropy * one, "entropy", near_bytes, PRIOR["bytes"]),
        ],
        axis=1,
    )
    for k in (2, 3, 4, 5, 14):  # rare shares: on a square-root scale
        out[:, k] = np.sqrt(out[:, k])
    for k in (9, 10):
        out[:, k] = np.log1p(out[:, k])
    out[:, 13] = out[:, 13] * np.log1p(words) / 3  # the share of distinct words falls with length
    return out


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row; null text counts as empty."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at, data, off in byte_groups(batch.column("text")):
                x = document_statistics(data, off)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(x)), flat], names=["doc_id", "stats"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Two shrunk Gaussians in whitened form: log-density = const - |white @ x - at|^2 / 2."""

    centre: np.ndarray
    scale: np.ndarray
    white: tuple[np.ndarray, np.ndarray]
    at: tuple[np.ndarray, np.ndarray]
    const: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        low, high = (c - 0.5 * ((z @ w.T - a) ** 2).sum(axis=1) for w, a, c in zip(self.white, self.at, self.const, strict=True))
        return 1 / (1 + np.exp(-np.clip((high - low) / TEMPERATURE, -500, 500)))


def fit(labelled: DataFrame) -> Discriminant | None:
    """Fit on rows (label 0 or 1, stats); None where no row is labelled.

    A class with no rows takes the pooled moments with half a row's weight, so that scores stay finite.
    Sums are taken about the statistics' means, so that they stay exact over very many rows.
    """
    import pyarrow as pa

    k = len(FEATURES)
    means = labelled.agg(*[F.avg(F.get("stats", F.lit(i))) for i in range(k)]).first()
    if means[0] is None:
        return None
    origin = np.array(means)

    def reduce(batches):
        sums = {}
        for batch in batches:
            y = batch.column("label").to_numpy()
            x = batch.column("stats").flatten().to_numpy().reshape(len(y), k)
            for c in np.unique(y).tolist():
                z = np.column_stack((np.ones((y == c).sum()), x[y == c] - origin))
                sums[c] = sums.get(c, 0) + z.T @ z
        for c, total in sums.items():
            cell = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, c)), pa.array(cell), pa.array(total.ravel())], names=["label", "cell", "value"])

    parts = map_arrow(labelled.select(F.col("label").cast("long").alias("label"), "stats"), reduce, "label long, cell long, value double")
    totals = {c: np.zeros((k + 1, k + 1)) for c in (0, 1)}
    for r in parts.groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():  # 2 * 361 rows
        if r["label"] in totals:
            totals[r["label"]][divmod(r["cell"], k + 1)] = r["value"]
    both = totals[0] + totals[1]
    if both[0, 0] < 1:
        return None

    def moments(t):
        mean = t[0, 1:] / t[0, 0]
        return mean, t[1:, 1:] / t[0, 0] - np.outer(mean, mean)

    centre, cov = moments(both)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-8))
    white, at, const, parts_of = [], [], [], {}
    for c in (0, 1):
        n = totals[c][0, 0]
        mean, s = moments(totals[c]) if n >= 1 else (centre, cov)
        parts_of[c] = ((mean - centre) / scale, s / np.outer(scale, scale), max(n, 0.5))
    pooled = sum(s * n for _, s, n in parts_of.values()) / sum(n for *_, n in parts_of.values())
    for c in (0, 1):
        mean, s, n = parts_of[c]
        s = (1 - SHRINK_POOLED) * s + SHRINK_POOLED * pooled
        s = (1 - SHRINK_IDENTITY) * s + SHRINK_IDENTITY * np.trace(s) / k * np.eye(k) + 1e-6 * np.eye(k)
        factor = np.linalg.cholesky(s)
        w = np.linalg.inv(factor)
        white.append(w)
        at.append(w @ mean)
        const.append(float(np.log(n) - np.log(np.diag(factor)).sum()))
    return Discriminant(origin + centre, scale, tuple(white), tuple(at), tuple(const))


def score_statistics(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score) of every row of a statistics table."""
    import pyarrow as pa

    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches):
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy().reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return map_arrow(stats, run, "doc_id long, score double")


def _train(docs: DataFrame, labels: DataFrame, held_out: Column, scratch: Scratch) -> tuple[DataFrame, Discriminant | None]:
    stats = scratch.write(statistics_table(docs).withColumn("held_out", F.coalesce(held_out, F.lit(True))), "statistics")
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    labelled = scratch.write(stats.filter(~F.col("held_out")).join(known, "doc_id").select("label", "stats"), "labelled")
    model = fit(labelled)
    scratch.drop(labelled)
    return stats, model


def keep_quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that ``classify_quality`` would predict 1 for.

    Each row is judged where it is read; nothing but the statistics is written or moved.  Null and empty texts
    are judged by the statistics of an empty text, repeated rows each, rows with a null doc_id like any other;
    without any label all rows stay; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats, model = _train(docs, labels, held_out, scratch)
    scratch.drop(stats)
    if model is None:
        return docs

    def run(batches):
        for batch in batches:
            keep = [model.score(document_statistics(data, off)) >= threshold for _, data, off in byte_groups(batch.column("text"))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    import pyarrow as pa

    return map_arrow(docs, run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.5) -> DataFrame:
    """Score every document: doc_id, held_out, score (0 to 1, higher is better), predicted (0 or 1).

    docs: doc_id, text; labels: doc_id, quality (rows without a 0 or 1 are ignored; more columns are
    ignored).  ``held_out`` is an expression over doc_id; such rows, and rows with a null doc_id, are never
    learnt from.  Texts alone make the score; null text counts as empty.  Repeated documents are scored
    each; a document labelled more than once counts for each label.  Without any label all scores are 0.5.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats, model = _train(docs, labels, held_out, scratch)
    scored = score_statistics(stats, model)
    return scored.withColumn("held_out", F.coalesce(held_out, F.lit(True))).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
