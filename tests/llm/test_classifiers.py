"""Quality, language and language-model scores: held-out accuracy, brute force, odd rows."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.llm import langid, lm_score, quality
from depweave.llm.common import crc32_mod


def Q():
    return crc32_mod(F.col("doc_id"), 3) == 1


def L():
    return crc32_mod(F.col("doc_id"), 5) == 0


def test_quality_held_out(spark, sf_dir):
    larger = f"{Path(sf_dir).parent}/sf0.01"  # the smallest tables hold ten labelled rows of low quality only
    labels, documents = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("labels", "documents"))
    rows = quality.classify_quality(documents, labels, Q()).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95


def test_quality_against_direct_densities(spark, sf_dir, documents):
    """Scores from scratch: class moments of the labelled rows, shrunk covariances, Gaussian log-densities."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in quality.classify_quality(documents, labels, Q()).collect()}
    stats = {r["doc_id"]: np.array(r["stats"]) for r in quality.statistics_table(documents).collect()}
    held = {r["doc_id"] for r in documents.select("doc_id", Q().alias("h")).filter("h").collect()}
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] in (0, 1) and r["doc_id"] not in held and r["doc_id"] in stats]
    x, y = np.array([stats[i] for i, _ in known]), np.array([q for _, q in known])
    centre, scale = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-8))
    z = (x - centre) / scale
    own = [np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)]
    pooled = sum(s * (y == c).sum() for c, s in enumerate(own)) / len(y)
    k, logs = x.shape[1], []
    every = (np.array([stats[i] for i in got]) - centre) / scale
    for c, s in enumerate(own):
        s = (1 - quality.SHRINK_POOLED) * s + quality.SHRINK_POOLED * pooled
        s = (1 - quality.SHRINK_IDENTITY) * s + quality.SHRINK_IDENTITY * np.trace(s) / k * np.eye(k) + 1e-6 * np.eye(k)
        d = every - z[y == c].mean(axis=0)
        logs.append(np.log((y == c).sum()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (d * np.linalg.solve(s, d.T).T).sum(axis=1))
    want = 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / quality.TEMPERATURE, -500, 500)))
    assert np.allclose(list(got.values()), want, atol=1e-6)


def test_quality_ignores_labels_lang_source_and_id(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = lambda d: {r["doc_id"]: round(r["score"], 9) for r in quality.classify_quality(d, labels, Q()).collect()}
    assert score(documents) == score(documents.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)))
    flipped = labels.withColumn("quality", F.when(Q(), 1 - F.col("quality")).otherwise(F.col("quality")))
    same = {r["doc_id"]: round(r["score"], 9) for r in quality.classify_quality(documents, flipped, Q()).collect()}
    assert score(documents) == same  # held-out labels are never read


def test_quality_odd_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(4, 1, "x"), (7, 0, "x"), (7, None, "x"), (9, 5, "x"), (99, 1, "x")], "doc_id long, quality int, text string")
    rows = quality.classify_quality(messy, labels, Q()).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify_quality(nothing, labels, Q()).count() == 0
    blank = quality.classify_quality(messy, labels.filter("false"), Q()).collect()
    assert {r["score"] for r in blank} == {0.5}
    kept = quality.keep_quality(messy, labels, Q())
    assert kept.columns == messy.columns
    assert kept.count() == sum(r["predicted"] for r in rows)


def test_statistics_do_not_depend_on_the_batch():
    texts = ["Some plain words here.", "", "A!! B!! C!!", "x | y | z\nx | y | z", "é è ü"]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    together = quality.document_statistics(np.frombuffer(b"".join(raw), np.uint8), off)
    for k, r in enumerate(raw):
        alone = quality.document_statistics(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.allclose(together[k], alone[0])
    assert np.isfinite(together).all() and together.shape[1] == len(quality.FEATURES)


def test_discriminant_finds_a_curved_border():
    rng = np.random.default_rng(0)
    k = len(quality.FEATURES)
    inner, outer = rng.normal(0, 1, (500, k)), rng.normal(0, 3, (500, k))
    identity = np.eye(k)
    white = (identity / 3, identity)
    model = quality.Discriminant(np.zeros(k), np.ones(k), white, (np.zeros(k),) * 2, (-k * np.log(3), 0.0))
    assert (model.score(inner) > 0.5).mean() > 0.95 and (model.score(outer) < 0.5).mean() > 0.95


def test_language_held_out(documents):
    rows = langid.identify_languages(documents, L()).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.93
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark, messy, nothing, documents):
    rows = {r["doc_id"]: r for r in langid.identify_languages(messy, L()).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3))
    assert rows[None] is not None and langid.identify_languages(nothing, L()).count() == 0
    mixed = documents.select("doc_id", "text", "lang").union(messy.select(F.col("doc_id") + 10**9, "text", F.lit(None).cast("string")))
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(mixed, L()).filter("doc_id >= 1000000000").collect()}
    assert {odd[10**9 + i] for i in (1, 2, 3)} == {"und"} and odd[10**9 + 4] != "und"
    kept = langid.keep_identified(mixed, L())
    assert kept.columns == mixed.columns and kept.filter("text is null").count() == 0


def test_every_language_has_a_dictionary(spark):
    text = lambda w, n, k: " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + (i * 7 + k) % 26)}" for i in range(n))
    rows = [("copies", text("ko", 100, k % 10)) for k in range(10_000)]  # 10 distinct texts
    rows += [("short", text("sa", 8, k)) for k in range(26)] + [("long", text("lu", 5000, k)) for k in range(3)] + [("usual", text("ub", 100, k)) for k in range(26)]
    found = langid.sample_dictionaries(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(found) == ["copies", "long", "short", "usual"]
    assert found["copies"].count(b"\n") == 10 and found["short"].count(b"\n") == 26 and len(found["long"]) > 20_000


def test_language_against_plain_zstandard(spark, documents):
    """Every prediction from scratch: each language's dictionary, both word orders, the fewest bytes."""
    import re

    import zstandard

    known = langid.sample_dictionaries(documents.filter(~L()).select("text", "lang"))
    assert all(0 < len(x) <= langid.DICTIONARY_BYTES for x in known.values())
    kinds = sorted(known)
    for r in langid.identify_languages(documents, L()).join(documents.select("doc_id", "text"), "doc_id").collect():
        plain = re.sub(rb"[\x00-\x09\x0b-\x1f\x21-\x40\x5b-\x60\x7b-\x7f]", b"", (r["text"] or "").lower().encode())
        sizes = []
        for k in kinds:
            content = zstandard.ZstdCompressionDict(known[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=langid.LEVEL)
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=content, write_content_size=False, write_dict_id=False)
            orders = plain, b" ".join(reversed(plain.split()))
            sizes.append(sum(len(c.compress(x[i : i + langid.BLOCK])) for x in orders for i in range(0, len(x), langid.BLOCK)))
        if re.search(r"[^\W\d_]", r["text"] or ""):
            assert r["lang_pred"] == kinds[sizes.index(min(sizes))]
            low, second = sorted(sizes)[:2]
            assert r["margin"] == pytest.approx((second - low) / low) and r["rejected"] == (r["margin"] < langid.MIN_MARGIN)
        else:
            assert r["lang_pred"] == "und"


def test_dictionaries_do_not_depend_on_partitions_or_copies(documents):
    rows = documents.select("text", "lang")
    assert langid.sample_dictionaries(rows.repartition(7)) == langid.sample_dictionaries(rows.union(rows).repartition(3))


def test_lm_scores(documents, texts, messy, nothing):
    vocabulary, weights = lm_score.fit(documents)
    rows = {r["doc_id"]: r for r in lm_score.score(documents, vocabulary, weights).collect()}
    n = {i: len(t.split()) for i, t in texts.items()}
    assert vocabulary.counts.sum() == sum(n.values()) == sum(r["n_tokens"] for r in rows.values())
    net = lm_score.Network(weights)
    tokens = np.arange(vocabulary.size)
    context = [np.full(vocabulary.size, 3 + k) for k in range(2 * lm_score.SIDE)]
    assert np.exp(net.log_prob(context, tokens)).sum() == pytest.approx(1, abs=1e-4)
    odd = {r["doc_id"]: r for r in lm_score.score(messy, vocabulary, weights).collect()}
    assert [(odd[i]["n_tokens"], odd[i]["log_likelihood"], odd[i]["mean_log_likelihood"]) for i in (1, 2, 3)] == [(0, 0.0, None)] * 3
    assert lm_score.score_documents(nothing).count() == 0
    whole = lm_score.score_documents(messy).collect()
    assert len(whole) == messy.count() and all((r["score"] == r["mean_log_likelihood"]) if r["n_tokens"] else r["score"] == 0 for r in whole)


@pytest.mark.parametrize("listed", [1 << 18, 900, 100])
def test_lm_words_share_their_token(spark, documents, texts, monkeypatch, listed):
    """Every word of the corpus has the share of its own count, listed or not; a token's words share it among them."""
    import collections
    import math

    from depweave.llm.common import Scratch

    monkeypatch.setattr(lm_score, "LISTED", listed)
    scratch = Scratch(spark, "lm")
    vocabulary = lm_score.build_vocabulary(scratch.write(lm_score.count_words(documents), "counts"))
    assert len(vocabulary.hashes) <= listed and (vocabulary.rest is None) == (listed == 1 << 18)
    count = collections.Counter(w for t in texts.values() for w in re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)})))
    words = sorted(count)
    encoded = lm_score.encode_documents(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), vocabulary, scratch)
    rare = lm_score.rare_shares(encoded, vocabulary, scratch)
    more = {r["rid"]: r["more"] for r in rare.collect()} if rare is not None else {}
    total = np.zeros(vocabulary.size)
    for r in encoded.collect():
        token, share = int.from_bytes(r["tokens"], "little"), r["shares"] + more.get(r["rid"], 0)
        total[token] += math.exp(share)
        assert math.exp(share) * vocabulary.counts[token] == pytest.approx(count[words[r["doc_id"]]])
    assert np.allclose(total[vocabulary.counts > 0], 1)
    unseen = lm_score.encode_documents(spark.createDataFrame([(1, "neverseen")], "doc_id long, text string"), vocabulary, scratch)
    assert lm_score.rare_shares(unseen, vocabulary, scratch).first()["more"] == pytest.approx(math.log(0.5))


def test_lm_grows_with_the_corpus():
    sizes = [lm_score.classes_for(n) for n in (0, 100, 10**4, 10**6, 10**7, 10**9)]
    assert sizes == [8, 8, 16, 32, 64, 96]
    assert [lm_score.rounds_for(n) for n in (0, 10**6, 10**8, 10**13)] == [2, 2, 4, 13]
    for k in sizes:
        net = lm_score.Network(np.zeros(lm_score.Network.size(k * k)))
        assert net.classes == k and 2 * lm_score.SIDE * (net.tokens + 1) <= 1 << 16


def test_lm_score_is_the_sum_over_masked_positions(documents):
    from depweave.llm.common import lower_bytes, span_hashes, word_spans

    vocabulary, weights = lm_score.fit(documents)
    net, row = lm_score.Network(weights), documents.orderBy("doc_id").first()
    data = np.frombuffer(row["text"].encode(), np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]))
    _, ending, _ = lm_score._words(data, np.array([0, len(data)]))
    tokens, shares, known = vocabulary.encode(vocabulary.table(), span_hashes(lower_bytes(data), s, e), ending)
    assert known.all()
    token, total = tokens.tolist(), float(shares.sum())
    for i, t in enumerate(token):
        around = [token[i + k] if 0 <= i + k < len(token) else net.pad for k in lm_score._SHIFTS]
        total += net.log_prob([np.array([c]) for c in around], np.array([t]))[0]
    got = lm_score.score(documents.filter(F.col("doc_id") == row["doc_id"]), vocabulary, weights).first()
    assert got["log_likelihood"] == pytest.approx(total, rel=1e-4)


def test_lm_trains_on_every_window_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm_score.Network, "train", lambda self, context, token, state: seen.extend(token.tolist()))
    monkeypatch.setattr(lm_score, "map_arrow", lambda df, run, schema: df.sparkSession.createDataFrame(
        [tuple(r.values()) for b in run(df.toArrow().to_batches()) for r in b.to_pylist()], schema))  # in this process
    texts = [f"w{k} a b c d e f g h i{k}" for k in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    vocabulary, weights = lm_score.fit(docs)
    assert np.isfinite(weights).all()
    assert (np.bincount(seen, minlength=vocabulary.size) == vocabulary.counts).all()


def test_lm_learns_the_order_of_words(spark):
    """Held-out text of a word chain scores clearly above word frequencies and above its own words shuffled."""
    rng = np.random.default_rng(0)
    follows = rng.integers(0, 60, (60, 3))

    def chain(n):
        out = [int(rng.integers(60))]
        while len(out) < n:
            out.append(int(follows[out[-1]][rng.integers(3)]) if rng.random() < 0.85 else int(rng.integers(60)))
        return [f"v{x}" for x in out]

    known, fresh = [chain(100) for _ in range(2500)], [chain(100) for _ in range(200)]
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(known)], "doc_id long, text string").repartition(2)
    vocabulary, weights = lm_score.fit(docs)
    mean = lambda rows: lm_score.score(spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "doc_id long, text string"), vocabulary, weights).agg(F.avg("mean_log_likelihood")).first()[0]
    share = vocabulary.counts[vocabulary.counts > 0] / vocabulary.counts.sum()
    unigram = (share * np.log(share)).sum()
    model, shuffled = mean(fresh), mean([rng.permutation(x).tolist() for x in fresh])
    assert model > unigram + 1 and model > shuffled + 1


def test_language_margin_does_not_shrink_with_length():
    rng = np.random.default_rng(3)
    words = {k: ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)] for k in ("xx", "yy")}
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    compressors = langid._compressors({k: text(k, 30_000).encode() for k in words})
    (one, _, short), (many, _, long) = (langid.predict(text("xx", n), ["xx", "yy"], compressors) for n in (14_000, 280_000))
    assert one == many == "xx" and long > 0.7 * short


def test_texts_without_letters_are_undetermined(spark, documents):
    odd = ["²", "½ ①", "Ⅷ 12", "٣٤", "_ - 7", "漢", "é", "ʰ"]  # the last three are letters
    rows = [(10**6 + k, t, "xx") for k, t in enumerate(odd)]
    docs = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify_languages(docs, L() | (F.col("doc_id") >= 10**6)).filter("doc_id >= 1000000").collect()}
    assert [got[10**6 + k][0] == "und" for k in range(len(odd))] == [True] * 5 + [False] * 3
    assert all(got[10**6 + k] == ("und", 0.0) for k in range(5))
